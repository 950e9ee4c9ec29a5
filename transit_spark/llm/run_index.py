"""Removal of long repeated byte strings with run-length compressed indexes.

A string of ``LENGTH`` bytes is placed by its anchor, the 20-byte gram in it with the smallest hash: equal strings have
equal anchors at equal places. The texts are cut into segments, the strings of one anchor each. Segments whose anchor
occurs nowhere else are done; the others meet by anchor. There, equal segments fall together, and of those that differ
only what may hold a string of another one is left (``shared_parts``). Over these parts a Burrows-Wheeler transform is
built, kept as runs with the text positions at their ends. All parts are then streamed through it backwards: the
matching statistics give, for each place, the range of suffixes that share the longest match, here bounded by
``LENGTH``, and the sample at the head of the range's first run is the earliest of them.

The transform sorts suffixes by their first ``LENGTH`` bytes and equal ones by position, and no run crosses two classes
of such suffixes, so that first sample is exact and no other one has to be located.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transit_spark.llm import common
from transit_spark.llm.common import bucket_count, keyed, mix64, pack, release, text_bytes, trimmed
from transit_spark.session import stage

LENGTH = 100
GRAM = 20
#: Least and most bytes of text in a chunk; large inputs have large ones, as every chunk sends a row to every bucket.
CHUNK_BYTES = 4 << 20
MOST_CHUNK_BYTES = 16 << 20
CHUNKS = 256
UNIT_BYTES = 1 << 20
BUCKET_BYTES = 4 << 20
INDEX_BYTES = 1 << 17
#: Strings of one anchor are told apart by so many neighbouring places of the anchor in them.
PLACES = 16
_BASE = 0x9E3779B97F4A7C15 | 1


def grams(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all ``GRAM``-byte grams."""

    def longer(short: np.ndarray, other: np.ndarray, reach: int, power: int) -> np.ndarray:
        n = len(short) - reach
        return short[:n] * np.uint64(pow(_BASE, power, 1 << 64)) + other[reach : reach + n]

    one = data.astype(np.uint64) + np.uint64(1)
    two = longer(one, one, 1, 1)
    four = longer(two, two, 2, 2)
    eight = longer(four, four, 4, 4)
    sixteen = longer(eight, eight, 8, 8)
    n = len(data) - GRAM + 1
    return mix64(sixteen[:n] * np.uint64(pow(_BASE, 4, 1 << 64)) + four[16 : 16 + n])


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first start, last start) of every stretch of string starts with one anchor."""
    hashes = grams(data)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)  # leftmost of equals
    reach, width = 1, length - GRAM + 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    n = len(data) - length + 1
    least = np.minimum(least[:n], least[width - reach : width - reach + n])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], n] - 1
    return hashes[place[first]], first, last


def stretches(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple]:
    """(text number, first start, last start, anchor hash) arrays over texts, a bounded unit at a time."""
    for k, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        for a in range(0, len(data) - length + 1, UNIT_BYTES):
            hashes, first, last = anchors(data[a : a + UNIT_BYTES + length - 1], length)
            yield np.full(len(first), k), first + a, last + a, hashes


def all_stretches(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts = list(stretches(texts, length))
    if not parts:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(p) for p in zip(*parts))


def buckets(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket of each anchor. Anchors are the least hashes of many, so these are mixed again before they are dealt."""
    return ((mix64(hashes) >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def anchor_places(texts: list[bytes], hashes: np.ndarray, length: int = LENGTH) -> list[int]:
    """Where the anchor of these hashes begins in each segment: in its last string, the leftmost gram of that hash."""
    sizes = np.array([len(t) for t in texts], np.int64)
    part = (np.cumsum(sizes) - sizes) // UNIT_BYTES
    places = []
    for own in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1):
        if not len(own):
            continue
        found = grams(np.frombuffer(b"".join([texts[k] for k in own.tolist()]), np.uint8))
        starts = np.cumsum(sizes[own]) - sizes[own]
        at = np.flatnonzero(found == np.repeat(hashes[own], sizes[own])[: len(found)])
        text = np.searchsorted(starts, at, side="right") - 1
        shift = at - starts[text]
        inside = (shift >= sizes[own][text] - length) & (shift <= length - GRAM)
        text, first = np.unique(text[inside], return_index=True)
        own_places = np.full(len(own), -1, np.int64)
        own_places[text] = shift[inside][first]
        places += own_places.tolist()
    return places


def shared_parts(texts: list[bytes], place: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(begin, end) of what each of one anchor's segments may share with another one; (0, 0) for nothing.

    ``place`` is where the anchor begins in the first text. A string is known by how many bytes stand before its anchor.
    All strings with ``PLACES`` neighbouring such numbers hold the same window around the anchor, so segments that share
    one of them share the window. A segment whose windows are its own shares no string; what lies outside of the strings
    of shared windows is left out. Nothing else is: equal strings of different segments stay in.
    """
    gram = texts[0][place : place + GRAM] if place >= 0 else b""
    seen: dict[tuple[int, bytes], int] = {}
    windows = []
    for text in texts:
        last = len(text) - length
        at = text.find(gram, last) if gram else -1
        if not 0 <= at <= length - GRAM:  # grams that differ have one hash: all of the segment stays
            windows.append((-1, last, ()))
            continue
        own = [(k, text[at - k * PLACES : at - (k + 1) * PLACES + 1 + length]) for k in range((at - last) // PLACES, at // PLACES + 1)]
        for w in own:
            seen[w] = seen.get(w, 0) + 1
        windows.append((at, last, own))
    parts = []
    for at, last, own in windows:
        shared = [w[0] for w in own if seen[w] > 1]
        if at < 0:
            parts.append((0, last + length))
        elif shared:
            begin, end = max(0, at - (shared[-1] + 1) * PLACES + 1), min(last, at - shared[0] * PLACES)
            parts.append((begin, end + length))
        else:
            parts.append((0, 0))
    return parts


class RunIndex:
    """Run-length transform of texts, and the earliest place of every string of ``length`` bytes in them."""

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        self.length = length
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        codes = np.zeros(int(sizes.sum()) + len(texts), np.uint16)
        inside = np.ones(len(codes), bool)
        inside[self.starts + sizes] = False  # a 0 ends each text
        codes[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + np.uint16(1)
        del inside
        self.codes = codes
        n = len(codes)

        def ranked(key: np.ndarray) -> np.ndarray:
            order = np.argsort(key)
            held = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.r_[False, held[1:] != held[:-1]], dtype=np.int32) + 1
            return rank

        def joined(rank: np.ndarray, reach: int) -> np.ndarray:
            key = rank.astype(np.int64)
            key <<= 32
            key[: max(0, n - reach)] |= rank[reach:]
            return key

        key = np.zeros(n, np.int64)
        for k in range(7):
            key <<= 9
            key[: max(0, n - k)] |= codes[k:]
        rank = ranked(key)
        del key
        depth = 7
        while 2 * depth < length:
            rank = ranked(joined(rank, depth))
            depth *= 2
        full = joined(rank, length - depth)
        order = np.argsort(full, kind="stable")
        own = full[order]
        del full
        fresh = np.r_[True, own[1:] != own[:-1]]
        del own
        less = joined(rank, length - 1 - depth)[order]
        #: first rows of the classes that share ``length - 1`` bytes
        self.parents = np.flatnonzero(np.r_[True, less[1:] != less[:-1]])
        del less, rank
        before = codes[order - 1]
        head = fresh | np.r_[True, before[1:] != before[:-1]]
        self.heads = np.flatnonzero(head)
        self.letters = before[self.heads].astype(np.int64)
        self.samples = np.stack([order[self.heads], order[np.r_[self.heads[1:], n] - 1]])  # run ends
        sizes_of_runs = np.diff(np.r_[self.heads, n])
        self.rows = n
        # runs by letter: where they start, and how many of the letter stand before them
        by = np.argsort(self.letters, kind="stable")
        self.run_keys = self.letters[by] << 40 | self.heads[by]
        counts = sizes_of_runs[by]
        self.run_sizes = counts
        self.run_before = np.cumsum(counts) - counts  # this is C[letter] + rank, as letters come in order
        self.begins = np.r_[0, np.cumsum(np.bincount(before, minlength=257))]  # this is C[letter]

    def step(self, letters: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Row of the suffixes one letter longer: all smaller letters, and this letter before the row."""
        k = np.searchsorted(self.run_keys, letters << 40 | rows, side="left") - 1
        same = (k >= 0) & (self.run_keys[k] >> 40 == letters)
        inside = np.minimum(self.run_sizes[k], rows - (self.run_keys[k] & ((1 << 40) - 1)))
        return np.where(same, self.run_before[k] + inside, self.begins[letters])

    def earliest(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, earliest place of the same ``length`` bytes) for every such string, texts streamed side by side.

        Each text is read backwards. The range is first made longer to ``length`` letters, then, letter by letter,
        widened to the range that shares one letter less and made longer again.
        """
        ends = np.r_[self.starts[1:], self.rows] - 1
        n_strings = ends - self.starts - self.length + 1
        lanes = np.flatnonzero(n_strings > 0)
        lanes = lanes[np.argsort(-n_strings[lanes], kind="stable")]
        n_strings, at = n_strings[lanes], ends[lanes]
        low, high = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.rows)
        places, firsts = [], []
        for k in range(int((n_strings.max(initial=0) + self.length - 1) * (len(lanes) > 0))):
            if k >= self.length:
                live = int(np.searchsorted(-n_strings, -(k - self.length + 2), side="right"))
                low, high, at = low[:live], high[:live], at[:live]
                rank = np.searchsorted(self.parents, low, side="right")
                low = self.parents[rank - 1]
                high = np.where(rank < len(self.parents), self.parents[np.minimum(rank, len(self.parents) - 1)], self.rows)
            at = at - 1
            letters = self.codes[at].astype(np.int64)
            low, high = self.step(letters, low), self.step(letters, high)
            if k >= self.length - 1:
                places.append(at.astype(np.int32))
                firsts.append(self.samples[0][np.searchsorted(self.heads, low)].astype(np.int32))
        return (np.concatenate(places), np.concatenate(firsts)) if places else (np.empty(0, np.int64),) * 2


def _chunk(batches: Iterator[pa.RecordBatch], n_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Texts in chunks of about so many bytes: (chunk, ids, lengths, compressed bytes)."""
    import zstandard

    squeeze, task, nth = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
    for batch in common.pieces(batches, n_bytes=max(n_bytes, common.PIECE_BYTES)):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        ids, cut, held = batch.column("doc_id").to_pylist(), 0, 0
        for k, text in enumerate(texts):
            held += len(text)
            if held >= n_bytes or k == len(texts) - 1:
                own = texts[cut : k + 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([task << 32 | nth], pa.int64()),
                        pa.array([ids[cut : k + 1]], pa.list_(pa.int64())),
                        pa.array([[len(t) for t in own]], pa.list_(pa.int64())),
                        pa.array([squeeze.compress(b"".join(own))], pa.binary()),
                    ],
                    ["chunk", "ids", "lengths", "data"],
                )
                cut, held, nth = k + 1, 0, nth + 1


def _texts(lengths: list[int], data: bytes) -> list[bytes]:
    import zstandard

    whole = memoryview(zstandard.ZstdDecompressor().decompress(data))
    ends = np.cumsum(lengths)
    return [bytes(whole[e - n : e]) for e, n in zip(ends, lengths)]


def _strings(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def repeated_strings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row.

    Texts are UTF-8 bytes, NULL as empty. A byte goes when a string of ``length`` bytes that covers it also starts
    earlier: in a smaller id, or in the same text further left; overlapping strings count. NULL ids come before all
    others. Rows with equal ids are ordered by a hash of their text, then by where they were read. ``kept`` is what is
    left, as bytes, since a cut may fall inside a character. Texts shorter than ``length`` lose nothing.

    Anchors reach their buckets once per chunk, and equal segments once per chunk, however often they occur.
    """
    rows = keyed(docs, id_col, text_col)
    n_bytes = text_bytes(rows)
    n_buckets = bucket_count(n_bytes, BUCKET_BYTES, 64)
    chunk_bytes = min(max(CHUNK_BYTES, n_bytes // CHUNKS), MOST_CHUNK_BYTES)
    chunks = stage(rows.mapInArrow(trimmed(lambda batches: _chunk(batches, chunk_bytes)), "chunk long, ids array<long>, lengths array<long>, data binary"))

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lengths, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "lengths", "data"))):
                hashes = all_stretches(_texts(lengths, data), length)[3]
                keys, counts = np.unique(hashes, return_counts=True)
                packed = list(pack(buckets(keys, n_buckets), n_buckets, keys, counts > 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0] for p in packed], pa.int32()),
                        pa.array([chunk] * len(packed), pa.int64()),
                        pa.array([p[1] for p in packed], pa.binary()),
                        pa.array([p[2] for p in packed], pa.binary()),
                    ],
                    ["bucket", "chunk", "keys", "twice"],
                )

    def answer(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(k, np.uint64) for k in _strings(table, "keys")]
        keys, twice = np.concatenate(own), np.frombuffer(b"".join(_strings(table, "twice")), bool)
        order = np.argsort(keys, kind="stable")
        held = keys[order]
        more = np.r_[held[1:] == held[:-1], False] | np.r_[False, held[1:] == held[:-1]]
        again = twice.copy()
        again[order] |= more
        parts = np.split(again, np.cumsum([len(k) for k in own])[:-1])
        found = [k[p].tobytes() for k, p in zip(own, parts)]
        return pa.table({"chunk": table.column("chunk"), "keys": pa.array(found, pa.binary())})

    sent = chunks.select("chunk", "lengths", "data").mapInArrow(trimmed(send_anchors), "bucket int, chunk long, keys binary, twice binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "chunk long, keys binary")

    def send_segments(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        squeeze, out = zstandard.ZstdCompressor(level=1), []
        wanted = np.frombuffer(b"".join(_strings(right, "keys")), np.uint64)
        for chunk, ids, lengths, data in zip(*(_strings(left, c) for c in ("chunk", "ids", "lengths", "data"))):
            texts = _texts(lengths, data)
            owner, first, last, hashes = all_stretches(texts, length)
            use = np.isin(hashes, wanted)
            owner, first, last, hashes = owner[use], first[use], last[use], hashes[use]
            bucket = buckets(hashes, n_buckets)
            ties = np.array([int.from_bytes(hashlib.blake2b(t, digest_size=7).digest()) for t in texts], np.int64)
            orders = np.array([-(1 << 63) if i is None else i for i in ids], np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]) if len(order) else []
            for a, b in zip(cuts, np.r_[cuts[1:], len(order)]):
                own = order[a:b]
                held = [texts[o][f : e + length] for o, f, e in zip(owner[own].tolist(), first[own].tolist(), last[own].tolist())]
                known: dict[bytes, int] = {}
                which = np.array([known.setdefault(h, len(known)) for h in held], np.int64)
                meta = np.stack([hashes[own].view(np.int64), which, orders[owner[own]], ties[owner[own]], owner[own], first[own], last[own]])
                out.append((int(bucket[own[0]]), chunk, meta.tobytes(), np.array([len(h) for h in known], np.int64).tobytes(), squeeze.compress(b"".join(known))))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        columns = list(zip(*out)) or [()] * 5
        release()
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("bucket", "chunk", "meta", "lengths", "data"), columns, kinds)})

    segments = (
        chunks.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(send_segments, "bucket int, chunk long, meta binary, lengths binary, data binary")
    )

    def mark(table: pa.Table) -> pa.Table:
        chunks_of, metas, texts, at = [], [], [], 0
        distinct: dict[bytes, int] = {}
        for chunk, meta, lengths, data in zip(*(_strings(table, c) for c in ("chunk", "meta", "lengths", "data"))):
            own = np.frombuffer(meta, np.int64).reshape(7, -1)
            local = _texts(np.frombuffer(lengths, np.int64).tolist(), data)
            ranks = np.array([distinct.setdefault(t, len(distinct)) for t in local], np.int64)
            own = own.copy()
            own[1] = ranks[own[1]]
            metas.append(own)
            chunks_of.append(np.full(own.shape[1], chunk, np.int64))
        hashes, which, orders, ties, owner, first, last = np.concatenate(metas, axis=1)
        chunk = np.concatenate(chunks_of)
        texts = list(distinct)
        distinct.clear()
        # the first of equal segments stands for them; all strings of the others start earlier there
        by = np.lexsort((first, owner, chunk, ties, orders))
        lead_of = np.full(len(texts), -1, np.int64)
        seen_at = by[np.unique(which[by], return_index=True)[1]]
        lead_of[which[seen_at]] = seen_at
        copies = lead_of[which] != np.arange(len(which))
        spans = [np.stack([chunk[copies], owner[copies], first[copies], last[copies] + length])]
        # anchors with segments that differ: stream what they may share through an index of it all, in their order
        leads = by[~copies[by]]
        _, group, size = np.unique(hashes[leads], return_inverse=True, return_counts=True)
        leads = leads[size[group] > 1]
        anchor = np.unique(hashes[leads], return_inverse=True)[1]
        order = np.argsort(anchor, kind="stable")
        of_anchors = np.split(order, np.flatnonzero(np.diff(anchor[order])) + 1) if len(order) else []
        heads = leads[[own[0] for own in of_anchors]] if len(order) else leads
        places = anchor_places([texts[w] for w in which[heads]], hashes[heads].view(np.uint64), length)
        parts = np.zeros((len(leads), 2), np.int64)
        for own, place in zip(of_anchors, places):
            parts[own] = shared_parts([texts[w] for w in which[leads[own]].tolist()], place, length)
        may = parts[:, 1] > 0
        leads, anchor, parts = leads[may], anchor[may], parts[may]
        # one index holds whole anchors, as many as fit into ``INDEX_BYTES``
        of_anchor = np.bincount(anchor, parts[:, 1] - parts[:, 0]).astype(np.int64)
        batch = ((np.cumsum(of_anchor) - of_anchor) // INDEX_BYTES)[anchor]
        order = np.argsort(batch, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(batch[order])) + 1):
            if not len(own):
                continue
            index = RunIndex([texts[w][a:b] for w, (a, b) in zip(which[leads[own]].tolist(), parts[own].tolist())], length)
            place, earlier = index.earliest()
            place = place[earlier < place]
            del earlier
            text = np.searchsorted(index.starts, place, side="right") - 1
            shift = place - index.starts[text]
            lead = leads[own[text]]
            start = first[lead] + parts[own[text], 0] + shift
            order = np.lexsort((start, lead))
            lead, start = lead[order], start[order]
            fresh = np.r_[True, (lead[1:] != lead[:-1]) | (start[1:] > start[:-1] + length)][: len(lead)]
            cuts = np.flatnonzero(fresh)
            ends = np.r_[cuts[1:], len(lead)] - 1
            spans.append(np.stack([chunk[lead[cuts]], owner[lead[cuts]], start[cuts], start[ends] + length]) if len(cuts) else spans[0][:, :0])
            del index, place, text, shift, start, lead
        del texts
        release()
        spans = np.concatenate(spans, axis=1)
        order = np.argsort(spans[0], kind="stable")
        spans = spans[:, order]
        cuts = np.flatnonzero(np.r_[True, spans[0][1:] != spans[0][:-1]][: spans.shape[1]])
        parts = [spans[1:, a:b] for a, b in zip(cuts, np.r_[cuts[1:], spans.shape[1]])]
        return pa.table({"chunk": pa.array(spans[0][cuts], pa.int64()), "spans": pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())})

    marks = segments.groupBy("bucket").applyInArrow(mark, "chunk long, spans binary")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        spans = [np.frombuffer(s, np.int64).reshape(3, -1) for s in _strings(right, "spans")]
        owner, start, end = np.concatenate(spans, axis=1) if spans else np.empty((3, 0), np.int64)
        order = np.lexsort((start, owner))
        owner, start, end = owner[order], start[order], end[order]
        for ids, lengths, data in zip(*(_strings(left, c) for c in ("ids", "lengths", "data"))):
            low = np.searchsorted(owner, np.arange(len(ids) + 1))
            for k, (doc_id, text) in enumerate(zip(ids, _texts(lengths, data))):
                s, e = start[low[k] : low[k + 1]], np.maximum.accumulate(end[low[k] : low[k + 1]])
                opens = np.flatnonzero(np.r_[True, s[1:] > e[:-1]][: len(s)])
                s, e = s[opens], e[np.r_[opens[1:], len(e)] - 1] if len(opens) else e
                left_over = b"".join([text[a:b] for a, b in zip(np.r_[0, e], np.r_[s, len(text)])]) if len(s) else text
                out.append((doc_id, len(text), len(text) - len(left_over), len(s), hashlib.sha256(left_over).hexdigest(), left_over))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, list(zip(*out)) or [()] * 6, kinds)})

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(cut, kind)
