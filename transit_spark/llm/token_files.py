"""Token ids in fixed-width bit-packed files.

An id takes the fewest bits that hold the vocabulary. Ids lie in blocks of ``BLOCK_IDS``; the file's tail lists the
offset of every block and the documents, so numpy unpacks whole blocks and any range of ids is read alone.

Layout: ``b"IDPK"``, width (u8), 3 spare bytes, ids per block (u32); the blocks, bits little-endian; block offsets
(u64 each); documents (id i64, has-id u8, number of ids u64 each, column by column); tail: place of the offsets,
number of blocks, of documents and of ids (u64 each).
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transit_spark.llm.common import keyed, pieces, qualified
from transit_spark.session import stage

MAGIC = b"IDPK"
BLOCK_IDS = 1 << 16
FILE_BYTES = 64 << 20
CACHE_WORDS = 700_000
END_ID = 2
_HEAD, _TAIL = struct.Struct("<4sB3xI"), struct.Struct("<QQQQ")


def width_of(vocabulary: int) -> int:
    """Bits that hold every id of the vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, width: int) -> bytes:
    """Ids as a little-endian bit string, the last byte filled up with zeros."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_ids(data: bytes, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a bit string."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1).astype(np.uint32)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class IdWriter:
    """Writes one file under a passing name and moves it into place, so a second attempt at a task does no harm."""

    def __init__(self, path: str, width: int, attempt: int):
        self.path, self.width = path, width
        self.fs, self.inner = file_system(path)
        folder, name = os.path.split(self.inner)
        self.fs.create_dir(folder)
        self.passing = f"{folder}/.{name}.{attempt}"
        self.out = self.fs.open_output_stream(self.passing)
        self.out.write(_HEAD.pack(MAGIC, width, BLOCK_IDS))
        self.place, self.n_ids, self.held = _HEAD.size, 0, []
        self.offsets, self.docs, self.counts = [], [], []

    def _block(self, ids: np.ndarray) -> None:
        data = pack_ids(ids, self.width)
        self.offsets.append(self.place)
        self.out.write(data)
        self.place += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.n_ids += len(ids)
        self.held.append(ids)
        if sum(map(len, self.held[-1:])) and self.n_ids - len(self.offsets) * BLOCK_IDS >= BLOCK_IDS:
            ids = np.concatenate(self.held)
            whole = len(ids) // BLOCK_IDS * BLOCK_IDS
            for a in range(0, whole, BLOCK_IDS):
                self._block(ids[a : a + BLOCK_IDS])
            self.held = [ids[whole:]]

    def close(self) -> tuple[str, int, int]:
        rest = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        if len(rest):
            self._block(rest)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.out.write(np.array([d is not None for d in self.docs], "u1").tobytes())
        self.out.write(np.array(self.counts, "<u8").tobytes())
        self.out.write(_TAIL.pack(self.place, len(self.offsets), len(self.docs), self.n_ids))
        self.out.close()
        self.fs.move(self.passing, self.inner)
        return self.path, self.n_ids, len(self.docs)


class IdReader:
    """Random access to one file: only the blocks that hold the wanted ids are read."""

    def __init__(self, path: str):
        system, inner = file_system(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        magic, self.width, self.block_ids = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of packed ids")
        place, n_blocks, n_docs, self.n_ids = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        table = self.file.read_at(size - _TAIL.size - place, place)
        self.offsets = np.r_[np.frombuffer(table, "<u8", n_blocks), [place]].astype(np.int64)
        at = 8 * n_blocks
        ids = np.frombuffer(table, "<i8", n_docs, at)
        known = np.frombuffer(table, "u1", n_docs, at + 8 * n_docs)
        self.docs = [int(d) if k else None for d, k in zip(ids, known)]
        self.counts = np.frombuffer(table, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.held = (-1, np.empty(0, np.uint32))

    def block(self, k: int) -> np.ndarray:
        """The ids of one block; the last one read is kept, so documents in a row read each block once."""
        if self.held[0] != k:
            data = self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
            self.held = (k, unpack_ids(data, self.width, min(self.n_ids - k * self.block_ids, self.block_ids)))
        return self.held[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the file."""
        if not n:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (start + n - 1) // self.block_ids
        parts = [self.block(k) for k in range(first, last + 1)]
        whole = parts[0] if len(parts) == 1 else np.concatenate(parts)
        return whole[start - first * self.block_ids :][:n]


class WordEncoder:
    """Ids of a text from a word-level cache over the library's encoder.

    The tokenizer drops white space and none of its patterns crosses it, so a text's ids are those of its stretches
    between ASCII white space, one after the other. Each stretch is encoded by the library once and kept. It lowers
    case, so A-Z are lowered first (except where a special token may stand), and a letter keeps apart from the
    punctuation behind it, so a stretch ending in such is put together from its two parts. Some letters are normalised
    to a letter and a mark, which goes with the punctuation; a stretch with such an end is encoded whole.

    Two generations of the cache are kept: when the young one is full it becomes the old one, from which words still in
    use come back without being encoded again.
    """

    TAIL = b".,;:!?#$%&*"

    def __init__(self, path: str, words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.cache, self.old = Tokenizer.from_file(path), words, {}, {}

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [(d if b"<|" in d else d.lower()).split() for d in map(str.encode, texts)]
        if len(self.cache) > self.words:
            self.cache, self.old = {}, self.cache
        missing = set().union(*split).difference(self.cache)
        if missing:
            self._learn(missing)
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<u4") for words in split]

    def _apart(self, core: bytes) -> bool:
        """Whether the text ends in a letter also once it is normalised."""
        last = core[-1]
        if last < 128:
            return 97 <= last <= 122 or 65 <= last <= 90
        return unicodedata.normalize("NFC", core.decode())[-1].lower()[-1].isalpha()

    def _learn(self, missing: set[bytes]) -> None:
        """Put these stretches into the cache; what no generation has is encoded, each part once."""
        cache, old, parts, new, tail_bytes = self.cache, self.old, {}, set(), self.TAIL
        for w in missing:
            known = old.get(w)
            if known is not None:
                cache[w] = known
                continue
            core = w.rstrip(tail_bytes)
            n = len(core)
            if 0 < n < len(w) and (97 <= core[-1] <= 122 or self._apart(core)):
                parts[w] = n
                for p in (core, w[n:]):
                    if p not in cache:
                        if p in old:
                            cache[p] = old[p]
                        else:
                            new.add(p)
            else:
                new.add(w)
        new = list(new)
        for a in range(0, len(new), 4096):
            part = new[a : a + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                ids = e.ids
                cache[w] = struct.pack(f"<{len(ids)}I", *ids)
        for w, n in parts.items():
            cache[w] = cache[w[:n]] + cache[w[n:]]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every text and write the ids, each document followed by ``end_id``, in ascending order of the ids.

    Texts are dealt out by ranges of the id, so the order of the files is the order of the documents; no task holds
    more than one text and one block. NULL and empty texts have the end id alone; NULL ids come first; rows with
    equal ids are ordered by a hash of their text. Returns one row per file: (path, file_start, n_ids, n_docs), where
    ``file_start`` counts the ids of all files before it.
    """
    folder = qualified(docs.sparkSession, folder)
    tie = F.xxhash64("text")
    ordered = keyed(docs, id_col, text_col).withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context, done, writer = None, TaskContext.get(), [], None
        for batch in pieces(batches):
            encoder = encoder or _encoder(tokenizer)
            width = width_of(max(encoder.vocabulary, end_id + 1))
            ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), ids):
                if writer is None:
                    name = f"ids-{context.partitionId():06d}-{len(done):04d}.idpk"
                    writer = IdWriter(f"{folder}/{name}", width, context.taskAttemptId())
                writer.add(doc_id, np.append(own, np.uint32(end_id)))
                if writer.place >= FILE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        rows = [(context.partitionId(), k, *f) for k, f in enumerate(done)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
            ["part", "nth", "path", "n_ids", "n_docs"],
        )

    files = stage(ordered.select("doc_id", "text").mapInArrow(write, "part int, nth int, path string, n_ids long, n_docs long"))
    start = F.expr("sum(n_ids) over (order by part, nth) - n_ids")
    return files.select("path", start.alias("file_start"), "n_ids", "n_docs")


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One per Python worker, so that its cache lasts over tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files themselves."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("file_start").to_pylist()):
                reader = IdReader(path)
                crc = [zlib.crc32(reader.ids(int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(reader.starts, reader.counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.docs, pa.int64()), pa.array(reader.starts + before), pa.array(reader.counts), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "file_start").repartition(tasks, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
