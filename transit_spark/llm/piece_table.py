"""SentencePiece BPE by a table of last tokens.

For BPE every prefix of a text has one last token. The table holds it: an automaton gives the pieces ending at a
place, and the one that is compatible with the last token of the prefix before it is taken. Ids are then read from
the end backwards. Two tokens are compatible when undoing their merges, latest first, never shows a merge across
their border that would have come earlier.

Words are independent of each other when no piece has a space mark behind another character; a text is then the
sequence of its words, and each word's ids are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from transit_spark.llm.common import kept, keyed, pieces

CACHE_WORDS = 400_000
MARK = "▁"


class PieceTable:
    """Encoder and decoder of one BPE model of the sentencepiece library, with byte fallback and no normalisation."""

    def __init__(self, path: str, words: int = CACHE_WORDS):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.words, self.cache, self.runs, self.pairs = words, {}, {}, {}
        self.text, self.byte_id, self.id, self.score = {}, {}, {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i], self.id[piece], self.score[i] = piece, i, model.get_score(i)
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        if any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p in self.id):
            raise ValueError("words are not independent in this model")
        if len(self.byte_id) != 256 or any(c not in self.id for p in self.id for c in p):
            raise ValueError("this model lacks single bytes or characters")
        # rank: the order of merges; the later the larger
        order = sorted(self.score, key=lambda i: (-self.score[i], i))
        self.rank = {i: n for n, i in enumerate(order)}
        self.split, self.automaton = {}, ahocorasick.Automaton()
        for piece, i in self.id.items():
            if len(piece) == 1:
                self.split[i] = None
            elif set(piece) != {MARK}:
                ends, last = self.merged([self.id[c] for c in piece])
                if len(ends) != 1:
                    continue  # never comes out of merging
                self.split[i] = last
            else:
                continue
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.bytes = {i: p.replace(MARK, " ").encode() for i, p in self.text.items()} | {i: bytes([b]) for i, b in self.byte_of.items()}

    def merged(self, ids: list[int]) -> tuple[list[int], tuple[int, int] | None]:
        """Merging pair by pair, best score first, leftmost of equals; for single pieces and runs of marks."""
        ids, last = list(ids), None
        while True:
            best = None
            for k in range(len(ids) - 1):
                i = self.id.get(self.text[ids[k]] + self.text[ids[k + 1]])
                if i is not None and (best is None or self.score[i] > best[0]):
                    best = (self.score[i], k, i)
            if best is None:
                return ids, last
            _, k, i = best
            last = (ids[k], ids[k + 1])
            ids[k : k + 2] = [i]

    def run(self, n: int) -> list[int]:
        """Ids of ``n`` space marks in a row.

        Runs have one common score, so merging grows the leftmost run first. A run that reached the longest piece
        stays, and the rest starts anew.
        """
        if n not in self.runs:
            longest = max(len(p) for p in self.id if set(p) == {MARK})
            whole, rest = divmod(n, longest)
            ids = [self.id[MARK * longest]] * whole + (self.merged([self.id[MARK]] * rest)[0] if rest else [])
            if len(self.runs) > 4096:
                self.runs.clear()
            self.runs[n] = ids
        return self.runs[n]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, stay as they are."""
        rank, split, text, ids = self.rank, self.split, self.text, self.id
        limit = len(rank) + 1  # merges of this rank and later have been undone
        while True:
            across = ids.get(text[left] + text[right])
            if across is not None and rank[across] < limit:
                return False
            a, b = split[left], split[right]
            if a is None and b is None:
                return True
            # undo the later merge; of equals the one on the right came later
            if b is None or (a is not None and rank[left] > rank[right]):
                limit, left = rank[left], a[1]
                # a merge across of equal rank starts further right than the one on the left
            else:
                limit, right = rank[right] + 1, b[0]
                # and further left than the one on the right, so it would have come first

    def word(self, text: str) -> list[int]:
        """Ids of one word; runs of marks only as its single first character."""
        out: list[int] = []
        start = 0
        for at, c in enumerate(text):
            if c not in self.id:
                if at > start:
                    out += self.known(text[start:at])
                out += [self.byte_id[b] for b in c.encode()]
                start = at + 1
        return out + self.known(text[start:]) if start < len(text) else out

    def known(self, text: str) -> list[int]:
        """Ids of a text whose characters are all pieces: forward table of last tokens, then back from the end."""
        n, pairs = len(text), self.pairs
        last = [0] * (n + 1)
        size = [0] * (n + 1)
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if size[end]:
                continue
            before = end - length
            if before:
                key = last[before] << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.compatible(last[before], token)
                if not fits:
                    continue
            last[end], size[end] = token, length
        if len(pairs) > 4 * self.words:
            pairs.clear()
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def look_up(self, word: str) -> tuple[bytes, bytes]:
        """A word behind its space mark: its ids as decimals with commas, and its decoded bytes."""
        ids: list[int] = []
        for k, part in enumerate(word.split("\n")):
            if k:
                ids.append(self.byte_id[10])
            if part or not k:
                ids += self.word(MARK + part if not k else part)
        found = self.cache[word] = (",".join(map(str, ids)).encode(), b"".join([self.bytes[i] for i in ids]))
        return found

    def encode_joined(self, text: str) -> tuple[bytes, bytes]:
        """Ids of a text as decimals joined by commas, and the bytes that its ids decode to, the added space included."""
        if not text:
            return b"", b""
        if len(self.cache) > self.words:
            self.cache.clear()
        words = text.replace(MARK, " ").split(" ")
        cache = self.cache
        if "" not in words:
            found = [cache.get(w) or self.look_up(w) for w in words]
        else:
            found, marks = [], 0
            for w in words:
                marks += 1
                if not w:
                    continue
                ids, shown = cache.get(w) or self.look_up(w)
                if marks > 1:
                    alone = ids.partition(b",")[0] == str(self.id[MARK]).encode()
                    run = self.run(marks if alone else marks - 1)
                    rest = ids.partition(b",")[2] if alone else ids
                    ids = ",".join(map(str, run)).encode() + (b"," + rest if rest else b"")
                    shown = b" " * (marks - 1) + shown
                found.append((ids, shown))
                marks = 0
            if marks:
                found.append((",".join(map(str, self.run(marks))).encode(), b" " * marks))
        return b",".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def encode(self, text: str) -> list[int]:
        joined, _ = self.encode_joined(text)
        return [int(i) for i in joined.split(b",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids that come from ``encode``; the added leading space goes."""
        data = b"".join([self.bytes[i] for i in ids])
        return (data[1:] if data.startswith(b" ") else data).decode(errors="replace")


def piece_table(path: str) -> PieceTable:
    """One per Python worker, so that its cache lasts over tasks."""
    return kept("pieces", path, lambda: PieceTable(path))


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of the input, whole texts; nothing is shuffled.

    NULL counts as empty: no ids. ``with_ids`` adds the ids and the decoded text themselves.
    """
    extra = ", ids array<int>, decoded string" if with_ids else ""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in pieces(batches):
            table = table or piece_table(model)
            rows = [table.encode_joined(t or "") for t in batch.column("text").to_pylist()]
            shown = [d[1:] for _, d in rows]
            columns = [
                batch.column("doc_id"),
                pa.array([ids.count(b",") + 1 if ids else 0 for ids, _ in rows], pa.int64()),
                pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in rows]),
                pa.array([hashlib.sha256(d).hexdigest() for d in shown]),
            ]
            if with_ids:
                columns.append(pa.array([[int(i) for i in ids.split(b",")] if ids else [] for ids, _ in rows], pa.list_(pa.int32())))
                columns.append(pa.array([d.decode(errors="replace") for d in shown]))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    return keyed(docs, id_col, text_col).mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
