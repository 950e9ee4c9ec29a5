"""Periodic runs of words, caught online as squares over power-of-two blocks.

A run is a stretch of words with smallest period ``q`` that no neighbouring word extends. Words are appended one by one.
Periods under 8 are compared with every word. For the others, blocks of ``B`` = 4, 8, 16, ... words, at steps of
``B / 2``, are watched once they are completed: when the last ``B`` words equal a block that lies ``p`` words before
them, with ``2B <= p < 4B``, the two suffixes are compared back to where they differ, and every word appended from then
on advances that comparison. After ``p`` words that agree each further one completes a square of period ``p``; squares
of one period in a row merge into a run.

Blocks of period ``B / 4`` or less are not watched: copies of them would be everywhere. Neighbouring blocks overlap by
half, so if all blocks in two periods of a run were such, they would lie in one run of that smaller period, which would
then be the run's own. So every run of three periods or more is caught, by the end of its third period, and a word costs
a bounded number of steps on each of the ``log n`` levels. Runs of fewer than three periods are not promised.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transit_spark.llm.common import keyed, pieces

#: A run counts from so many words and so many periods on.
LEAST_WORDS = 24
LEAST_PERIODS = 3

SMALL = 8
MODULUS = (1 << 61) - 1
BASE = 0x1F3D5B79A2C4E687 % MODULUS
#: Texts are cut into words in parts of about this many bytes.
CUT_BYTES = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id {id}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class SquareCatcher:
    """Reads numbered words; ``runs`` tells what has been caught when all are appended.

    ``expected`` is the number of words to come, as a guess: it sizes the table of marks, which costs time only.
    """

    def __init__(self, expected: int = 0):
        self.words: list[int] = []
        self.agreeing: dict[int, int] = {}  # period: first word of the stretch that equals the words a period before
        self.found: dict[tuple[int, int], int] = {}  # (first word, word behind the last): smallest period
        self.seen = bytearray(1 << max(8, (8 * expected).bit_length()))  # a mark for every four words in a row so far
        self.last: dict[int, int] = {}  # where each word was last
        self.streak = 0  # so many words up to here ended four words that may have been there before
        self.prefix = array("Q", [0])  # of every prefix, as far as needed, its value as a number to BASE
        self.powers: dict[int, int] = {}
        self.blocks: dict[int, list] = {}  # size of blocks: where the next one starts, the hashes of those before

    def extend(self, words: list[int]) -> None:
        x, agreeing, seen, last = self.words, self.agreeing, self.seen, self.last
        mask, streak, push = len(seen) - 1, self.streak, x.append
        a, b, c = [-1, -1, -1, *x[-3:]][-3:]
        for at, d in enumerate(words, len(x)):
            push(d)
            if agreeing:
                for p in [p for p in agreeing if x[at - p] != d]:
                    self._close(p, at)
            before = last.get(d)
            last[d] = at
            if before is not None and at - before < SMALL:
                for p in range(at - before, min(SMALL, at + 1)):
                    if x[at - p] == d and p not in agreeing:
                        agreeing[p] = at
            mark = hash((a, b, c, d)) & mask
            if seen[mark]:
                streak += 1
                if before is not None:
                    self._catch(at, streak)
            else:
                seen[mark] = 1
                streak = 0
            a, b, c = b, c, d
        self.streak = streak

    def _catch(self, at: int, streak: int) -> None:
        """Compare the last words with the watched blocks of every level that can match after such a streak.

        Words that equal a block of one level equal, in their later half, a block of the level below, so the search
        ends at the first level without such a block.
        """
        x, agreeing, d, size = self.words, self.agreeing, self.words[at], 4
        # of every period that holds now, the sizes for which the last words are such a block
        unwatched = [(4 * q, at + 1 - first + q) for q, first in agreeing.items()]
        while size - 3 <= streak and 3 * size <= at + 1:
            top = max([most for least, most in unwatched if least <= size <= most], default=0)
            if top:
                size = 1 << top.bit_length()
                continue
            here, half = at + 1 - size, size >> 1
            if size > 4 and self._hash(here, size) not in self._watched(size, at + 1):
                return
            for block in range((here - 2 * size) // half * half, max(-1, here - 4 * size), -half):
                if x[block] == x[here] and x[block + size - 1] == d and here - block not in agreeing:
                    if size < 16 or self._hash(block, size) == self._hash(here, size):
                        if x[block : block + size] == x[here : at + 1]:
                            self._open(here - block, here)
            size *= 2

    def _watched(self, size: int, end: int) -> set[int]:
        """Hashes of all blocks of a level that end by ``end``; new ones are added when the level is first asked."""
        level = self.blocks.setdefault(size, [0, set()])
        for start in range(level[0], end - size + 1, size >> 1):
            level[1].add(self._hash(start, size))
            level[0] = start + (size >> 1)
        return level[1]

    def _hash(self, start: int, size: int) -> int:
        prefix = self.prefix
        if start + size >= len(prefix):
            value, x = prefix[-1], self.words
            for k in range(len(prefix) - 1, len(x)):
                value = (value * BASE + x[k] + 1) % MODULUS
                prefix.append(value)
        power = self.powers.get(size) or self.powers.setdefault(size, pow(BASE, size, MODULUS))
        return (prefix[start + size] - prefix[start] * power) % MODULUS

    def _open(self, p: int, first: int) -> None:
        """A stretch of period ``p``, from where the suffixes differ when compared back."""
        x = self.words
        while first > p and x[first - 1] == x[first - 1 - p]:
            first -= 1
        self.agreeing[p] = first

    def _close(self, p: int, end: int) -> None:
        """The stretch ends: its squares are one run, kept if it has three periods."""
        first = self.agreeing.pop(p)
        if end - first >= (LEAST_PERIODS - 1) * p:
            run = (first - p, end)
            self.found[run] = min(p, self.found.get(run, p))

    def runs(self, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run long enough, by start and period; the words end here."""
        for p in list(self.agreeing):
            self._close(p, len(self.words))
        found = [(s, e - s, p) for (s, e), p in self.found.items() if e - s >= max(least_words, least_periods * p)]
        return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(data: bytes) -> tuple[list[int], list[bytes]]:
    """The words of a text as numbers by first occurrence, and the word of each number."""
    number, ids, at = {}, [], 0
    while at < len(data):
        cut = SPACE.search(data, at + CUT_BYTES)
        end = cut.start() if cut else len(data)
        ids += [number.setdefault(w, len(number)) for w in data[at:end].split()]
        at = end
    return ids, list(number)


def collapsed_words(ids: list[int], runs: list[tuple[int, int, int]]) -> list[int]:
    """The words without those that any run has after its first period."""
    if not runs:
        return ids
    gone = bytearray(len(ids))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return [d for d, g in zip(ids, gone) if not g]


def planted_tail(doc_id: int | None, ids: list[int]) -> list[int]:
    """The stated trial change: about every tenth text repeats a block of its own words to its end; NULL ids never."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not ids:
        return ids
    g, n = h // 10, len(ids)
    a = g % n
    block = ids[a : a + 1 + (n - a) // (3 + g % 8)]
    return ids[:a] + (block * ((n - a) // len(block) + 1))[: n - a]


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
    rewrite: Callable[[int | None, list[int]], list[int]] | None = None,
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row, where the text lies: nothing is shuffled.

    ``runs`` are those of at least ``least_words`` words and ``least_periods`` (3 or more) periods, by start and
    period. ``collapsed`` is the text without the words that any run has after its first period, joined by single
    spaces. A NULL, empty or blank text has no words, no runs and an empty collapsed text. Rows with NULL or repeated
    ids are each returned; an empty table gives no rows; other columns are not read. Of stretches found under several
    periods the smallest counts. A text is held by one task, with up to about 100 bytes a word. ``rewrite`` may change the
    word numbers of a text before runs are sought.
    """
    if least_periods < LEAST_PERIODS:
        raise ValueError(f"runs of fewer than {LEAST_PERIODS} periods are not caught")
    rows = keyed(docs, id_col, text_col)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sizes, runs, texts = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids, words = numbered(text.as_buffer().to_pybytes() if text.is_valid else b"")
                if rewrite:
                    ids = rewrite(doc_id, ids)
                catcher = SquareCatcher(len(ids))
                catcher.extend(ids)
                own = catcher.runs(least_words, least_periods)
                sizes.append(len(ids))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                texts.append(b" ".join([words[d] for d in collapsed_words(ids, own)]).decode())
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(found, SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString()))


def strongest(runs: str = "runs") -> Column:
    """Of an array of runs the one with the greatest length / period, compared exactly; the first of equals."""
    return F.expr(
        f"""aggregate({runs}, {runs}[0], (best, r) -> if(r.length * best.period > best.length * r.period, r, best))"""
    )


def run_lines(runs: str = "runs") -> Column:
    """One line ``start,length,period`` for each run."""
    return F.expr(f"concat_ws('', transform({runs}, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
