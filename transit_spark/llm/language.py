"""Language by cross-parsing entropy.

A suffix automaton per language recognises every substring of a sample of labelled text. A text is cut greedily into
the longest stretches that a language's automaton knows; the language that needs the fewest stretches, normalised by
the logarithm of its sample's length and by the text's length, wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transit_spark.llm.common import SMALL_PIECE_BYTES, kept, keyed, mix64, pieces

#: Bounds of the training sample, per language: so many documents, so many characters of each and of all together.
SAMPLE_DOCS = 96
SAMPLE_DOC_CHARS = 2_000
SAMPLE_CHARS = 30_000
#: Parsing starts anew at every so many characters, so that long texts are parsed side by side.
STRETCH = 512
#: So many letters of the sample have a code of their own; further ones share ``SHARED_CODES`` by a hash.
LETTERS = 60
SHARED_CODES = 64
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text is a multiple of 5; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Text per language from rows that have a label and are not held out: a seeded choice of a bounded size.

    The choice reads ids and labels only; the texts of the chosen rows are fetched after it.
    """
    rows = keyed(docs, id_col, text_col, lang=lang_col).where("text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE_DOCS)
    texts = rows.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"]).select("lang", "nth", F.substring("text", 1, SAMPLE_DOC_CHARS).alias("text"))
    sample: dict[str, list] = {}
    for lang, nth, text in texts.collect():
        sample.setdefault(lang, []).append((nth, text))
    return {lang: "\n".join(t for _, t in sorted(own))[:SAMPLE_CHARS] for lang, own in sorted(sample.items())}


def suffix_automaton(codes: np.ndarray, alphabet: int) -> np.ndarray:
    """Transitions of the minimal automaton of all substrings: table[state, code], -1 where there is none."""
    links, lengths, moves, last = [-1], [0], [{}], 0
    for c in codes.tolist():
        now = len(links)
        links.append(0)
        lengths.append(lengths[last] + 1)
        moves.append({})
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = now
            p = links[p]
        if p != -1:
            q = moves[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[now] = q
            else:
                copy = len(links)
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                moves.append(dict(moves[q]))
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = links[p]
                links[q] = links[now] = copy
        last = now
    table = np.full((len(moves), alphabet), -1, np.int32)
    for state, own in enumerate(moves):
        table[state, list(own)] = list(own.values())
    return table


class CrossParser:
    """Automata of all languages in one table, and the parse of many texts at once."""

    def __init__(self, sample: dict[str, str]):
        self.langs = sorted(sample)
        counts: dict[str, int] = {}
        for text in sample.values():
            for c in text:
                c = c.lower()[0]
                if c.isalpha():
                    counts[c] = counts.get(c, 0) + 1
        known = sorted(counts, key=lambda c: (-counts[c], c))
        code = {c: k + 2 for k, c in enumerate(known[:LETTERS])}  # 0: no letter, 1: a letter that no sample has
        shared = mix64(np.array([ord(c) for c in known[LETTERS:]], np.uint64)) % np.uint64(SHARED_CODES)
        code.update(zip(known[LETTERS:], (LETTERS + 2 + shared.astype(int)).tolist()))
        self.codes = np.fromiter(
            (code.get(chr(p).lower()[0], 1) if chr(p).isalpha() else 0 for p in range(0x110000)), np.uint8, 0x110000
        )
        self.pad = max(code.values(), default=1) + 1
        width, tables, at, self.weights = self.pad + 1, [], 0, []
        self.start = []
        for lang in self.langs:
            text, _ = self.normalised([sample[lang]])
            table = suffix_automaton(text, width)
            restart = np.where(table[0] >= 0, table[0], 0)
            table = np.where(table >= 0, table + at, ~(restart + at)[None, :])
            table[:, self.pad] = np.arange(len(table)) + at
            # targets as places of their rows; a negative one says that a stretch ended before this letter
            tables.append(np.where(table >= 0, table * width, ~(~table * width)).astype(np.int32))
            self.start.append(at * width)
            self.weights.append(math.log2(max(2, len(text))))
            at += len(table)
        self.table = np.concatenate(tables).ravel() if tables else np.empty(0, np.int32)

    def normalised(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, runs of other characters as one space, each text behind a space; their lengths."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(t) for t in texts])
        own = self.codes[points]
        codes = np.insert(own, np.r_[0, ends[:-1]].astype(np.int64), 0) if texts else own
        begin = np.r_[0, ends[:-1]].astype(np.int64) + np.arange(len(texts))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        keep[begin] = True
        return codes[keep], np.add.reduceat(keep, begin) if texts else np.empty(0, np.int64)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised phrases, by text and language, and whether a text has a letter."""
        codes, lengths = self.normalised(texts)
        begin = np.cumsum(lengths) - lengths
        lettered = np.add.reduceat(codes > 0, begin) > 0
        lanes = -(-lengths // STRETCH)
        owner = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        first = begin[owner] + nth * STRETCH
        size = np.minimum(STRETCH, lengths[owner] - nth * STRETCH)
        order = np.argsort(-size, kind="stable")  # lanes that have ended are left out
        first, size, owner = first[order], size[order], owner[order]
        state = np.repeat(np.array(self.start, np.int32)[:, None], len(owner), axis=1)
        phrases = np.ones(state.shape, np.int32)
        active = np.searchsorted(-size, -np.arange(STRETCH), side="left")
        for k in range(int(size.max(initial=0))):
            n = int(active[k])
            step = self.table.take(state[:, :n] + codes[first[:n] + k].astype(np.int32))
            ended = step >> 31
            phrases[:, :n] -= ended
            state[:, :n] = step ^ ended
        total = np.zeros((len(self.langs), len(texts)))
        for k in range(len(self.langs)):
            total[k] = np.bincount(owner, phrases[k], len(texts)) * self.weights[k]
        return (total / lengths).T, lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score: the runner-up's share of both entropies, twice less one; 1 without a runner-up."""
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        there = [k for k, t in enumerate(texts) if t]
        if not there or not self.langs:
            return langs, scores
        found, lettered = self.entropies([texts[k] for k in there])
        best = found.argmin(axis=1)
        low = np.sort(found, axis=1)
        share = 2 * low[:, 1] / (low[:, 0] + low[:, 1]) - 1 if len(self.langs) > 1 else np.ones(len(there))
        for k, b, s, good in zip(there, best, share, lettered):
            if good:
                langs[k], scores[k] = self.langs[b], s
        return langs, scores


def cross_parser(sample: dict[str, str]) -> CrossParser:
    """One per Python worker and sample."""
    return kept("language", tuple(sample.items()), lambda: CrossParser(sample))


def identify(docs: DataFrame, sample: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from the whole text alone; nothing is shuffled.

    ``und`` with score 0 where a text is NULL or has no letter, or where no language was learned. Equal entropies go
    to the first language by name.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            langs, scores = cross_parser(sample).predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return keyed(docs, id_col, text_col).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def identified_rows(docs: DataFrame, sample: dict[str, str], text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The rows whose language was found with at least this score, with all their columns."""
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, SMALL_PIECE_BYTES):
            langs, scores = cross_parser(sample).predict(batch.column(text_col).to_pylist())
            yield batch.filter(pa.array([lang != UNDETERMINED and s >= least for lang, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(keep, schema)
