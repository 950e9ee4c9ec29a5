import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import shingle_set
from transit_spark.llm import common, language, lines, links, mixing, partenum, run_index, token_files
from transit_spark.llm.common import fresh
from transit_spark.llm.queries import vocabulary


def pair_of_sets(rng, size, differ):
    """Two sets of about this size of which ``differ`` elements are in one only."""
    common = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    own = rng.integers(0, 1 << 63, differ, dtype=np.uint64)
    half = differ // 2
    return [np.unique(np.r_[common, own[:half]]), np.unique(np.r_[common, own[half:]])]


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("size", [30, 118, 240, 261, 400, 900, 3000])
def test_linked_sets_share_a_signature(percent, size):
    """At the very threshold, where sets differ most, also when no spare part may be used."""
    rng = np.random.default_rng(size)
    for _ in range(40):
        differ = (100 - percent) * size // percent
        one, other = pair_of_sets(rng, size, differ)
        common = len(np.intersect1d(one, other))
        assert 100 * common >= percent * (len(one) + len(other) - common)
        keys, owner = partenum.signatures([one, other], percent)
        assert np.intersect1d(keys[owner == 0], keys[owner == 1]).size


def test_signatures_without_elements_are_paid_for(monkeypatch):
    """With cells dealt so badly that most are empty, more than the spare ones, links are still kept."""
    deal = partenum._enumerated

    def poor(elements, owner, n_sets, parts, differ, joint, seed):
        # all elements in a few parts, the rest without any
        return deal(elements & np.uint64(0xFF), owner, n_sets, parts, differ, joint, seed)

    monkeypatch.setattr(partenum, "_enumerated", poor)
    rng = np.random.default_rng(3)
    for size in (300, 700):
        one, other = pair_of_sets(rng, size, 15 * size // 100)
        keys, owner = partenum.signatures([one, other], 85)
        assert np.intersect1d(keys[owner == 0], keys[owner == 1]).size


def test_every_row_has_the_size_of_its_own_set(spark):
    text = "a b c d e f g h i j"
    rows = [(1, "a b c d e f"), (1, text), (2, text), (None, text), (None, None), (3, " "), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in partenum.near_duplicates(df).collect()), key=str)
    assert got == sorted([(i, len(shingle_set(t, 4)), None if i is None else 1 if i == 2 else i) for i, t in rows], key=str)


def test_fresh_names():
    assert fresh(["a", "B", "b_"], "a", "b", "c", "c") == ["a_", "b__", "c", "c_"]


def test_columns_named_like_the_added_ones(spark):
    line = "one line that two documents share, word by word"
    rows = [(1, line + "\nfirst", "s"), (2, line + "\nsecond", "s"), (None, line, "t"), (3, None, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("__id", "__gone", "__removed", "__copies", "__nth", "__sources", "__ID"):
        df = df.withColumn(name, F.lit(name)) if name != "__ID" else df
    out = lines.dedup_lines(df)
    assert out.columns == [*df.columns, "__removed_"]
    assert {(r.doc_id, r.text, r["__removed"], r["__removed_"]) for r in out.collect()} == {
        (1, line + "\nfirst", "__removed", 0), (2, "second", "__removed", 1), (None, line, "__removed", 0), (3, None, "__removed", 0),
    }
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns and {r["__copies"] for r in mixed.collect()} == {"__copies"}


def test_copies_of_repeated_and_null_ids(spark):
    """Rows of one id go as often as the one taken most; rows without a word never."""
    rng = random.Random(1)
    rows = [(k, " ".join("w" * rng.randint(1, 3) for _ in range(20)), f"s{k % 3}") for k in range(60)]
    rows += [(0, "one two", "s0"), (None, "three four", "s1"), (None, "", "s1"), (None, None, "s1"), (70, " ", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(df, F.array("source")).where("size > 0")
    most = {}
    for r in taken.collect():
        most[r.doc_id] = max(most.get(r.doc_id, 0), int((r.taken + r["size"] / 2) // r["size"]))
    want = sorted((str(i), t) for i, t, _ in rows if t and t.strip() for _ in range(most[i]))
    assert sorted((str(r.doc_id), r.text) for r in mixing.mixed_rows(df).collect()) == want


def greedy(text, sample):
    """Phrases of a plain greedy parse: a letter that does not prolong a stretch of the sample begins the next one."""
    n, held = 1, ""
    for c in text:
        if held + c in sample:
            held += c
        else:
            n, held = n + 1, c if c in sample else ""
    return n


def test_phrases_equal_a_plain_greedy_parse():
    rng = random.Random(8)
    sample = {k: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(120)) for k, letters in (("x", "abcd"), ("y", "bcde"))}
    parser = language.CrossParser(sample)
    for _ in range(60):
        words = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 40)))
        got, _ = parser.entropies([words])
        for k, lang in enumerate(parser.langs):
            want = greedy(" " + words, " " + sample[lang]) * parser.weights[k] / (len(words) + 1)
            assert got[0, k] == pytest.approx(want)


def test_scripts_of_many_letters():
    """Two languages with more letters than have codes of their own; texts longer than one stretch."""
    rng = random.Random(2)
    letters = [[chr(0x4E00 + 3 * k + j) for k in range(150)] for j in (0, 1)]
    one, two = (["".join(rng.choice(own) for _ in range(3)) for _ in range(120)] for own in letters)

    def said(words, n):
        return " ".join(rng.choice(words) for _ in range(n))

    parser = language.CrossParser({"one": said(one, 700), "two": said(two, 700)})
    texts = [said(one, 30), said(two, 30), said(one, 900), said(two, 900), "abc", "12 !"]
    langs, scores = parser.predict(texts)
    assert langs[:4] == ["one", "two", "one", "two"] and langs[5] == "und" and min(scores[:4]) > 0


def test_a_worker_keeps_one_table_at_a_time():
    made = []

    def make(name):
        made.append(name)
        return [name]

    common._kept.clear()
    one = common.kept("language", "x", lambda: make("x"))
    assert common.kept("language", "x", lambda: make("x")) is one and made == ["x"]
    common.kept("pieces", "y", lambda: make("y"))
    assert list(common._kept) == [("pieces", "y")]  # what another operator left is gone
    common._kept.clear()


def test_components_grown_by_links_equal_components_of_all_links(spark):
    first = [(1, 2), (2, 3), (10, 11), (20, 21)]
    more = [(3, 11), (0, 20), (30, 31), (2, 1), (40, 40)]
    known = common.components(spark.createDataFrame(first, "a long, b long"))
    grown = links._grown(known, spark.createDataFrame(more, "a long, b long"))
    want = common.components(spark.createDataFrame(first + more, "a long, b long"))
    assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, want.collect()))


def shared_weight(keys, owner, a, b):
    """What the signatures that two sets share count for."""
    both = np.intersect1d(keys[owner == a], keys[owner == b])
    return int(np.where(both & np.uint64(1), partenum.SHARED, 1).sum())


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("size", [30, 75, 118, 150, 240, 261, 400, 900, 3000])
def test_linked_sets_share_as_many_signatures_as_pairs_must(percent, size):
    rng = np.random.default_rng(size + 1)
    for _ in range(40):
        one, other = pair_of_sets(rng, size, (100 - percent) * size // percent)
        keys, owner = partenum.signatures([one, other], percent)
        assert shared_weight(keys, owner, 0, 1) >= partenum.SHARED


def test_frequent_shingles_do_not_pair_all_their_documents():
    """290 elements of their own and 8 that all have: pairs that share a signature are many, those to verify are few."""
    rng = np.random.default_rng(5)
    frequent = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    sets = [np.unique(np.r_[frequent, rng.integers(0, 1 << 63, 290, dtype=np.uint64)]) for _ in range(200)]
    keys, owner = partenum.signatures(sets, 80)
    weights = np.where(keys & np.uint64(1), partenum.SHARED, 1)
    low = keys.astype(np.uint32)
    found, listed = {}, set()
    for k in range(64):
        own = keys >> np.uint64(58) == k
        for batch in links.split_groups(low[own], owner[own].astype(np.int64), weights[own]):
            for kind, a, b, _, n in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == "pair":
                    listed.add((a, b))
                    found[a, b] = found.get((a, b), 0) + n
    assert len(listed) > 200
    assert sum(n >= partenum.SHARED for n in found.values()) < len(listed) / 4


def test_workers_give_memory_back_and_drop_what_others_kept(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    assert list(common.trimmed(lambda batches: (x + 1 for x in batches))(iter([1, 2]))) == [2, 3] and calls == [1]
    partenum.word_hashes([b"one", b"two"])
    assert ("words", 0) in common._kept
    common.kept("pieces", "y", lambda: "y")
    assert list(common._kept) == [("pieces", "y")]
    common._kept.clear()


def test_an_index_takes_few_bytes_for_each_of_its_text():
    rng = np.random.default_rng(1)
    middle = bytes(rng.integers(97, 123, 90, np.uint8))
    texts = [bytes(rng.integers(97, 123, 70, np.uint8)) + middle + bytes(rng.integers(97, 123, 20, np.uint8)) for _ in range(1500)]
    tracemalloc.start()
    place, first = run_index.RunIndex(texts).earliest()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(place) == 81 * len(texts) and (first <= place).all()
    assert peak < 110 * sum(map(len, texts))


def test_every_word_is_looked_up_once():
    class Counted(dict):
        n = 0

        def __getitem__(self, key):
            Counted.n += 1
            return super().__getitem__(key)

        def get(self, key, default=None):
            Counted.n += 1
            return super().get(key, default)

    encoder = token_files.WordEncoder(vocabulary("word_bpe_49k.json"))
    texts = ["one two, three one two", "four five. one, été! two"]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoder.cache = Counted()
    assert [x.tolist() for x in encoder.encode(texts)] == want
    Counted.n = 0
    assert [x.tolist() for x in encoder.encode([*texts, "six one"])] == [*want, encoder.tokenizer.encode("six one", add_special_tokens=False).ids]
    assert Counted.n == 12


def test_empty_cells_are_filled_from_a_table_made_once():
    lines._turns.cache_clear()
    own = ["ab", "a line of some words", "x" * 40, "é" * 9]
    alone = np.concatenate([lines.band_keys([line]) for line in own])
    assert (lines.band_keys(own) == alone).all()
    assert lines._turns.cache_info().misses == 1
