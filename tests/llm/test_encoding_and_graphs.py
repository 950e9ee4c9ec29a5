import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from transit_spark.llm import small_world, token_files
from transit_spark.llm.queries import vocabulary


@pytest.mark.parametrize("before,after", [("a", "."), ("", ":"), ("", "!?"), (".", "b;"), ("", "")])
def test_every_code_point_as_the_library_has_it(before, after):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    encoder, library = token_files.WordEncoder(path), Tokenizer.from_file(path)
    letters = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000] + [chr(sys.maxunicode)]
    for a in range(0, len(letters), 30_000):
        texts = [before + x + after for x in letters[a : a + 30_000]]
        got = [ids.tolist() for ids in encoder.encode(texts)]
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert got == want, next((t, g, w) for t, g, w in zip(texts, got, want) if g != w)


def test_encoder_with_a_cache_that_is_full():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    encoder, library = token_files.WordEncoder(path, words=3), Tokenizer.from_file(path)
    for text in ("İstanbul: one two", "one. two. <|end|> Three", "", " \t", "four five six seven one."):
        assert encoder.encode([text, text])[1].tolist() == library.encode(text, add_special_tokens=False).ids


def planted(n=6000, size=32):
    """Unit vectors of which a third has near partners, and the links of brute force."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(n * 2 // 3, size))
    near = base[rng.integers(0, 300, n - len(base))]
    near = near + rng.normal(size=near.shape) * 0.3 * rng.random((len(near), 1))
    return np.r_[base, near]


def test_recall_against_brute_force(spark):
    vectors = planted()
    unit = small_world.unit(vectors)
    links, union = np.zeros(len(unit), np.int64), brute.Union()
    for a in range(0, len(unit), 500):
        q, v = np.nonzero(unit[a : a + 500] @ unit.T >= 0.9)
        for x, y in zip((q + a).tolist(), v.tolist()):
            if x != y:
                links[x] += 1
                union.join(x, y)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = small_world.near_vectors(df).orderBy("vec_id").collect()
    found = np.array([r.n_links for r in got])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum() > 1000
    same = sum(r.component_id == union.find(r.vec_id) for r in got)
    assert same >= 0.99 * len(got)

    audits = small_world.shard_graphs(small_world.distinct_vectors(df.select("vec_id", F.col("embedding").alias("v")))).collect()
    assert len(audits) == small_world.SHARDS and sum(r.links for r in audits) > small_world.AUDIT_ROWS
    assert all(r.found >= small_world.AUDIT_RECALL * r.links and r.beam >= small_world.BEAM for r in audits)


def test_null_and_repeated_ids(spark):
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, one, "a"), (1, one, "b"), (None, one, "c"), (2, two, "d"), (3, one, "e"), (None, None, "f"), (4, [1.0, 0.01, 0.0], "g")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, path string").withColumn("shard", F.lit("x"))
    got = sorted(map(str, map(tuple, small_world.near_vectors(df).collect())))
    assert got == sorted(
        map(str, [(1, 3, 1, True), (1, 3, 1, True), (None, 0, None, True), (2, 0, 2, True), (3, 3, 1, False), (None, 0, None, True), (4, 3, 1, False)])
    )
