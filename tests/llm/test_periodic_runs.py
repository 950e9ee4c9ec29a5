import hashlib
import random
import time
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.conftest import corpus, frame
from transit_spark.llm import queries
from transit_spark.llm.periodic_runs import SquareCatcher, numbered, periodic_runs, planted_tail


def brute(x, least_words, least_periods):
    """Every period of every stretch."""
    found = {}
    for p in range(1, len(x) // least_periods + 1):
        i = p
        while i < len(x):
            if x[i] != x[i - p]:
                i += 1
                continue
            first = i
            while i < len(x) and x[i] == x[i - p]:
                i += 1
            if i - first + p >= max(least_words, least_periods * p):
                found.setdefault((first - p, i), p)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def caught(x, least_words=1, least_periods=3, step=None):
    catcher = SquareCatcher(len(x) if step is None else 0)
    for k in range(0, len(x), step or max(1, len(x))):
        catcher.extend(x[k : k + (step or len(x))])
    return catcher.runs(least_words, least_periods)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=150), st.integers(1, 9))
def test_random_words(x, step):
    assert caught(x) == brute(x, 1, 3) == caught(x, step=step)


def made(rng):
    """Words with runs inside runs, of periods small and large, with faults."""
    def part(depth):
        if not depth or rng.random() < 0.2:
            return [rng.randint(0, rng.choice([1, 2, 50])) for _ in range(rng.randint(1, 6))]
        own = part(depth - 1) + part(depth - 1)
        own = own * rng.randint(1, 7) + own[: rng.randint(0, len(own))]
        if rng.random() < 0.3:
            own[rng.randrange(len(own))] = 99
        return own[:700]

    return part(rng.randint(1, 5))


@pytest.mark.parametrize("seed", range(8))
def test_runs_within_runs(seed):
    rng = random.Random(seed)
    for _ in range(60):
        x = made(rng)
        assert caught(x) == brute(x, 1, 3)
        assert caught(x, 24, 3) == brute(x, 24, 3)
        assert caught(x, 1, 5) == brute(x, 1, 5)


def test_known_words():
    fib, more = [0], [0, 1]
    while len(more) < 900:
        fib, more = more, more + fib
    assert caught(more) == brute(more, 1, 3)
    for q in (1, 7, 8, 9, 63, 64, 65, 100):
        block = list(range(q))
        x = [-1] + block * 3 + block[: q // 2] + [-2]
        assert caught(x) == [(1, 3 * q + q // 2, q)] and caught(x[: 3 * q]) == ([] if q > 1 else [(1, 2, 1)][:0])
    powers = [0] * 100 + [1] + [0] * 100 + [1] + [0] * 100 + [1] + [0] * 99
    assert caught(powers, 24) == brute(powers, 24, 3)


def test_time_is_near_linear():
    """Texts of few words, equal words, and words a third of which are equal."""
    rng = random.Random(1)
    for x in ([0] * 60000, [0, 1] * 30000, [rng.randint(0, 1) for _ in range(60000)], ([0] * 500 + [1]) * 120, ([0] * 97 + [1] + [0] * 61 + [2]) * 375):
        start = time.time()
        caught(x)
        assert time.time() - start < 20


def plain(rows, least_words=24):
    out = []
    for doc_id, text, *_ in rows:
        ids, words = numbered((text or "").encode())
        ids = planted_tail(doc_id, ids)
        runs = brute(ids, least_words, 3)
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        kept = b" ".join(words[d] for i, d in enumerate(ids) if i not in gone)
        out.append(
            (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
            + (hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        )
    return sorted(out, key=str)


def cases():
    rows = [r[:2] for r in corpus() if len(r[1] or "") < 6000]
    rows += [(200 + k, " ".join(["la", "le", "lo", "li"][: 1 + k % 4] * 30) + "\n\nend") for k in range(40)]
    rows += [(300 + k, " ".join(f"w{i % (k + 2)}" for i in range(9 * k))) for k in range(40)]
    rows += [(None, "a " * 40), (None, None), (5, "  a a \x1c " * 30), (6, "x\x00y " * 25)]
    return rows


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(*r, None, None, 0) for r in cases()]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12(spark, str(tmp_path))
    assert found.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    got, want = sorted((tuple(r) for r in found.collect()), key=str), plain(rows)
    assert got == want and sum(r[1] > 0 for r in want) > 30


def test_planted_tails_follow_the_statement():
    for doc_id in range(400):
        words = list(range(doc_id % 37))
        h = zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        want = words
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [w if i < a else a + (i - a) % p for i, w in enumerate(words)]
        assert planted_tail(doc_id, words) == want


def test_texts_and_spans(spark):
    rows = [(1, "a b " * 12 + "c", None, None), (2, None, None, None), (2, "", None, None), (None, "z", None, None)]
    got = {(r.doc_id, r.n_words, r.collapsed, tuple(map(tuple, r.runs))) for r in periodic_runs(frame(spark, rows)).collect()}
    assert got == {(1, 25, "a b c", ((0, 24, 2),)), (2, 0, "", ()), (None, 1, "z", ())}
    assert periodic_runs(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(frame(spark, rows), least_periods=2)
