import math
import random
from fractions import Fraction

import numpy as np
import pytest

from transit_spark.llm import queries
from transit_spark.llm.whitening import fit, fit_list, whitened_rows, whole_vectors

KIND = "vec_id long, embedding array<double>, x string, k string, w string, n string"


def table(spark, vectors):
    return spark.createDataFrame([(k, v, "a", "b", "c", "d") for k, v in vectors], KIND).repartition(3)


def usable(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


def exact(vectors, size):
    """(rows, n, sums, covariance) in fractions."""
    rows = [(k, tuple(math.floor(256 * c) for c in v)) for k, v in vectors if usable(v) and len(v) == size]
    own = sorted({x for _, x in rows})
    n, sums = len(own), [sum(c) for c in zip(*own)]
    cov = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in own), n**3) for j in range(size)] for i in range(size)]
    return rows, own, sums, cov


def check(found, vectors, size, parts):
    rows, own, sums, cov = exact(vectors, size)
    n, v = len(own), np.array([[float(c) for c in r] for r in cov])
    values = np.linalg.eigvalsh(v)[::-1]
    got = found.collect()
    assert sorted((r.vec_id or -1, r.component) for r in got) == sorted((k or -1, c) for k, _ in rows for c in range(1, parts + 1))
    deviation = {}
    for k, x in rows:
        away = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        deviation.setdefault(k, set()).add(away if away < 1 << 63 else None)
    assert all(r.n == n and r.deviation in deviation[r.vec_id] for r in got)
    assert all(r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) for r in got)
    assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-6
    # axes: apart from the sign, the same for all rows
    vectors_, columns = np.linalg.eigh(v)
    for c in range(1, parts + 1):
        axis = columns[:, -c] / np.sqrt(values[c - 1])
        want = sorted((k or -1, float(np.dot([float(a - Fraction(s, n)) for a, s in zip(x, sums)], axis))) for k, x in rows)
        have = sorted((r.vec_id or -1, r.whitened) for r in got if r.component == c)
        flipped = sorted((k, -w) for k, w in want)
        assert np.allclose([w for _, w in have], [w for _, w in want], atol=1e-6) or np.allclose(
            [w for _, w in have], [w for _, w in flipped], atol=1e-6
        )


def some(seed=3, size=6, offset=0.0):
    rng = random.Random(seed)
    vectors = [(k, [offset + rng.gauss(0, 1 + 2 * j) for j in range(size)]) for k in range(120)]
    vectors += [(200 + k, vectors[0][1]) for k in range(60)]  # copies
    vectors += [(300, None), (301, [None] * size), (302, [float("nan")] * size), (303, [float("inf")] * size), (304, [])]
    vectors += [(305, [1.0] * (size + 1)), (None, vectors[1][1]), (7, vectors[2][1]), (310, [offset or -0.0] * size)]
    return vectors


@pytest.mark.parametrize("size,offset", [(6, 0.0), (6, 1e6), (2, -30.0), (5, 3e9)])
def test_rows_equal_fractions(spark, size, offset):
    vectors = some(size=size, offset=offset)
    found = whitened_rows(table(spark, vectors)).withColumnRenamed("doc_id", "vec_id")
    if offset < 1e9:
        check(found, vectors, size, min(4, size))
    else:  # deviations and sums still exact
        rows, own, sums, _ = exact(vectors, size)
        want = {k: sum((len(own) * a - s) ** 2 for a, s in zip(x, sums)) for k, x in rows if k != 7}
        got = {r.vec_id: r.deviation for r in found.collect()}
        assert all(got[k] == (d if d < 1 << 63 else None) for k, d in want.items()) and got[0] is not None


def test_covariance_is_exact_for_very_large_entries(spark):
    rng = random.Random(1)
    vectors = [(k, [rng.gauss(0, 1e13) for _ in range(3)]) for k in range(30)] + [(99, [1e300, 1.0, 2.0])]
    model = fit(fit_list(whole_vectors(table(spark, vectors[:-1]))))
    _, _, sums, cov = exact(vectors[:-1], 3)
    assert list(model.sums) == sums
    assert np.allclose((model.vectors * model.eigenvalues) @ model.vectors.T, [[float(c) for c in r] for r in cov], rtol=1e-12)
    assert whitened_rows(table(spark, vectors)).count() == 31 * 3  # 256e300 becomes the end of the longs


def test_ranks_and_empty_tables(spark):
    assert whitened_rows(table(spark, [])).count() == 0
    assert whitened_rows(table(spark, [(1, None), (2, [])])).count() == 0
    assert whitened_rows(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = [(k, [float(k), 2.0 * k, 5.0]) for k in range(20)]
    assert {r.component for r in whitened_rows(table(spark, flat)).collect()} == {1}
    assert whitened_rows(table(spark, [])).columns == "doc_id component n deviation whitened explained identity_error".split()


def test_query(spark, tmp_path):
    vectors = some(9, 8)
    spark.createDataFrame([(k, v, 1) for k, v in vectors], "vec_id long, embedding array<float>, label int").write.parquet(
        f"{tmp_path}/embeddings.parquet"
    )
    stored = [(k, v and [c if c is None else float(np.float32(c)) for c in v]) for k, v in vectors]
    found = queries.op13(spark, str(tmp_path))
    assert dict(found.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
        "whitened": "double", "explained": "double", "identity_error": "double",
    }
    check(found, stored, 8, 4)
