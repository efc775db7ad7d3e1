from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillscope.llm import whitening
from tillscope.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, ids=None):
    rows = [(i, v, 0) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def whole(vectors):
    return np.floor(64 * np.asarray(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000


def by_definition(x, components=16):
    """Whole-number vectors: n, covariance matrix and the whitened rows, up to sign."""
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    away = fit - sums / n
    v = away.T @ away / n
    e, p = np.linalg.eigh(v)
    e, p = e[::-1][:components], p[:, ::-1][:, :components]
    return n, sums, v, e, (x - sums / n) @ p / np.sqrt(e)


def matrix(rows, name="whitened"):
    found = {}
    for r in rows:
        found.setdefault(r.vec_id, {})[r.component] = r[name]
    return np.array([[found[i][c] for c in sorted(found[i])] for i in sorted(found)], dtype=float)


def test_query_equals_brute_force(spark):
    source = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = whole(np.stack(source["embedding"].to_numpy()))
    rows = QUERIES["op11_whiten_embeddings"](spark, FOLDER).collect()
    n, sums, v, e, expected = by_definition(x)
    assert len(rows) == 16 * len(x) and {r.n for r in rows} == {n}
    got = matrix(rows)
    assert np.abs(np.abs(got) - np.abs(expected)).max() < 1e-8
    # One sign for all rows of a component.
    assert all(len(np.unique(np.sign(g * w)[np.abs(w) > 1e-6])) == 1 for g, w in zip(got.T, expected.T))
    deviations = ((n * x - sums) ** 2).sum(axis=1)
    assert {r.vec_id: r.deviation for r in rows} == dict(zip(source["vec_id"].tolist(), deviations.tolist()))
    assert np.allclose([r.explained for r in rows[:16]], e / np.trace(v), rtol=1e-10)
    cov = np.cov(got[np.unique(x, axis=0, return_index=True)[1]].T, bias=True)
    assert np.abs(cov - np.eye(16)).max() < 1e-9 and {r.identity_error for r in rows}.pop() < 1e-9
    assert len({r.identity_error for r in rows}) == 1
    assert sorted(rows) == sorted(QUERIES["op11_whiten_embeddings"](spark, FOLDER).collect())


@pytest.mark.parametrize("shift", [0, 1 << 20, 1 << 40])
def test_covariances_are_exact(shift):
    draw = np.random.default_rng(shift)
    x = draw.integers(-50, 50, (40, 5)) + draw.integers(-3, 3, 5) * shift
    x[:, 0] += draw.integers(0, 2, 40) * shift
    n, sums = 40, [int(s) for s in x.astype(object).sum(axis=0)]
    centre = np.array(whitening._rounded_means(n, sums))
    parts = [whitening._squares(part, centre).astype(object) for part in (x[:17], x[17:])]
    got = whitening.covariance(n, sums, [int(v) for v in parts[0] + parts[1]])
    for i in range(5):
        for j in range(5):
            exact = sum(
                (Fraction(int(a)) - Fraction(sums[i], n)) * (Fraction(int(b)) - Fraction(sums[j], n))
                for a, b in zip(x[:, i], x[:, j])
            ) / n
            assert got[i, j] == float(exact)


def test_deviations_stay_exact_beyond_64_bits():
    model = whitening.Whitening(10**7, [3 * 10**12] * 2, np.eye(2), np.ones(2), [0.5, 0.5], 2)
    x = np.array([[10**9, 1], [300_000, 300_001]])
    assert model.deviations(x) == [
        sum((10**7 * int(v) - 3 * 10**12) ** 2 for v in row) for row in x
    ]


def test_repeated_rows_odd_vectors_and_clashing_columns(spark):
    draw = np.random.default_rng(1)
    good = draw.normal(size=(30, 4)).astype(np.float32).tolist()
    odd = [None, [], [1.0, None, 0.0, 0.0], [float("nan")] + [0.0] * 3, [float("inf")] * 4, [1e30] * 4, [1.0] * 5]
    vectors = good + odd + [good[0]] * 20
    ids = [*range(30), *range(100, 107), *[None] * 10, *[7] * 10]
    rows = table(spark, vectors, ids).withColumns({c: F.lit("extra") for c in ("x", "n", "whitened", "_at", "component")})
    found = whitening.whiten(rows).collect()
    assert len(found) == 50 * 4 and {r.component for r in found} == {1, 2, 3, 4}
    assert sum(r.vec_id is None for r in found) == 40 and sum(r.vec_id == 7 for r in found) == 44
    x = whole(good)
    n, _, _, _, expected = by_definition(x)
    once = [r for r in found if r.vec_id is not None and r.vec_id != 7]
    keep = [i for i in range(30) if i != 7]
    assert n == found[0].n == 30 and np.abs(np.abs(matrix(once)) - np.abs(expected[keep])).max() < 1e-8
    same = {(r.component, r.whitened, r.deviation) for r in found if r.vec_id is None}
    assert len(same) == 4 and same == {(r.component, r.whitened, r.deviation) for r in found if r.vec_id == 0}


def test_each_vector_is_whitened_once(spark):
    draw = np.random.default_rng(3)
    found = whitening.whiten(table(spark, draw.normal(size=(20, 3)).astype(np.float32).tolist()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and dict(found.dtypes)["component"] == "int"


def test_no_variance_and_no_rows(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [None, [None]])).collect() == []
    single = whitening.whiten(table(spark, [[0.5, 1.0]] * 3)).collect()
    assert len(single) == 6
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in single} == {(1, 0, None, 0.0, 0.0)}
    # The second dimension follows the first: one component has no variance.
    flat = whitening.whiten(table(spark, [[0.5, 1.0], [1.0, 2.0], [1.5, 3.0]])).orderBy("vec_id", "component").collect()
    assert [r.whitened is None for r in flat] == [False, True] * 3
    assert flat[0].explained == pytest.approx(1.0) and flat[0].identity_error < 1e-9


def test_a_hot_vector_is_one_row_of_the_fit(spark):
    draw = np.random.default_rng(2)
    vectors = draw.normal(size=(200, 3)).astype(np.float32).tolist()
    model = whitening.fit(
        table(spark, vectors + [vectors[0]] * 400).select(whitening.whole_vector(F.col("embedding")).alias("x"))
    )
    assert model.n == len(np.unique(whole(vectors), axis=0))
