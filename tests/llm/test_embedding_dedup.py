from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillscope.llm import embedding_dedup as ed
from tillscope.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """Links and smallest reachable ids by comparing all pairs."""
    usable = {
        i: np.array(v, dtype=np.float64) for i, v in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    }
    ids = sorted(usable)
    links = {i: 0 for i, _ in rows}
    root = {i: i for i, _ in rows}
    pairs = []
    for size in {len(v) for v in usable.values()}:
        own = [i for i in ids if len(usable[i]) == size]
        x = np.stack([usable[i] for i in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in np.argwhere(np.triu(x @ x.T >= ed.COSINE, 1)):
            pairs.append((own[a], own[b]))
            links[own[a]] += 1
            links[own[b]] += 1
    while True:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return {i: (links[i], root[i], i == root[i]) for i, _ in rows}


def check(spark, rows):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    got = [tuple(r) for r in ed.near_duplicates(df).collect()]
    assert len(got) == len(dict(rows))
    assert {r[0]: r[1:] for r in got} == brute(rows)


def cloud(seed, groups, each, dimension, noise):
    pick = np.random.default_rng(seed)
    x = np.repeat(pick.normal(size=(groups, dimension)), each, axis=0)
    x = x + noise * pick.normal(size=x.shape)
    return [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]


@pytest.mark.parametrize(("dimension", "shard"), [(64, 8192), (64, 32), (10, 16), (3, 50), (1, 7)])
def test_equals_brute_force(spark, monkeypatch, dimension, shard):
    # Small shards, so that vectors visit many of them and crowded shards are dealt in parts.
    monkeypatch.setattr(ed, "SHARD", shard)
    check(spark, cloud(dimension, 60, 12, dimension, 0.22) + [(5000 + i, v) for i, v in cloud(3, 200, 1, dimension, 0)])


def test_one_crowded_group_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ed, "SHARD", 40)
    rows = cloud(8, 1, 500, 16, 0.15)
    rows += [(1000 + i, rows[3][1]) for i in range(50)] + [(2000, [2 * x for x in rows[3][1]])]
    check(spark, rows)


def test_odd_vectors(spark):
    check(spark, [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
        (7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [3.0, 0.1]), (10, [-1.0, 0.0]), (11, [1.0, -0.0]), (12, [1e-30, 0.0]),
        (13, [1e30, 1e28]), (None, [1.0, 0.0]),
    ])


def test_threshold_is_inclusive_and_exact(spark):
    angle = np.arccos(ed.COSINE)
    near, far = angle * (1 - 1e-5), angle * (1 + 1e-5)
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate([0.0, near, 1.0, 1.0 + far, 2.0, 2.0 + near])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in ed.near_duplicates(df).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1, 5: 1}


def test_empty_repeated_and_extra_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 2), (2, [1.0, 2.0], 1)], SCHEMA)
    df = df.withColumn("id", F.lit("x")).withColumn("links", F.lit("y")).withColumn("vector", F.lit(1))
    assert {tuple(r) for r in ed.near_duplicates(df).collect()} == {(1, 1, 1, True), (2, 1, 1, False)}
    assert ed.near_duplicates(df.where("false")).collect() == []


def test_query_on_given_vectors(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op1_near_duplicates"](spark, folder).collect()}
    assert got == brute(rows)
