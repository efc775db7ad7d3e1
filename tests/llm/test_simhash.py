from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tillscope.llm import simhash
from tillscope.llm.components import Forest, components
from tillscope.llm.registry import QUERIES


def by_definition(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(nodes, pairs):
    label = {n: n for n in nodes}
    while True:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


ODD = [
    None, "", " \n ", "One", "one", "one two", "a b c", "A B C", "É a b é", "x " * 40000,
    "the quick brown fox jumps over the lazy dog again", "The quick brown fox jumps over the lazy dog again",
]


def test_fingerprints_follow_the_definition(spark, documents):
    docs = documents(*enumerate(ODD)).withColumn("fingerprint", F.lit("extra"))
    rows = simhash.add_fingerprint(docs).collect()
    assert {r.doc_id: r.fingerprint & (1 << 64) - 1 for r in rows} == {i: by_definition(t) for i, t in enumerate(ODD)}
    # Spark's own hash has the same seed.
    own = spark.sql("SELECT xxhash64('a b c')").first()[0]
    assert own & (1 << 64) - 1 == by_definition("A b c")


def clusters(seed, groups, each, spread):
    pick = random.Random(seed)
    found = []
    for _ in range(groups):
        mark = pick.getrandbits(64)
        for _ in range(each):
            found.append(mark)
            for _ in range(pick.randrange(spread)):
                mark ^= 1 << pick.randrange(64)
    return np.array(sorted(set(found)), dtype=np.uint64)


@pytest.mark.parametrize("levels", [0, 1, 3, 6])
def test_tree_and_shards_find_every_pair(levels):
    marks = clusters(levels, 60, 30, 6)
    tree = simhash.VantageTree(marks[::3], levels)
    home = tree.homes(marks)
    row, shard = tree.overlaps(marks, 3)
    assert np.array_equal(np.sort(row[shard == home[row]]), np.arange(len(marks)))
    forest = Forest(len(marks))
    for s in np.unique(home):
        own, guests = np.flatnonzero(home == s), row[(shard == s) & (home[row] < s)]
        both = np.concatenate([own, guests])
        local = Forest(len(both))
        simhash.join_within(marks[own], marks[guests], 3, local, len(own))
        forest.unite(both, both[local.roots(np.arange(len(both)))])
    brute = Forest(len(marks))
    brute.unite(*np.nonzero(simhash.distances(marks[:, None], marks[None, :]) <= 3))
    assert np.array_equal(forest.roots(np.arange(len(marks))), brute.roots(np.arange(len(marks))))


def test_many_equal_distances_end_in_comparison():
    # All within three bits of each other: no vantage point can split them apart.
    marks = np.array([0, *[1 << b for b in range(64)]] * 3, dtype=np.uint64)
    forest = Forest(len(marks))
    simhash.join_within(marks[:100], marks[100:], 3, forest, 100)
    assert len(np.unique(forest.roots(np.arange(100)))) == 1


def test_sharded_links_on_spark(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 64)
    marks = clusters(9, 80, 25, 5).view(np.int64)
    classes = spark.createDataFrame([(int(m), int(m)) for m in marks], "mark long, id long")
    found = {r.node: r.component for r in components(simhash.links(classes)).collect()}
    unsigned = marks.view(np.uint64)
    near = np.argwhere(simhash.distances(unsigned[:, None], unsigned[None, :]) <= 3)
    expected = smallest_reachable(marks.tolist(), [(int(marks[a]), int(marks[b])) for a, b in near])
    assert {m: found.get(m, m) for m in expected} == expected


@pytest.mark.parametrize(("shard", "sample"), [(64, 40), (300, 64), (5, 16)])
def test_shards_in_parts_when_the_tree_ends(spark, monkeypatch, shard, sample):
    """More fingerprints than the tree has shards for: parts and streamed visitors, the same links."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    marks = clusters(shard, 70, 20, 5).view(np.int64)
    classes = spark.createDataFrame([(int(m), int(m)) for m in marks], "mark long, id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = {r.node: r.component for r in components(simhash.links(classes)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unsigned = marks.view(np.uint64)
    near = np.argwhere(simhash.distances(unsigned[:, None], unsigned[None, :]) <= 3)
    expected = smallest_reachable(marks.tolist(), [(int(marks[a]), int(marks[b])) for a, b in near])
    assert {m: found.get(m, m) for m in expected} == expected


def test_components_of_chains_stars_and_loops(spark):
    pick = random.Random(2)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(900, 1300)]
    loose = [(pick.randrange(2000, 2400), pick.randrange(2000, 2400)) for _ in range(250)]
    pairs = chain + star + loose + [(5, 5), (1, 0), (-7, 900)]
    pick.shuffle(pairs)
    edges = spark.createDataFrame([*pairs, (None, 3), (4, None)], "a long, b long")
    found = components(edges)
    rows = found.collect()
    assert len(rows) == len({r.node for r in rows})
    linked = [p for p in pairs if p[0] != p[1]]
    expected = smallest_reachable({n for p in linked for n in p}, linked)
    assert {r.node: r.component for r in rows} == expected
    assert components(edges.where("false")).collect() == []


def test_groups_and_odd_rows(spark, documents):
    docs = documents(*enumerate(ODD), (3, ODD[3]), (None, "One"), (None, "alone here"))
    rows = simhash.group(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert by_id[0] == by_id[1] == by_id[2] == 0 and by_id[4] == by_id[3] == 3 and by_id[7] == by_id[6] == 6
    assert {r.component_id for r in rows if r.doc_id is None} == {3, None}
    assert simhash.group(docs.where("false")).collect() == []
    kept = simhash.drop_near_copies(docs.where("doc_id is not null"))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in by_id.items() if i == c}


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    mark = {r.doc_id: by_definition(r.text) for r in docs}
    ids = sorted(mark)
    marks = np.array([mark[i] for i in ids], dtype=np.uint64)
    near = np.argwhere(simhash.distances(marks[:, None], marks[None, :]) <= 3)
    expected = smallest_reachable(ids, [(ids[a], ids[b]) for a, b in near])
    got = {r.doc_id: r for r in QUERIES["op5_simhash_groups"](spark, folder).collect()}
    assert {i: r.component_id for i, r in got.items()} == expected
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{m:016x}" for i, m in mark.items()}
