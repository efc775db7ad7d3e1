from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillscope.llm import common, quality, toxicity
from tillscope.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.1"
ODD = [None, "", " \n\t ", "a", "é \U0001f600", "x " * 20000, " |", "A\x00B"]


def auc(score, label):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(label) - ones))


@pytest.mark.parametrize(("query", "label", "cut", "least_auc", "least_share"), [
    ("op3_score_quality", "quality", 0.3, 0.99, 0.98),
    ("op4_score_toxicity", "toxic", 0.5, 0.97, 0.95),
])
def test_held_out_accuracy(spark, query, label, cut, least_auc, least_share):
    scored = QUERIES[query](spark, FOLDER)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", label)
    assert scored.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    rows = scored.where("held_out").join(labels, "doc_id").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"])
    assert ((rows["score"] >= cut) == (rows["predicted"] == 1)).all()
    assert auc(rows["score"].to_numpy(), rows[label].to_numpy()) > least_auc
    assert (rows["predicted"] == rows[label]).mean() > least_share


def test_training_rows_are_bounded_and_never_held_out(spark, documents):
    docs = documents(*[(i, f"t{i}") for i in range(2000)], (None, "x"))
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(2000)] + [(7, 1), (8, None), (None, 1)], "doc_id long, toxic int"
    )
    rows = common.training_rows(docs, labels, "toxic", 300).collect()
    assert 200 < len(rows) < 400 and len({r.text for r in rows}) == len(rows)
    assert all(zlib.crc32(r.text[1:].encode()) % 5 != 0 for r in rows)
    full = common.training_rows(docs, labels, "toxic", 10**6).collect()
    assert len(full) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(2000))
    assert {r.label for r in full if r.text == "t7"} <= {1}


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_odd_texts_and_empty_tables(spark, documents, module, label):
    docs = documents(*enumerate(ODD), (0, "again"), (None, "no id")).withColumn("weight", F.lit("w"))
    good = spark.createDataFrame([(i, i % 2) for i in range(8)], f"doc_id long, {label} int")
    for labels in (good, good.where("false"), good.where(f"{label} = 1")):
        model = module.train(docs, labels)
        rows = module.add_score(docs, model).collect()
        assert len(rows) == docs.count() and all(0.0 <= r.score <= 1.0 and r.weight == "w" for r in rows)
        assert module.add_score(docs.where("false"), model).collect() == []
    assert module.train(docs.where("false"), good) is not None


def test_trees_step_like_one_row_at_a_time():
    pick = np.random.default_rng(3)
    x = pick.normal(size=(500, len(quality.STATISTICS))).round(1)
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] < -0.1)).astype(float)
    model = quality.fit(x, y)
    score = model.score(x)
    assert ((score > 0.5) == y).mean() > 0.95
    for row, expected in zip(x[:50], score):
        total = model.base
        for tree in range(len(model.cut)):
            node = 0
            while node < 2**quality.DEPTH - 1:
                right = row[model.feature[tree, node]] > model.cut[tree, node]
                node = 2 * node + (2 if right else 1)
            total += model.value[tree, node - (2**quality.DEPTH - 1)]
        assert abs(1 / (1 + np.exp(-total)) - expected) < 1e-9


def tree_by_hand(x, y, margin, cuts):
    """One boosted tree: every cut of every statistic tried at every node, a row at a time."""
    p = 1 / (1 + np.exp(-margin))
    g, h = p - y, p * (1 - p)
    feature, cut = [0] * (2**quality.DEPTH - 1), [np.inf] * (2**quality.DEPTH - 1)
    members = {0: list(range(len(y)))}
    for node in range(2**quality.DEPTH - 1):
        rows = members.get(node, [])
        score = lambda some: sum(g[i] for i in some) ** 2 / (sum(h[i] for i in some) + quality.RIDGE)
        best = (1e-6, 0, np.inf)
        for f in range(x.shape[1]):
            for c in cuts[f]:
                left, right = [i for i in rows if x[i, f] <= c], [i for i in rows if x[i, f] > c]
                if min(len(left), len(right)) >= quality.LEAST:
                    gain = score(left) + score(right) - score(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, c)
        feature[node], cut[node] = best[1:]
        members[2 * node + 1] = [i for i in rows if x[i, best[1]] <= best[2]]
        members[2 * node + 2] = [i for i in rows if x[i, best[1]] > best[2]]
    leaves = [members[node] for node in range(2**quality.DEPTH - 1, 2 ** (quality.DEPTH + 1) - 1)]
    value = [-quality.RATE * sum(g[i] for i in own) / (sum(h[i] for i in own) + quality.RIDGE) for own in leaves]
    return feature, cut, value, leaves


def test_trees_equal_an_exhaustive_search(monkeypatch):
    monkeypatch.setattr(quality, "TREES", 4)
    monkeypatch.setattr(quality, "DEPTH", 3)
    draw = np.random.default_rng(7)
    for rows in (60, 200):
        x = np.stack([draw.normal(size=rows), draw.integers(0, 4, rows), draw.normal(size=rows).round(1), np.ones(rows)], axis=1)
        y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 1) ^ (draw.random(rows) < 0.1)).astype(float)
        model = quality.fit(x, y)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, quality.BINS + 1)[1:-1])) for c in x.T]
        margin = np.full(rows, model.base)
        assert model.base == pytest.approx(np.log((y.sum() + 1) / (rows - y.sum() + 1)))
        for tree in range(4):
            feature, cut, value, leaves = tree_by_hand(x, y, margin, cuts)
            assert model.cut[tree].tolist() == cut
            assert [f for f, c in zip(model.feature[tree], cut) if c < np.inf] == [f for f, c in zip(feature, cut) if c < np.inf]
            assert np.allclose(model.value[tree], value)
            for own, v in zip(leaves, value):
                margin[own] += v
        assert np.allclose(model.score(x), 1 / (1 + np.exp(-margin)))


def test_features_travel_as_numbers_and_give_the_same_weights(spark, documents):
    pick, features = random.Random(2), toxicity.Features()
    texts = {i: " ".join(pick.choice("abcdefgh") for _ in range(9)) + " bad" * (i % 3 == 0) for i in range(200)}
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in texts], "doc_id long, toxic int")
    docs = documents(*texts.items())
    rows = common.training_rows(docs, labels, "toxic", 10**6).orderBy("order").collect()
    numbers, values = toxicity.fit([(np.unique(features.of(r.text)).astype(np.int32), r.label) for r in rows])
    for parts in (1, 5):
        model = toxicity.train(docs.repartition(parts), labels)
        assert model["feature"].tolist() == numbers.tolist() and model["weight"].tolist() == values.tolist()


def test_statistics_are_finite_and_named():
    for text in ODD:
        found = quality.statistics(text or "")
        assert len(found) == len(quality.STATISTICS) and np.isfinite(found).all()


def ftrl_by_hand(rows):
    """The weights once more, one coordinate at a time."""
    z, n, bias = {}, {}, 1 << toxicity.BITS

    def weight(i):
        strength = 0.0 if i == bias else toxicity.L1
        total = z.get(i, 0.0)
        if abs(total) <= strength:
            return 0.0
        sign = 1 if total > 0 else -1
        return -(total - sign * strength) / ((toxicity.BETA + n.get(i, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for features, label in rows:
            at = sorted({*features.tolist(), bias})
            w = [weight(i) for i in at]
            error = 1 / (1 + np.exp(-sum(w))) - label
            error *= toxicity.TOXIC_WEIGHT if label else 1.0
            for i, old in zip(at, w):
                before = n.get(i, 0.0)
                step = ((before + error**2) ** 0.5 - before**0.5) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + error - step * old
                n[i] = before + error**2
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_equals_the_formula():
    pick, features = random.Random(1), toxicity.Features()
    rows = []
    for i in range(150):
        words = [pick.choice("abcdefgh") for _ in range(8)] + ["bad"] * (i % 3 == 0)
        rows.append((np.unique(features.of(" ".join(words))), int(i % 3 == 0)))
    numbers, values = toxicity.fit(rows)
    expected = ftrl_by_hand(rows)
    assert numbers.tolist() == sorted(expected)
    assert np.allclose(values, [expected[i] for i in numbers.tolist()], rtol=1e-3)
    assert toxicity.score_text("a bad b", features, numbers, values) > 0.5 > toxicity.score_text("a b", features, numbers, values)


def test_features_are_words_pairs_and_skips():
    features = toxicity.Features()
    assert len(features.of("")) == 0 and len(features.of("one")) == 1
    # Three words, two neighbours, one pair with a word between.
    assert len(features.of("One two, THREE!")) == 6
    assert set(features.of("two three")) <= set(features.of("one two three"))


def test_toxic_documents_go(spark, documents):
    docs = documents(*[(i, "good words here" + (" vile" if i % 4 == 0 else "")) for i in range(400)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(400) if i % 4}


def test_documents_that_repeat_an_id_are_one_training_row(spark, documents):
    hot = next(i for i in range(10) if zlib.crc32(str(i).encode()) % 5)
    docs = documents(*[(hot, f"copy {i}") for i in range(500)], *[(i, f"t{i}") for i in range(1000, 1100)])
    labels = spark.createDataFrame([(i, i % 2) for i in [hot, *range(1000, 1100)]], "doc_id long, toxic int")
    for parts in (1, 7):
        rows = common.training_rows(docs.repartition(parts), labels, "toxic", 10**6).collect()
        texts = sorted(r.text for r in rows)
        assert sum(t.startswith("copy") for t in texts) == 1
        assert len(texts) == 1 + sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1000, 1100))
        first = texts if parts == 1 else first
        assert texts == first
