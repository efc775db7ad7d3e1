from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tillscope.llm import mixing
from tillscope.llm.registry import QUERIES
from tillscope.llm.sql import ORACLES


def rates(docs, **how):
    return {r.source: r for r in mixing.source_rates(docs, **how).collect()}


def test_words_end_only_at_ascii_white_space(spark, documents):
    df = documents((1, "a\u00a0b c\td\x0be"), (2, None), (3, ""), (4, " \n "))
    got = {r.doc_id: r.n for r in df.select("doc_id", mixing.word_count(F.col("text")).alias("n")).collect()}
    assert got == {1: 4, 2: 0, 3: 0, 4: 0}


def test_excess_is_reshared_by_weight(documents):
    docs = documents((1, "w " * 10, "a"), (2, "w " * 100, "b"), (3, "w " * 90, "c"), (4, "w " * 100, None))
    got = rates(docs)
    # 450 words by 5:2:1:5 give a 173, over 20; 430 by 2:1:5 give NULL 268.75, over 200; 230 by 2:1.
    assert got["a"].target == 20 and got[None].target == 200
    assert abs(got["b"].target - 230 * 2 / 3) < 1e-9 and abs(got["c"].target - 230 / 3) < 1e-9
    assert sum(r.target for r in got.values()) == 450


def test_no_words_and_no_rows(documents):
    got = rates(documents((1, "", "a"), (2, None, "b")))
    assert {r.target for r in got.values()} == {0.0} and {r.rate for r in got.values()} == {0.0}
    empty = documents((1, "x")).where("false")
    assert mixing.mix_sources(empty).collect() == []


def test_copies_are_floor_or_one_more_and_repeatable(documents):
    docs = documents(*[(i, "w " * (i % 7 + 1), "abc"[i % 3]) for i in range(600)])
    by_source = rates(docs)
    first = mixing.mix_sources(docs)
    assert first.columns == docs.columns
    counts = Counter((r.doc_id, r.source) for r in first.collect())
    for i in range(600):
        source = "abc"[i % 3]
        whole = int(by_source[source].rate)
        assert counts[(i, source)] in (whole, whole + 1) and counts[(i, source)] <= 2
    again = Counter((r.doc_id, r.source) for r in mixing.mix_sources(docs.repartition(7)).collect())
    assert again == counts
    for source, rate in by_source.items():
        taken = sum(n * (i % 7 + 1) for (i, s), n in counts.items() if s == source)
        assert abs(taken - rate.target) < 0.15 * rate.target


def test_extra_columns_keep_their_values(documents):
    docs = documents((1, "a b", "a"), (1, "a b", "a")).withColumn("rate", F.lit("mine")).withColumn("_weight", F.lit(3))
    rows = mixing.mix_sources(docs).collect()
    assert {(r.rate, r["_weight"]) for r in rows} == {("mine", 3)} and len(rows) in (2, 4)


def test_query_equals_sql_on_odd_rows(spark, documents, tmp_path):
    docs = documents(
        (1, None, None), (2, "", "b"), (3, "é \U0001f600 x", "é"), (4, "w " * 50, "a"), (None, "a b c", "b"),
        *[(i, "w " * (i % 11), "ABz"[i % 3]) for i in range(5, 60)],
    )
    path = str(tmp_path / "documents.parquet")
    docs.coalesce(1).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    ours = QUERIES["op2_mix_sources"](spark, str(tmp_path))
    theirs = db.execute(f"SELECT {', '.join(ours.columns)} FROM ({ORACLES['op2_mix_sources']})").fetchall()
    assert sorted(map(tuple, ours.collect()), key=repr) == sorted(theirs, key=repr)


def test_very_long_texts(spark, documents):
    docs = documents((1, "é \U0001f600\t" * 500_000, "a"), (2, "x" * 2_000_000, "a"), (3, "b " * 10, "b"))
    got = {r.source: (r.source_size, r.target) for r in mixing.source_rates(docs).collect()}
    assert got == {"a": (1_000_001, 1_500_016.5 - 20), "b": (10, 20.0)}
    assert Counter(r.doc_id for r in mixing.mix_sources(docs).collect())[3] == 2
