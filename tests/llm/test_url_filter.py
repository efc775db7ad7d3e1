from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tillscope.llm import url_filter
from tillscope.llm.registry import QUERIES
from tillscope.llm.sql import ORACLES

URLS = [
    None, "", "no scheme", "http://", "https://net", "https://net/", "HTTPS://A.NET/x?y#z",
    "http://example.net/en/1", "http://www.example.net/en", "http://example.net/EN/1", "http://notexample.net/en/",
    "http://a.example.com/de/9#t", "http://example.com/fr/", "http://b.org/fr/1", "http://b.org/fr", "http://borg/fr/",
    "http://x.com/cart/1", "http://x.com/a/login", "http://x.com/a/login?n=1", "http://ads.x.com/", "http://x.ads.com/",
    "http://xads.com/", "http://x.com/wp-login.php", "http://x.com/wp-login.phps", "http://é.com/checkout/é",
    "ftp://u:p@h.net:80/p://q", "http://net?x", "http://net#x", "x://casino.a/\nb", "http://x.net\nfoo/",
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, "<p>") for i, u in enumerate([*URLS, *URLS[:6]])]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_query_equals_sql(spark, pages, tmp_path):
    path = str(tmp_path / "pages.parquet")
    pages.coalesce(1).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    ours = QUERIES["op6_filter_urls"](spark, str(tmp_path))
    assert ours.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    theirs = db.execute(f"SELECT {', '.join(ours.columns)} FROM ({ORACLES['op6_filter_urls']})").fetchall()
    assert sorted(map(tuple, ours.collect()), key=repr) == sorted(theirs, key=repr)


def regex_of(pattern):
    """The pattern language once more, a character at a time."""
    body, out = pattern, ""
    if body.startswith("||"):
        out, body = r"\A//(?:[^/]*\.)?", body[2:]
    elif body.startswith("|"):
        out, body = r"\A", body[1:]
    end = body.endswith("|")
    for c in body[:-1] if end else body:
        out += {"*": r"[\s\S]*", "^": r"(?:[^a-zA-Z0-9.%_-]|\Z)"}.get(c, re.escape(c))
    return out + (r"\Z" if end else "")


PATTERNS = ["||net^", "|//a.", "*", "*b*", "/en/", "/log?n", "||example.com/de|", "c(o)m", "a|b", "x+y", "/EN/", "||org/*/1", "ogin|"]


def test_index_finds_what_trying_every_rule_finds(spark, pages):
    table = spark.createDataFrame([(None, p, "block", False) for p in PATTERNS], url_filter.RULES_SCHEMA)
    got = {r.page_id: r for r in url_filter.filter_urls(pages, table).collect()}
    for r in got.values():
        fits = [p for p in PATTERNS if re.search(regex_of(p), f"//{r.host}{r.path}")]
        want = min(fits, key=lambda p: (-len(p), p)) if fits else None
        assert (r.pattern, r.verdict) == (want, "block" if fits else "allow"), r


def test_rules_sit_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(i, f"http://www{i}.net/en/{i}") for i in range(5)] + [(9, "http://rare.net/")], "page_id long, url string")
    addresses = pages.select(F.concat(F.lit("//"), F.substring("url", 8, 99)).alias("t")).select(
        F.split(F.regexp_replace("t", "^//", ""), "[./]").alias("tokens")
    )
    table = spark.createDataFrame([("r", "||rare.net/en/", "block", True), (None, "*", "allow", False)], url_filter.RULES_SCHEMA)
    index = {r.pattern: r.token for r in url_filter.rule_index(table, addresses).collect()}
    assert index == {"||rare.net/en/": "rare", "*": ""}


def test_empty_tables_and_clashing_names(spark, pages):
    none = spark.createDataFrame([], url_filter.RULES_SCHEMA)
    assert {r.verdict for r in url_filter.filter_urls(pages, none, "block").collect()} == {"block"}
    more = pages.withColumn("host", F.lit(1)).withColumn("verdict", F.lit(2)).withColumn("token", F.lit(3))
    assert url_filter.filter_urls(more, url_filter.rules(spark)).count() == pages.count()
    assert url_filter.filter_urls(pages.where("false"), url_filter.rules(spark)).collect() == []


def test_the_own_rules_are_constants_of_the_plan(spark, pages):
    table = url_filter.rules(spark)
    assert ", ".join(f"{n} {t}" for n, t in table.dtypes) == url_filter.RULES_SCHEMA and table.count() == 14
    assert "RDD" not in table._jdf.queryExecution().optimizedPlan().toString()


def test_very_long_urls(spark):
    long = "a/" * 100_000
    urls = [f"http://x.com/{long}", f"http://www.example.com/de/{long}?{long}", f"http://{'h.' * 50_000}org/fr/{long}", "x" * 300_000,
            f"http://x.com/{long}cart/{long}", f"http://net/{long}"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, url_filter.rules(spark)).collect()}
    assert [got[i].verdict for i in range(6)] == ["allow", "block", "allow", "allow", "block", "block"]
    assert [got[i].rule for i in range(6)] == [None, "example.com/de/", "org/fr/", None, None, "net/"]
    assert got[0].path == f"/{long}" and got[3].path == "" and got[2].host == "h." * 50_000 + "org"
