from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import check
from tillscope.llm import periodic
from tillscope.llm.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


def runs_by_definition(w, least=12):
    """Every maximal stretch of every period, the smallest period of a stretch first."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items() if n >= least), key=lambda r: (r[0], r[2]))


def collapsed_by_definition(w, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def texts(seed, count):
    pick = random.Random(seed)
    for _ in range(count):
        letters = pick.choice([1, 2, 3, 6])
        if pick.random() < 0.4:
            yield [str(pick.randrange(letters)) for _ in range(pick.randrange(70))]
        else:  # repeated with mistakes, once or inside of each other
            unit = [str(pick.randrange(letters)) for _ in range(pick.randint(1, 8))]
            text = []
            for _ in range(pick.randrange(4)):
                text += unit * pick.randint(1, 6) + ["x"] * pick.randrange(2)
            yield text * pick.randint(1, 3)


@pytest.mark.parametrize("least", [1, 2, 5, 12])
def test_runs_equal_the_definition(least):
    pick = random.Random(least)
    some = list(texts(least, 800))
    while some:
        together = [some.pop() for _ in range(min(len(some), pick.randint(1, 9)))]
        found = periodic._analysed([[w.encode() for w in t] for t in together], least)
        for text, (start, length, period, collapsed) in zip(together, found, strict=True):
            expected = runs_by_definition(text, least)
            assert list(zip(start.tolist(), length.tolist(), period.tolist())) == expected, text
            assert collapsed == collapsed_by_definition(text, expected)


def test_suffixes_are_sorted_and_share_what_is_said():
    pick = random.Random(5)
    words = [pick.randrange(3) for _ in range(300)]
    suffixes = periodic.Suffixes(periodic.np.array(words), periodic.np.full(300, 300))
    order = suffixes.order.tolist()
    assert order == sorted(range(300), key=lambda i: words[i:])
    for slot in range(1, 300):
        a, b = words[order[slot - 1] :], words[order[slot] :]
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert suffixes.common[slot] == same


def test_nested_and_long_texts():
    word = ["a"] * 300_000
    mixed = ["a", "b", "a", "a", "b"] * 60_000
    for text, period in ((word, 1), (mixed, 5)):
        (start, length, smallest, collapsed), = periodic._analysed([[w.encode() for w in text]], 12)
        long = length == len(text)
        assert long.sum() == 1 and smallest[long].tolist() == [period] and start[long].tolist() == [0]
        assert collapsed.split() == text[:period]


ODD = [
    None, "", " \n\t ", "one", "a " * 11, "a " * 12, "A a " * 6, "x y x y " * 7, "é ü " * 9 + "z",
    "one two three four five six " * 2, "one two three four five six seven " * 2, "b " + "a b c " * 4 + "a b q",
]


def test_odd_texts_clashing_columns_and_repeated_rows(spark, documents):
    rows = [*enumerate(ODD), (None, "a " * 20), (3, "one"), (3, "one")]
    docs = documents(*rows).withColumn("runs", F.lit("extra")).withColumn("starts", F.lit("extra"))
    found = periodic.add_runs(docs).collect()
    assert len(found) == len(rows)
    assert set(found[0].asDict()) == {*docs.columns, "collapsed"} and found[0]["starts"] == "extra"
    for row in found:
        words = [w for w in (row.text or "").translate({c: 32 for c in range(9, 14)}).split(" ") if w]
        expected = runs_by_definition(words)
        assert [tuple(r) for r in row.runs] == expected
        assert row.collapsed == collapsed_by_definition(words, expected)
    assert periodic.report(periodic.plant_runs(documents())).collect() == []


def test_planted_runs_follow_the_rule(spark, documents):
    pick = random.Random(3)
    texts = {i: " ".join(str(pick.randrange(50)) for _ in range(pick.randrange(90))) for i in range(300)}
    rows = [*texts.items(), (None, "a b"), (10**12, None)]
    rows = periodic.plant_runs(documents(*rows)).collect()
    assert len(rows) == 302
    changed = 0
    for row in rows:
        text = texts.get(row.doc_id)
        if row.doc_id in texts:
            w, h = text.split(), zlib.crc32(str(row.doc_id).encode())
            g = h // 10
            if h % 10 == 0 and w:
                a = g % len(w)
                p = 1 + (len(w) - a) // (3 + g % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
                changed += 1
            assert row.text.split() == w
        else:
            assert row.text == (None if row.doc_id else "a b")
    assert changed > 10


def test_report_derives_the_digests(spark, documents):
    text = "q " + "a b c " * 5 + "z " + "d " * 15
    row = periodic.report(documents((1, text), (2, ""))).orderBy("doc_id").collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert tuple(row[0]) == (1, 2, 1, 15, 3, 5000, digest("1,15,3\n17,15,1\n"), digest("q a b c z d"))
    assert tuple(row[1]) == (2, 0, None, None, None, None, digest(""), digest(""))


def test_query_equals_its_sql(spark):
    ours = check.spark_rows(QUERIES["op12_find_periodic_runs"](spark, FOLDER))
    _, theirs = check.sql_rows(check.connect(FOLDER), ORACLES["op12_find_periodic_runs"])
    assert ours == theirs and sum(r[3] is not None for r in ours) > 50
