from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tillscope.llm import line_dedup
from tillscope.llm.registry import QUERIES


def line(pick, words):
    return " ".join("".join(pick.choices("abcdefghijklmnop", k=5)) for _ in range(words))


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


@pytest.mark.parametrize("seed", range(4))
def test_planted_passages_go_whole_at_later_places(spark, documents, seed):
    pick = random.Random(seed)
    passages = []
    for _ in range(12):
        lines = []
        while words(" ".join(lines)) < 51:
            lines.append(line(pick, pick.choice([1, 2, 7, 20, 60])))
            if pick.random() < 0.2:
                lines.append(pick.choice(["", "  "]))
        while not lines[-1].strip():
            lines.pop()
        passages.append(lines)
    common = line(pick, 8)
    docs, expected, seen = [], {}, set()
    for doc in range(60):
        lines, kept = [], []
        for _ in range(pick.randrange(4)):
            own = [line(pick, pick.randrange(1, 30)), common, line(pick, 2)] if pick.random() < 0.7 else []
            lines += own
            kept += own
            p = pick.randrange(len(passages))
            lines += passages[p]
            kept += [] if p in seen else passages[p]
            seen.add(p)
            # Something of its own between two passages, so that each stands alone.
            lines.append(line(pick, 3))
            kept.append(lines[-1])
        docs.append((doc, "\n".join(lines)))
        expected[doc] = "\n".join(kept)
    assert texts_of(line_dedup.dedup_lines(documents(*docs).repartition(5))) == expected


def test_short_runs_and_first_places_stay(spark, documents):
    pick = random.Random(9)
    short, long = line(pick, 49), line(pick, 50)
    docs = documents(
        (5, f"{long}\nx"), (2, f"a\n{long}"), (3, f"{short}\nb"), (4, f"{short}\nc"), (6, long), (7, f"{long}\n{long}"),
    )
    out = line_dedup.dedup_lines(docs)
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert texts_of(out) == {
        2: f"a\n{long}", 3: f"{short}\nb", 4: f"{short}\nc", 5: "x", 6: "", 7: "",
    }


def test_runs_inside_one_document(spark, documents):
    pick = random.Random(5)
    block = [line(pick, 30), "", line(pick, 30)]
    docs = documents((1, "\n".join(["top", *block, "mid", *block, "end"])), (2, "\n".join([line(pick, 26)] * 9)))
    got = texts_of(line_dedup.dedup_lines(docs))
    assert got[1] == "\n".join(["top", *block, "mid", "end"])
    assert len(got[2].split("\n")) == 1


def test_a_run_that_overlaps_its_first_place_goes_from_its_second_place_on(spark, documents):
    pick = random.Random(6)
    one, two = line(pick, 10), line(pick, 10)
    docs = documents((1, "\n".join([one] * 2000)), (2, "\n".join(["a", *[one, two] * 30, "b"])), (3, "\n".join([one] * 4)))
    got = texts_of(line_dedup.dedup_lines(docs))
    # The second place of "one two one two one" begins two lines behind the first, that of "two ..." too.
    assert got == {1: one, 2: "\n".join(["a", one, two, "b"]), 3: "\n".join([one] * 4)}


def test_odd_rows(spark, documents):
    long = line(random.Random(1), 70)
    docs = documents((1, None), (2, ""), (3, "\n\n"), (None, long), (4, long), (4, long), (5, "w " * 30000))
    docs = docs.withColumn("removed", F.lit("mine")).withColumn("at", F.lit(1)).withColumn("id", F.lit(2))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    rows = sorted(((r.doc_id, r.text, r.n_chars) for r in out.select("doc_id", "text", "n_chars").collect()), key=repr)
    assert rows == sorted([
        (1, None, None), (2, "", 0), (3, "\n\n", 2), (None, long, len(long)), (4, "", 0), (4, "", 0), (5, "w " * 30000, 60000),
    ], key=repr)
    assert line_dedup.dedup_lines(docs.where("false")).collect() == []


def test_query_removes_only_what_stands_earlier_and_leaves_little(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op7_dedup_lines"](spark, folder).collect()
    assert len(rows) == len(texts) and {r.doc_id for r in rows} == set(texts)
    first: dict[tuple, tuple] = {}
    runs = {}

    def stretches(lines):
        """Stretches of whole lines that just reach the least number of words, from either end."""
        for step in (1, -1):
            for i in range(len(lines)):
                total, j = 0, i
                while 0 <= j < len(lines) and total < line_dedup.LEAST_WORDS:
                    total += words(lines[j])
                    j += step
                if words(lines[i]) and total >= line_dedup.LEAST_WORDS:
                    yield (i, j - 1) if step > 0 else (j + 1, i)

    for doc in sorted(texts):
        lines = texts[doc].split("\n")
        for i, j in sorted(set(stretches(lines))):
            key = tuple(x for x in lines[i : j + 1] if words(x))
            if first.setdefault(key, (doc, i)) != (doc, i):
                runs.setdefault(doc, []).append((i, j))
    removed_lines = 0
    for r in rows:
        lines = texts[r.doc_id].split("\n")
        repeated = {k for i, j in runs.get(r.doc_id, []) for k in range(i, j + 1) if words(lines[k])}
        removed = {k for x in r.removed or [] for k in range(x["first"], x["last"] + 1) if words(lines[k])}
        assert removed == repeated
        kept = [x for k, x in enumerate(lines) if not any(a["first"] <= k <= a["last"] for a in r.removed or [])]
        assert r.text == "\n".join(kept) and (r.n_lines, r.removed_lines) == (len(lines), len(lines) - len(kept))
        for x in r.removed or []:
            assert x["source"] <= r.doc_id
        removed_lines += len(removed)
    assert removed_lines > 100


def test_all_column_functions(spark, documents, capsys):
    line_dedup.repeated_runs(documents((1, "a"))).explain()
    line_dedup.fingerprints(documents((1, "a"))).explain()
    assert not re.search("Python|Pandas|Arrow|SinglePartition", capsys.readouterr().out)


def test_runs_whose_parts_stand_first_in_different_documents_go(spark, documents):
    pick = random.Random(11)
    parts = [line(pick, 40) for _ in range(10)]
    rows = [(i, f"{part}\n{line(pick, 9)}") for i, part in enumerate(parts)]
    whole = "\n".join(parts)
    assert texts_of(line_dedup.dedup_lines(documents(*rows, (10, whole), (11, whole)))) == {**dict(rows), 10: whole, 11: ""}


@pytest.mark.parametrize("seed", range(3))
def test_removed_lines_are_all_that_stand_in_repeated_runs(spark, documents, seed):
    pick = random.Random(seed)
    lines = [line(pick, n) for n in (1, 3, 12, 24, 25, 26, 40, 49, 50, 70)]
    texts = {d: pick.choices([*lines, ""], k=pick.randrange(1, 14)) for d in range(60)}
    first, runs = {}, {d: [] for d in texts}
    for d, own in texts.items():
        worded = [(k, x) for k, x in enumerate(own) if x]
        for i in range(len(worded)):
            for j in range(i, len(worded)):
                run = tuple(x for _, x in worded[i : j + 1])
                if words(" ".join(run)) >= 50 and first.setdefault(run, (d, i)) != (d, i):
                    runs[d].append((worded[i][0], worded[j][0]))
    expected = {
        d: "\n".join(x for k, x in enumerate(own) if not any(a <= k <= b for a, b in runs[d])) for d, own in texts.items()
    }
    assert sum(map(len, runs.values())) > 100
    assert texts_of(line_dedup.dedup_lines(documents(*[(d, "\n".join(own)) for d, own in texts.items()]))) == expected
