from __future__ import annotations

import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from tillscope.llm import minhash
from tillscope.llm.registry import QUERIES

MASK = (1 << 64) - 1


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def chained(hashes, seed):
    for h in hashes:
        seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
    return seed


def by_hand(text):
    """The fingerprint once more, with sets and dictionaries."""
    smallest = {}
    for shingle in shingles(text):
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in shingle]
        if len(shingle) == 5:
            h = chained(hashes, 42)
        else:
            h = xxhash.xxh64_intdigest((0).to_bytes(4, "little"), 42)
            for word in hashes:
                h = chained([h, word], 42)
        signed = h - (1 << 64) if h >> 63 else h
        place = (signed >> 56) + 128
        smallest[place] = min(signed, smallest.get(place, signed))
    out = []
    for b in range(minhash.BINS):
        at = b if b in smallest else next(
            f for f in (minhash._filler(b, t) for t in range(minhash.BINS)) if f in smallest
        )
        out.append(f"{smallest[at] & 15:x}")
    return "".join(out)


def text(seed, n):
    pick = random.Random(seed)
    return " ".join("".join(pick.choices("abcdeé", k=4)) for _ in range(n))


TEXTS = [None, "", " \n", "one", "a b c d", "a b c d e", "a  b\tc d e", text(1, 30), text(2, 300), text(3, 3000), "x " * 30000, "\U0001f600 é"]


def fingerprints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    found = df.select("i", minhash.fingerprint(F.coalesce("text", F.lit(""))).alias("f")).collect()
    return [r.f for r in sorted(found)]


def test_fingerprints_equal_the_definition(spark):
    assert fingerprints(spark, TEXTS) == [by_hand(t) for t in TEXTS]


def test_every_bin_asks_every_bin():
    for b in range(0, minhash.BINS, 17):
        assert sorted(minhash._filler(b, t) for t in range(minhash.BINS)) == list(range(minhash.BINS))


def test_likeness_estimates_jaccard(spark):
    pick, errors = random.Random(7), []
    rows = []
    for n in (40, 150, 600, 2000):
        for share in (0.0, 0.1, 0.5, 0.9):
            for k in range(6):
                w = text(pick.random(), n).split()
                cut = int(n * share)
                v = w[: n - cut] + text(pick.random(), cut).split()
                a, b = " ".join(w), " ".join(v)
                true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
                rows.append((a, b, true))
    df = spark.createDataFrame(rows, "a string, b string, truth double").select(
        "truth", minhash.likeness(minhash.fingerprint(F.col("a")), minhash.fingerprint(F.col("b"))).alias("est")
    )
    for r in df.collect():
        errors.append(abs(r.truth - r.est))
        assert 0.0 <= r.est <= 1.0 and (r.truth < 1 or r.est == 1.0)
    assert sum(errors) / len(errors) < 0.03 and max(errors) < 0.2


def test_next_row_across_buckets(spark):
    ids = [None, -5, 0, 3, 3, 3, 7, 100, 101, 102, 10**12, *range(200, 260)]
    random.Random(3).shuffle(ids)
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    ordered = sorted(ids, key=lambda i: (i is not None, i or 0))
    expected = {}
    for a, b in zip(ordered, [*ordered[1:], ordered[0]]):
        expected.setdefault((a, f"t{a}"), []).append(f"t{b}")
    for rows in (1, 4, 1000):
        got = {}
        for r in minhash.with_next(docs, ["text"], rows).collect():
            got.setdefault((r.doc_id, r.text), []).append(r.next_text)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def edited(own, following):
    own, following = own or "", following or ""
    taken = len(own) // 2
    return own[: len(own) - taken] + following[:taken]


def test_query_against_brute_force(spark, documents, tmp_path):
    docs = documents(*enumerate(TEXTS)).withColumn("mark", F.lit(1)).withColumn("next_text", F.lit(2))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op8_minhash_fingerprints"](spark, str(tmp_path)).collect()}
    assert len(got) == len(TEXTS)
    for i, own in enumerate(TEXTS):
        changed = edited(own, TEXTS[(i + 1) % len(TEXTS)])
        r = got[i]
        assert r.n_chars == len(own or "")
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (by_hand(own), by_hand(changed))
        for value, other in ((r.near_edited, by_hand(changed)), (r.near_next, by_hand(TEXTS[(i + 1) % len(TEXTS)]))):
            same = sum(a == b for a, b in zip(by_hand(own), other)) / minhash.BINS
            assert abs(value - max((same - 1 / 16) / (15 / 16), 0.0)) < 1e-12


def test_one_row_and_no_rows(spark, documents):
    one = minhash.compare_edited(documents((4, "a b c d e f g"))).first()
    assert one.edited_sha256 == hashlib.sha256(edited("a b c d e f g", "a b c d e f g").encode()).hexdigest()
    assert one.near_next == 1.0
    assert minhash.compare_edited(documents((4, "x")).where("false")).collect() == []


def test_all_column_functions(spark, documents, capsys):
    minhash.compare_edited(documents((1, "a"), (2, "b"))).explain()
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow|SinglePartition", plan)
