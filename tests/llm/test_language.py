from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillscope.llm import language
from tillscope.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"


def counts_by_definition(text):
    """Stretches of letters and gaps as texts, counted."""
    signs = " "
    for c in text:
        sign = c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " "
        signs += "" if sign == signs[-1] == " " else sign
    signs += "" if signs[-1] == " " else " "
    return Counter(
        signs[i : i + n] for n in range(1, language.LONGEST + 1) for i in range(len(signs) - n + 1) if signs[i : i + n] != " "
    )


@pytest.mark.parametrize("text", ["", " ", "12-3!", "a", "Ab  c", "ÀÉ ß, İx\n²½ y", "  word.  word  ", "語 語彙"])
@pytest.mark.parametrize("piece", [1, 2, 3, 5, 1 << 20])
def test_counts_are_those_of_letters_and_gaps_in_any_pieces(monkeypatch, text, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    expected = counts_by_definition(text)
    if not any(c.isalpha() for c in text):
        expected = Counter()
    found = language.letter_counts(text)
    assert found.sum() == sum(expected.values())
    # Equal stretches have equal numbers, so there are at most as many numbers as stretches.
    assert sorted(found[found > 0], reverse=True) == sorted(expected.values(), reverse=True)


def test_a_machine_reaches_the_least_cost():
    draw = np.random.default_rng(1)
    rows, sides = [], np.array([1.0 if i % 3 else -1.0 for i in range(300)])
    for side in sides:
        at = np.sort(draw.choice(40, 6, replace=False)).astype(np.int16)
        at[0] = 40 if (side > 0) == (draw.random() < 0.95) else 41
        rows.append((at, np.full(6, 6**-0.5, dtype=np.float32)))
    found = language.support_vector_machine(rows, sides)
    assert not found[42:-1].any()
    x = np.zeros((300, 43))
    x[:, -1] = 1
    for i, (at, value) in enumerate(rows):
        x[i, at.astype(int)] = value
    share = (sides > 0).mean()
    cost = np.where(sides > 0, 0.5 / share, 0.5 / (1 - share)) * language.COST

    def loss(w):
        return w @ w / 2 + (cost * np.maximum(1 - sides * (x @ w), 0) ** 2).sum()

    best = np.zeros(43)
    for _ in range(200):  # Newton steps on the cost itself
        inside = sides * (x @ best) < 1
        a, c = x[inside], cost[inside][:, None]
        best = np.linalg.solve(np.eye(43) + 2 * a.T @ (c * a), 2 * a.T @ (c[:, 0] * sides[inside]))
    assert loss(best) <= loss(np.append(found[:42], found[-1])) <= 1.01 * loss(best)


def invented(lang, pick):
    """Texts of a made-up vocabulary; the endings of nl and de, and of pt and it, are closely related."""
    stems = {"de": "gw", "nl": "gw", "it": "oa", "pt": "oa", "fi": "kk"}[lang]
    ending = {"de": "en", "nl": "em", "it": "ione", "pt": "iono", "fi": "aa"}[lang]
    word = lambda: stems[0] + "".join(pick.choice(stems + "rst") for _ in range(3)) + ending
    return " ".join(word() for _ in range(pick.randint(8, 30)))


def invented_rows(seed, count):
    pick = random.Random(seed)
    return [(i, invented(lang, pick), lang) for i in range(count) for lang in [pick.choice(["de", "nl", "it", "pt", "fi"])]]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_family_first_then_pairs_within_it(spark):
    docs = table(spark, invented_rows(1, 500))
    model = language.train(docs)
    assert model.names == ["de", "fi", "it", "nl", "pt"]
    assert sorted(model.families) == [(0, 3), (1,), (2, 4)]
    assert sorted(model.pairs) == [(0, 3), (2, 4)]
    fresh = table(spark, invented_rows(2, 200))
    rows = language.add_language(fresh, model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 196
    assert all(0 <= r.score <= 1 for r in rows) and np.median([r.score for r in rows]) > 0.9
    assert language.train(docs).pair_weights.tobytes() == model.pair_weights.tobytes()


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = invented_rows(3, 300)
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows]
    other = [(i, t, "zz" if h else lang) for (i, t, lang), h in zip(rows, held)]
    other_texts = [(i, "nothing" if h else t, lang) for (i, t, lang), h in zip(rows, held)]
    models = [language.train(table(spark, r)) for r in (rows, other, other_texts)]
    assert models[0].names == models[1].names
    assert len({m.family_weights.tobytes() + m.pair_weights.tobytes() for m in models}) == 1


def test_copies_and_shared_ids_do_not_enlarge_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language, "TEXTS_PER_LANGUAGE", 40)
    rows = invented_rows(4, 800)
    copies = rows + [(7, rows[0][1], rows[0][2])] * 2000 + [(7, f"oat{i}ione", "it") for i in range(500)]
    copies += [(i, "12 34", "num") for i in range(50)] + [(i, None, "fi") for i in range(50)]
    assert table(spark, copies).where(~language.held_out()).count() > 2500
    found = [
        sorted((r.lang, r.mark, tuple(r.numbers), tuple(r.counts)) for r in language.sample(table(spark, c)).collect())
        for c in (copies, copies[::-1])
    ]
    assert found[0] == found[1] and len({r[:2] for r in found[0]}) == len(found[0])
    counted = Counter(r[0] for r in found[0])
    assert set(counted) == {"de", "nl", "it", "pt", "fi"} and all(15 < n < 75 for n in counted.values())


def test_the_most_frequent_languages_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    rows = [(i, f"word{chr(97 + i % 26)} {chr(97 + i // 26)}", "de" if i % 3 else "it") for i in range(300)] + [(1, "x", "fi")]
    assert language.train(table(spark, rows)).names == ["de", "it"]


def test_odd_texts_clashing_columns_and_repeated_rows(spark):
    model = language.train(table(spark, invented_rows(5, 200)))
    odd = [(1, None, None), (2, "", "de"), (3, "12 ²½ _!", None), (None, "gwrsen gwrsen", "x"), (5, "a" * 2_000_000, None)]
    docs = table(spark, odd + [odd[3]] * 3).withColumns({c: F.lit("extra") for c in ("score", "_x", "language", "numbers")})
    rows = language.add_language(docs, model).collect()
    assert len(rows) == 8 and set(rows[0].asDict()) == {*docs.columns, "lang_pred"}
    assert [(r.lang_pred, r.score) for r in rows[:3]] == [("und", 0.0)] * 3
    assert {r.lang_pred for r in rows[3:4] + rows[5:]} == {"de"} and rows[4].lang_pred in model.names
    assert language.add_language(table(spark, []), model).collect() == []


@pytest.mark.parametrize("rows", [[], [(1, "a b", None)], [(1, None, "de"), (2, "", "en")]])
def test_nothing_to_learn_from(spark, rows):
    docs = table(spark, rows)
    model = language.train(docs)
    assert {(r.lang_pred, r.score) for r in language.add_language(table(spark, [(1, "abc", None)]), model).collect()} == {
        ("und", 0.0)
    }


def test_one_language_and_one_family(spark):
    one = language.train(table(spark, [(i, f"word{i}", "de") for i in range(20)]))
    row = language.add_language(table(spark, [(1, "abc", None)]), one).first()
    assert (row.lang_pred, row.score) == ("de", 1.0)
    rows = [r for r in invented_rows(6, 300) if r[2] in ("de", "nl")]
    both = language.train(table(spark, rows))
    assert both.families == [(0, 1)]
    found = language.add_language(table(spark, rows), both).collect()
    assert sum(r.lang == r.lang_pred for r in found) > 0.98 * len(found)


def test_accuracy_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    rows = QUERIES["op13_predict_language"](spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.99
