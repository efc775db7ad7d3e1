"""Language identification: the family first, then support vector machines between its languages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import held_out, text_or_empty
from tillscope.sources import written_table

#: Language codes by family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro", "sc"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu", "se"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "ug", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("am", "ar", "he", "mt"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "austronesian": ("id", "jv", "mg", "ms", "tl"),
}
#: Answer for texts without any letter.
UNDETERMINED = "und"

#: About so many distinct texts of a language are learnt from, and so many languages at most (the
#: most frequent ones), whatever the size of the corpus.
TEXTS_PER_LANGUAGE, LANGUAGES = 1500, 256
#: Features are numbers below 2^BITS: single letters and stretches of two to four.
BITS, LONGEST = 13, 4
#: Cost of an example inside the margin, and passes over the examples at most.
COST, PASSES = 8.0, 100
#: How fast a score rises with a margin: at the margin of a typical example, 1, it is 0.99.
STEEPNESS = 5.0
#: Characters handled together inside a text, and texts scored together.
PIECE, TOGETHER = 1 << 20, 256

MIX, SALT = np.uint64(0x9E3779B97F4A7C15), 0xC2B2AE3D27D4EB4F


@cache
def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or 0 where it is no letter."""
    points = range(0x110000)
    low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, points)]
    return np.where([c.isalpha() for c in map(chr, points)], np.array(low), 0).astype(np.uint32)


def letter_counts(text: str) -> np.ndarray:
    """Hashed counts of a whole text's letters and of stretches of up to ``LONGEST`` signs.

    Letters are lower-cased; what lies between two words counts as one sign, and so do the start
    and the end of the text. All are zero if there is no letter. Long texts are taken in pieces that
    overlap by what a stretch needs, so the pieces make no difference.
    """
    table, counts = _letters(), np.zeros(1 << BITS, dtype=np.int64)
    carried = np.zeros(1, dtype=np.uint32)
    for at in range(0, max(len(text), 1), PIECE):
        piece = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        signs = np.concatenate([carried, table[piece]])
        if at + PIECE >= len(text):
            signs = np.append(signs, np.uint32(0))
        keep = np.ones(len(signs), dtype=bool)
        keep[1:] = (signs[1:] != 0) | (signs[:-1] != 0)
        signs = signs[keep].astype(np.uint64)
        h = signs
        for size in range(1, LONGEST + 1):
            if size > 1:
                h = h[:-1] * MIX + signs[size - 1 :]
            # Stretches that end at a new sign; the gap alone is none.
            fresh = h[max(len(carried) - size + 1, 0) :]
            fresh = fresh[fresh != 0] if size == 1 else fresh
            mixed = ((fresh + np.uint64(size * SALT % (1 << 64))) * MIX) >> np.uint64(64 - BITS)
            counts += np.bincount(mixed.astype(np.int64), minlength=1 << BITS)
        carried = signs[-(LONGEST - 1) :].astype(np.uint32)
    return counts


def scaled(counts: np.ndarray) -> np.ndarray:
    """Roots of the shares of all counts: rows of length 1, or 0 without letters."""
    total = counts.sum(axis=-1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)


def support_vector_machine(rows: list[tuple[np.ndarray, np.ndarray]], sides: np.ndarray) -> np.ndarray:
    """Weights and, at the end, the bias of the linear machine that tells side +1 from side -1.

    Dual coordinate descent on the squared hinge loss, in an order of the rows that is drawn from a
    fixed seed. Examples of the rarer side cost as much in total as those of the other.
    """
    weights = np.zeros((1 << BITS) + 1)
    share = (sides > 0).mean()
    cost = np.where(sides > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) * COST
    alpha, ridge = np.zeros(len(rows)), 0.5 / cost
    norms = np.array([float(v @ v) + 1.0 for _, v in rows]) + ridge
    draw = np.random.default_rng(0)
    for _ in range(PASSES):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            at, value = rows[i]
            gradient = sides[i] * (weights[at] @ value + weights[-1]) - 1.0 + ridge[i] * alpha[i]
            step = max(alpha[i] - gradient / norms[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                weights[at] += step * sides[i] * value
                weights[-1] += step * sides[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights


@dataclass
class Languages:
    """Learnt weights: one machine per family against all others, one per pair within a family."""

    names: list[str] = field(default_factory=list)
    families: list[tuple[int, ...]] = field(default_factory=list)
    family_weights: np.ndarray = field(default_factory=lambda: np.zeros((0, (1 << BITS) + 1), dtype=np.float32))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_weights: np.ndarray = field(default_factory=lambda: np.zeros((0, (1 << BITS) + 1), dtype=np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language of each scaled row, and a score in 0..1.

        The family with the greatest margin is chosen; within it each pair of languages votes. Most
        votes win, then the greatest sum of margins, then the first by name. The score is the
        logistic value of the family's lead over the next family, times that of the closest duel
        of the language within the family.
        """
        margins = x @ self.family_weights[:, :-1].T + self.family_weights[:, -1]
        rows = np.arange(len(x))
        family = margins.argmax(axis=1)
        score = np.ones(len(x))
        if len(self.families) > 1:
            lead = margins[rows, family].copy()
            margins[rows, family] = -np.inf
            score = _logistic(STEEPNESS * (lead - margins.max(axis=1)))
        language = np.array([members[0] for members in self.families], dtype=np.int64)[family]
        duels = x @ self.pair_weights[:, :-1].T + self.pair_weights[:, -1]
        for no, members in enumerate(self.families):
            own = np.flatnonzero(family == no)
            if len(members) == 1 or not len(own):
                continue
            votes, sums = np.zeros((2, len(own), len(members)))
            closest = np.full((len(own), len(members)), np.inf)
            for k, (a, b) in enumerate(self.pairs):
                if a in members:
                    i, j, margin = members.index(a), members.index(b), duels[own, k]
                    for side, lead in ((i, margin), (j, -margin)):
                        votes[:, side] += (lead > 0) | ((lead == 0) & (side == i))
                        sums[:, side] += lead
                        closest[:, side] = np.minimum(closest[:, side], lead)
            best = np.where(votes == votes.max(axis=1, keepdims=True), sums, -np.inf).argmax(axis=1)
            language[own] = np.array(members)[best]
            score[own] *= _logistic(STEEPNESS * closest[np.arange(len(own)), best])
        return language, score


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))


@dataclass(frozen=True)
class Machine:
    """What one machine tells apart: languages of side +1 from languages of side -1."""

    kind: str
    tag: tuple[int, ...]
    sides: dict[str, float]


def machines_of(names: list[str]) -> tuple[list[tuple[int, ...]], list[Machine]]:
    """The families of some languages, as places in the list, and the machines that tell them apart.

    Each family against all others, unless there are only two, which share a machine; and each pair
    of languages of one family.
    """
    family_of = {code: name for name, codes in FAMILIES.items() for code in codes}
    listed: dict[str, list[int]] = {}
    for no, name in enumerate(names):
        # The part before a region counts ("pt-BR" is Romance).
        listed.setdefault(family_of.get(name.lower().replace("_", "-").split("-")[0], f"={name}"), []).append(no)
    families = sorted(tuple(members) for members in listed.values())
    single = families if len(families) > 2 else families[: len(families) - 1]
    found = [Machine("family", f, {n: 1.0 if i in f else -1.0 for i, n in enumerate(names)}) for f in single]
    pairs = [pair for members in families for pair in combinations(members, 2)]
    return families, found + [Machine("pair", (a, b), {names[a]: 1.0, names[b]: -1.0}) for a, b in pairs]


def sample(docs: DataFrame) -> DataFrame:
    """The texts to learn from: ``lang``, ``mark`` (hash of the text), ``numbers`` and ``counts``.

    Of every language about ``TEXTS_PER_LANGUAGE`` distinct texts are chosen by a hash of the text,
    all if it has fewer; copies count once, so neither they nor rows that share an id make the
    sample larger. Of more than ``LANGUAGES`` languages the most frequent are learnt. Texts are
    reduced map-side to their hashes for counting, and the features are taken where the texts are
    and written, numbers only. Texts without a letter say nothing. NULL ids are never held out.
    """
    known = docs.where(F.col("lang").isNotNull() & ~held_out()).select(
        "lang", text_or_empty().alias("text"), F.xxhash64(F.lit("language"), text_or_empty()).alias("mark")
    )
    per_language = known.select("lang", "mark").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counted = per_language.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    parts = 1 << 40
    rates = {r["lang"]: int(parts * min(1.0, TEXTS_PER_LANGUAGE / r["n"])) for r in counted}
    rate = F.create_map(*[F.lit(v) for pair in (rates or {"": 0}).items() for v in pair])[F.col("lang")]
    chosen = known.where(F.coalesce(F.pmod("mark", F.lit(parts)) < rate, F.lit(False)))
    single = chosen.groupBy("lang", "mark").agg(F.min("text").alias("text"))

    @F.pandas_udf("numbers array<int>, counts array<long>")
    def counts_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                counts = letter_counts(text)
                at = np.flatnonzero(counts)
                rows.append((at.astype(np.int32), counts[at]))
            yield pd.DataFrame(rows, columns=["numbers", "counts"])

    found = single.select("lang", "mark", counts_of("text").alias("f")).select("lang", "mark", "f.*")
    # Written first: a filter on what the function gives would run it a second time.
    return written_table(found, "language-sample").where(F.size("numbers") > 0)


def train(docs: DataFrame) -> Languages:
    """Learn from a bounded sample of the texts with a ``lang``; held-out ids take no part.

    The sample (:func:`sample`) is read by one task, which holds 16-bit numbers and 32-bit shares of
    it and lets one machine after the other learn from the rows of its
    languages, in the order of language and hash, so a rerun learns the same. A machine each to a
    task is no faster by much, as one tells apart all families, and the groups need more memory.
    The 2^BITS + 1 weights of each machine come to the driver.
    """
    rows = sample(docs)
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not names:
        return Languages()
    families, machines = machines_of(names)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = []
        for batch in batches:
            known += [
                (lang, mark, np.asarray(numbers, dtype=np.int16), scaled(np.asarray(counts)))
                for lang, mark, numbers, counts in zip(
                    batch["lang"], batch["mark"], batch["numbers"], batch["counts"], strict=True
                )
            ]
        known.sort(key=lambda r: r[:2])
        for no, machine in enumerate(machines):
            own = [r for r in known if r[0] in machine.sides]
            sides = np.array([machine.sides[r[0]] for r in own])
            yield pd.DataFrame({"machine": [no], "weights": [support_vector_machine([r[2:] for r in own], sides)]})

    found = rows.repartition(1).mapInPandas(learn, "machine long, weights array<double>").collect()
    learnt = {r["machine"]: np.array(r["weights"], dtype=np.float32) for r in found}
    model = Languages(names, families, np.zeros((len(families), (1 << BITS) + 1), dtype=np.float32))
    model.pairs = [m.tag for m in machines if m.kind == "pair"]
    model.pair_weights = np.zeros((len(model.pairs), (1 << BITS) + 1), dtype=np.float32)
    for no, m in enumerate(machines):
        if m.kind == "pair":
            model.pair_weights[model.pairs.index(m.tag)] = learnt[no]
        else:
            model.family_weights[families.index(m.tag)] = learnt[no]
    if len(families) == 2:
        model.family_weights[0] /= 2
        model.family_weights[1] = -model.family_weights[0]
    return model


def add_language(docs: DataFrame, model: Languages, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language of each whole text, and a score in 0..1.

    A text that is NULL, empty or without a letter is ``und`` with score 0, and so is every text if
    nothing was learnt. One pass without a shuffle; the broadcast weights are bounded by the number
    of languages learnt. Columns of those names are replaced; all others, and repeated rows, stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("language string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            found = []
            for at in range(0, len(batch), TOGETHER):
                some = batch.iloc[at : at + TOGETHER]
                x = np.stack([scaled(letter_counts(t)) for t in some])
                known = x.any(axis=1) & bool(model.names)
                if model.names:
                    best, value = model.predict(x)
                    found += [
                        (model.names[b], v) if k else (UNDETERMINED, 0.0) for b, v, k in zip(best, value.tolist(), known)
                    ]
                else:
                    found += [(UNDETERMINED, 0.0)] * len(some)
            yield pd.DataFrame(found, columns=["language", "score"])

    return (
        docs.withColumn("_predicted", predicted(text_or_empty()))
        .withColumns({language: F.col("_predicted.language"), score: F.col("_predicted.score")})
        .drop("_predicted")
    )
