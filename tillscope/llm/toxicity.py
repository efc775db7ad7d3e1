"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import text_or_empty, training_rows

#: Features are numbers below 2^BITS: words, pairs of neighbours, and pairs with one word between.
BITS = 22
#: About so many labelled documents are learnt from, whatever the size of the corpus.
TRAINING_ROWS = 20_000
PASSES = 5
#: Per-coordinate learning rate ALPHA / (BETA + root of summed squared gradients), L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.1
#: Weight of a toxic example, the rarer class, against a clean one.
TOXIC_WEIGHT = 4.0
THRESHOLD = 0.5

WORDS = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Word hashes that a worker remembers before it starts afresh.
REMEMBERED = 100_000


class Features:
    """Hashed features of texts; remembers the hashes of words, at most ``REMEMBERED``."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        data = word.encode()
        found = self.known[word] = zlib.crc32(data) << 32 | zlib.crc32(data, 0x5BD1E995)
        return found

    def of(self, text: str) -> np.ndarray:
        """Feature numbers of a whole text, repeats included; empty without words."""
        known, word = self.known, self.word
        found = [known.get(w) or word(w) for w in WORDS.findall(text.lower())]
        h = np.array(found, dtype=np.uint64)
        parts = [h * MIX]
        for gap, salt in ((1, 3), (2, 5)):
            if len(h) > gap:
                parts.append((h[:-gap] * MIX + h[gap:] * np.uint64(salt)) * MIX)
        return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the weights that are not zero; the last number, 2^BITS, is the bias.

    A row is a document's distinct features and its label. Each document is one example in which a
    feature is present or not. The rows are visited in the given order, ``PASSES`` times. L1 keeps
    every weight at zero whose gradients have not summed up to ``L1``, so what stays is the
    vocabulary that tells the classes apart.
    """
    z, n = np.zeros((1 << BITS) + 1, dtype=np.float32), np.zeros((1 << BITS) + 1, dtype=np.float32)
    bias = np.array([1 << BITS], dtype=np.int32)

    def weights(at: np.ndarray) -> np.ndarray:
        total, strength = z[at].astype(float), np.where(at == 1 << BITS, 0.0, L1)
        full = -(total - np.sign(total) * strength) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(total) <= strength, 0.0, full)

    for _ in range(PASSES):
        for features, label in rows:
            at = np.append(features, bias)
            w = weights(at)
            error = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            error *= TOXIC_WEIGHT if label else 1.0
            step = (np.sqrt(n[at] + error * error) - np.sqrt(n[at])) / ALPHA
            z[at] += error - step * w
            n[at] += error * error
    kept, values = [], []
    for first in range(0, len(z), 1 << 18):
        learnt = weights(np.arange(first, min(first + (1 << 18), len(z))))
        kept.append(first + np.flatnonzero(learnt))
        values.append(learnt[learnt != 0])
    return np.concatenate(kept), np.concatenate(values)


def train(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """Learn from a bounded sample of ``labels.toxic`` over ``docs``; held-out ids take no part.

    The words are hashed by the tasks that hold the texts; one task gets the numbers of the features
    of the sample (``TRAINING_ROWS`` texts expected), in the order of a hash of the ids, so a rerun
    learns the same weights. Only the weights that are not zero come back: at most 2^BITS, in
    practice some hundreds. Without any labelled row there are no weights, and every score is one
    half.
    """
    sample = training_rows(docs, labels, "toxic", TRAINING_ROWS)

    @F.pandas_udf("binary")
    def distinct_features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features()
        for batch in batches:
            yield pd.Series([np.unique(features.of(text)).astype("<i4").tobytes() for text in batch])

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            rows += zip(batch["order"], batch["features"], batch["label"], strict=True)
        rows.sort(key=lambda r: r[0])
        # The bytes are read where they lie, so the task holds the sample once.
        numbers, values = fit([(np.frombuffer(f, dtype="<i4"), y) for _, f, y in rows])
        yield pd.DataFrame({"feature": numbers, "weight": values})

    numbered = sample.select("order", "label", distinct_features("text").alias("features"))
    learnt = numbered.repartition(1).mapInPandas(learn, "feature long, weight double").toPandas()
    learnt = learnt.sort_values("feature")
    return {"feature": learnt["feature"].to_numpy(), "weight": learnt["weight"].to_numpy()}


def score_text(text: str, features: Features, numbers: np.ndarray, values: np.ndarray) -> float:
    """Score of one whole text; a feature counts once, however often it occurs."""
    if not len(numbers):
        return 0.5
    bias = values[-1] if numbers[-1] == 1 << BITS else 0.0
    found = features.of(text)
    place = np.searchsorted(numbers, found)
    hits = np.unique(place[(place < len(numbers)) & (numbers[np.minimum(place, len(numbers) - 1)] == found)])
    return float(1.0 / (1.0 + np.exp(-np.clip(values[hits].sum() + bias, -35, 35))))


def add_score(docs: DataFrame, model: dict[str, np.ndarray], score: str = "score") -> DataFrame:
    """Add each whole text's score in 0..1; NULL and empty texts get the bias alone.

    One pass without a shuffle: the weights are broadcast, their number bounded by 2^BITS. A column
    of that name is replaced; all others, and repeated rows, stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, numbers, values = Features(), shared.value["feature"], shared.value["weight"]
        for batch in batches:
            yield pd.Series([score_text(t, features, numbers, values) for t in batch], dtype=float)

    return docs.withColumn(score, scores(text_or_empty()))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, all columns as they were."""
    scored = add_score(docs, train(docs, labels), "_toxicity")
    return scored.where(F.col("_toxicity") < threshold).select(*docs.columns)
