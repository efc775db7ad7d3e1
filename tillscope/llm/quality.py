"""Quality: histogram gradient-boosted trees over document statistics, traversed as flat arrays."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import text_or_empty, training_rows

#: About so many labelled documents are learnt from, whatever the size of the corpus.
TRAINING_ROWS = 20_000
BINS, DEPTH, TREES, RATE = 64, 4, 60, 0.15
#: Least number of rows in a leaf, and L2 on its value.
LEAST, RIDGE = 5, 1.0
THRESHOLD = 0.3

#: Statistics of a document, in the order of the columns that the trees read.
STATISTICS = (
    "characters", "words", "word_length", "long_words", "short_words",
    "letters", "upper", "digits", "spaces", "stops", "marks", "other_signs",
    "capital_words", "shouted_words", "wordless", "signed_words",
    "distinct_words", "top_word", "repeats_previous", "top_pair",
    "lines", "line_words", "repeated_lines", "bulleted_lines", "open_lines", "longest_run",
)
LETTER_WORD = re.compile(r"[^\W\d_]")
SIGNS_BEHIND = re.compile(r"[^\w\s.,;:?'\")\]-]+(?=\s|$)")


def statistics(text: str) -> list[float]:
    """``STATISTICS`` of a whole text; shares are 0 where there is nothing to share."""
    words = text.split()
    lines = text.split("\n")
    n, w = max(len(text), 1), max(len(words), 1)
    raw = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    ascii_counts = np.bincount(raw[raw < 128], minlength=128)
    upper = int(ascii_counts[65:91].sum())
    letters = upper + int(ascii_counts[97:123].sum()) + int((raw >= 128).sum())
    digits = int(ascii_counts[48:58].sum())
    spaces = int(ascii_counts[9:14].sum() + ascii_counts[32])
    stops = int(ascii_counts[[46, 33, 63]].sum())
    marks = int(ascii_counts[[44, 58, 59, 39, 34, 45]].sum())
    lengths = np.array([len(x) for x in words] or [0])
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    same = [a == b for a, b in zip(words, words[1:])]
    run = longest = 1
    for equal in same:
        run = run + 1 if equal else 1
        longest = max(longest, run)
    full = [line for line in lines if line.strip()]
    f = max(len(full), 1)
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(lengths.mean()),
        float((lengths > 15).mean()), float((lengths <= 2).mean()),
        letters / n, upper / n, digits / n, spaces / n, stops / n, marks / n,
        (n - letters - digits - spaces - stops - marks) / n,
        sum(x[0].isupper() for x in words) / w, sum(len(x) > 1 and x.isupper() for x in words) / w,
        sum(LETTER_WORD.search(x) is None for x in words) / w, len(SIGNS_BEHIND.findall(text)) / w,
        len(counts) / w, max(counts.values(), default=0) / w, sum(same) / w,
        max(pairs.values(), default=0) / w,
        np.log1p(len(lines)), len(words) / f, 1 - len(set(full)) / f,
        sum(line.lstrip()[0] in "-*•|>" for line in full) / f,
        sum(line.rstrip()[-1] not in ".!?:\"'" for line in full) / f, np.log1p(longest),
    ]


class Trees:
    """Boosted trees as flat arrays: node 2i+1 and 2i+2 are the children of node i of a tree."""

    def __init__(self, base: float) -> None:
        self.base = base
        self.feature = np.zeros((0, 2**DEPTH - 1), dtype=np.int64)
        self.cut = np.zeros((0, 2**DEPTH - 1))
        self.value = np.zeros((0, 2**DEPTH))

    def add(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> None:
        self.feature = np.vstack([self.feature, feature])
        self.cut = np.vstack([self.cut, cut])
        self.value = np.vstack([self.value, value])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: all rows step down all trees together, a level at a time."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.cut))[None, :]
        node = np.zeros((len(x), len(self.cut)), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        total = self.base + self.value[trees, node - (2**DEPTH - 1)].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost ``TREES`` trees of ``DEPTH`` levels on the logistic loss.

    Every statistic is cut into at most ``BINS`` bins by its quantiles. A level of a tree needs one
    histogram of gradients and Hessians per node and statistic; the best cut of a node is the one of
    the largest gain, the first of equals. A node without a useful cut sends all rows left. Without
    rows, or with one label only, there are no trees and the score is the label's share.
    """
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    model = Trees(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    cuts = [np.unique(np.quantile(column, quantiles)) for column in x.T]
    bins = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    margin = np.full(len(y), model.base)
    offset = np.arange(x.shape[1]) * BINS
    for _ in range(TREES):
        p = 1.0 / (1.0 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, cut = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            first, width = 2**level - 1, x.shape[1] * BINS
            place = (((node - first) * width)[:, None] + offset + bins).ravel()
            sums = [
                np.bincount(place, np.repeat(v, x.shape[1]), minlength=2**level * width).reshape(
                    2**level, x.shape[1], BINS
                )
                for v in (gradient, hessian, np.ones(len(y)))
            ]
            (g, h, n), (tg, th, tn) = (
                [np.cumsum(s, axis=2) for s in sums],
                [s.sum(axis=2, keepdims=True) for s in sums],
            )
            gain = g**2 / (h + RIDGE) + (tg - g) ** 2 / (th - h + RIDGE) - tg**2 / (th + RIDGE)
            gain[(n < LEAST) | (tn - n < LEAST)] = 0.0
            best = gain.reshape(2**level, -1).argmax(axis=1)
            for k, at in enumerate(best):
                f, b = divmod(int(at), BINS)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[first + k], cut[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        g = np.bincount(leaf, gradient, minlength=2**DEPTH)
        value = -RATE * g / (np.bincount(leaf, hessian, minlength=2**DEPTH) + RIDGE)
        model.add(feature, cut, value)
        margin += value[leaf]
    return model


def train(docs: DataFrame, labels: DataFrame) -> Trees:
    """Learn from a bounded sample of ``labels.quality`` over ``docs``; held-out ids take no part.

    The statistics are computed by Spark where the texts are; only the numbers of about
    ``TRAINING_ROWS`` documents come to the driver, sorted by a hash of the ids, so a rerun learns
    the same trees.
    """
    sample = training_rows(docs, labels, "quality", TRAINING_ROWS)

    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([statistics(t) for t in batch])

    rows = sample.select("order", "label", measured("text").alias("x")).toPandas()
    rows = rows.sort_values("order", kind="stable")
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(STATISTICS))
    return fit(x, rows["label"].to_numpy(dtype=float))


def add_score(docs: DataFrame, model: Trees, score: str = "score") -> DataFrame:
    """Add each whole text's score in 0..1; NULL counts as the empty text.

    One pass without a shuffle; the trees are a few thousand numbers. A column of that name is
    replaced; all others, and repeated rows, stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch], dtype=float).reshape(-1, len(STATISTICS))
            yield pd.Series(shared.value.score(x), dtype=float)

    return docs.withColumn(score, scores(text_or_empty()))
