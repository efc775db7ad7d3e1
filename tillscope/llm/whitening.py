"""Embedding whitening: covariances from variances of sums, exact in whole numbers, then eigenvectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.sources import written_table

#: Components that are kept at most.
COMPONENTS = 16
#: An entry c becomes the whole number floor(64*c) + 1,000,000.
SCALE, OFFSET = 64, 1_000_000
#: Entries of this size and more have no such number that a long holds with room to spare.
LARGEST = 2.0**54
#: Vectors handled together inside a task.
ROWS = 2048
#: Sums of doubles are added as whole multiples of 2^-FRACTION, so their order does not matter.
FRACTION = 40


def usable(vector: Column) -> Column:
    """Whether all entries are finite numbers, and small enough."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def whole_vector(vector: Column) -> Column:
    """``floor(64*c) + 1000000`` of every entry of a usable vector, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET)


@dataclass(frozen=True)
class Whitening:
    """What is learnt from the distinct vectors: n of them, ``sums`` per dimension, eigenvectors.

    ``vectors`` holds the unit eigenvectors as columns, by falling eigenvalue in ``values``;
    ``explained`` are the eigenvalues as shares of the trace. Only the first ``rank`` of them have
    a variance above rounding; the others cannot be whitened.
    """

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: list[float]
    rank: int
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean, on the components, over the root of their eigenvalues."""
        centre = _rounded_means(self.n, self.sums)
        rest = np.array([(s - self.n * c) / self.n for s, c in zip(self.sums, centre)])
        away = (x - np.array(centre, dtype=np.int64)) - rest
        return away @ (self.vectors[:, : self.rank] / np.sqrt(self.values[: self.rank]))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Per row the sum over the dimensions of (n*x - sum)^2, exact."""
        centre = _rounded_means(self.n, self.sums)
        away = x - np.array(centre, dtype=np.int64)
        rest = [s - self.n * c for s, c in zip(self.sums, centre)]
        peak = (int(np.abs(away).max(initial=0)) + 1) * self.n
        kind = np.int64 if peak * peak * x.shape[1] < 1 << 62 else object
        y = away.astype(kind) * self.n - np.array(rest, dtype=kind)
        return [int(v) for v in (y * y).sum(axis=1)]


def _rounded_means(n: int, sums: list[int]) -> list[int]:
    return [(2 * s + n) // (2 * n) for s in sums]


def _exact_totals(table: DataFrame, slots: int, values: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Exact sums, over all rows of a table of vectors ``x``, of ``slots`` whole numbers.

    ``values`` gives the sums of a block of rows, one vector a row. A task adds its blocks up in
    Python's whole numbers and gives one row per slot, in two halves that cannot overflow.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(slots, dtype=object)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                sums += values(np.stack(batch["x"].iloc[at : at + ROWS].to_numpy())).astype(object)
        halves = [(int(v) >> 60, int(v) & ((1 << 60) - 1)) for v in sums]
        yield pd.DataFrame({
            "slot": np.arange(slots), "high": [Decimal(h) for h, _ in halves], "low": [Decimal(v) for _, v in halves],
        })

    parts = table.select("x").mapInPandas(partial, "slot long, high decimal(38,0), low decimal(38,0)")
    rows = parts.groupBy("slot").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    found = {r["slot"]: (int(r["high"]) << 60) + int(r["low"]) for r in rows}
    return [found.get(s, 0) for s in range(slots)]


def _whole(x: np.ndarray, bound: int) -> np.ndarray:
    """The array, as Python's numbers where sums of numbers up to the bound could leave 64 bits."""
    return x if bound * len(x) < 1 << 62 else x.astype(object)


def _column_sums(x: np.ndarray) -> np.ndarray:
    return _whole(x, int(np.abs(x).max(initial=0))).sum(axis=0)


def _squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Summed squares of each centred dimension, then of each sum of two, (0,1), (0,2), ... (1,2), ..."""
    away = x - centre
    peak = 2 * int(np.abs(away).max(initial=0))
    by_dimension = np.ascontiguousarray(_whole(away, peak * peak).T)
    sums = [(by_dimension * by_dimension).sum(axis=1)]
    for i in range(len(by_dimension) - 1):
        pair = by_dimension[i + 1 :] + by_dimension[i]
        sums.append((pair * pair).sum(axis=1))
    return np.concatenate(sums)


def covariance(n: int, sums: list[int], squares: list[int]) -> np.ndarray:
    """Covariance matrix, divisor n, from the summed squares around the rounded means.

    The mean less its rounding is taken out exactly: n times the squares less the squared sum is
    n^2 times a variance. Half of var(a+b) - var(a) - var(b) is the covariance of a and b; its
    numerator is a whole number, so each entry is rounded once, in the final division.
    """
    d = len(sums)
    rest = [s - n * c for s, c in zip(sums, _rounded_means(n, sums))]
    own = [n * squares[i] - rest[i] ** 2 for i in range(d)]
    found = np.zeros((d, d))
    at = d
    for i in range(d):
        found[i, i] = own[i] / n**2
        for j in range(i + 1, d):
            both = n * squares[at] - (rest[i] + rest[j]) ** 2
            found[i, j] = found[j, i] = (both - own[i] - own[j]) / (2 * n**2)
            at += 1
    return found


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening learnt from each distinct vector ``x`` (array of longs) once; None without vectors.

    Vectors of a length other than the one that most distinct vectors have (of equals the greater)
    are left out, as are empty ones. The distinct vectors are found with map-side combine, so a
    vector that a third of the rows hold is a row per task, and written once. Three passes over
    them follow: sums per dimension; squares of every centred dimension and sum of two dimensions;
    and the covariance of the whitened vectors, for ``identity_error``. Each gives a row per task
    and number, so what is shuffled and sent to the driver depends on the dimensions (d(d+3)/2
    numbers), not on the vectors; eigh of the d x d matrix runs on the driver.
    """
    distinct = written_table(vectors.select("x").where("size(x) > 0").distinct(), "vectors")
    sizes = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return None
    d, n = most["d"], most["n"]
    learnt = distinct.where(F.size("x") == d)
    sums = _exact_totals(learnt, d, _column_sums)
    centre = np.array(_rounded_means(n, sums), dtype=np.int64)
    squares = _exact_totals(learnt, d * (d + 1) // 2, lambda x: _squares(x, centre))
    matrix = covariance(n, sums, squares)
    values, vectors_ = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    values, vectors_ = values[order], vectors_[:, order]
    # Either sign is right; the largest entry is made positive, so that reruns agree.
    vectors_ = vectors_ * np.sign(vectors_[np.abs(vectors_).argmax(axis=0), np.arange(len(order))])
    trace = float(np.trace(matrix))
    rank = int((values > d * np.finfo(float).eps * max(float(values[0]), 0.0)).sum())
    explained = [float(v / trace) if trace > 0 else 0.0 for v in np.maximum(values, 0.0)]
    model = Whitening(n, sums, vectors_, values, explained, rank)
    return Whitening(n, sums, vectors_, values, explained, rank, _identity_error(learnt, model))


def _identity_error(learnt: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity."""
    if not model.rank:
        return 0.0

    def products(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)
        return np.array([int(v) for v in np.rint(np.ldexp((w.T @ w).ravel(), FRACTION))], dtype=object)

    # The whitened vectors have mean 0: the exact mean was taken from them.
    sums = _exact_totals(learnt, model.rank**2, products)
    found = np.array([s / (model.n << FRACTION) for s in sums]).reshape(model.rank, model.rank)
    return float(np.abs(found - np.eye(model.rank)).max())


def add_whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """Add ``deviation`` (decimal) and ``whitened`` (array of doubles) to rows with a vector ``x``.

    Rows whose vector is NULL or of another length than the model's go. A component without
    variance is NULL. Columns of those names are replaced, all others, and repeated rows, stay.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("deviation decimal(38,0), whitened array<double>")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            deviations, whitened = [], []
            for at in range(0, len(batch), ROWS):
                x = np.stack(batch.iloc[at : at + ROWS].to_numpy())
                deviations += [Decimal(v) for v in shared.value.deviations(x)]
                whitened += list(shared.value.whitened(x))
            yield pd.DataFrame({"deviation": deviations, "whitened": whitened})

    missing = F.array_repeat(F.lit(None).cast("double"), len(model.values) - model.rank)
    return (
        rows.where(F.size("x") == len(model.sums))
        .withColumn("_placed", placed("x"))
        .withColumns({
            "deviation": F.col("_placed.deviation"),
            "whitened": F.concat("_placed.whitened", missing),
        })
        .drop("_placed")
    )


def whiten(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and
    ``identity_error`` of each usable row and component.

    Left out are rows whose vector is NULL, empty, or holds an entry that is NULL, NaN, infinite or
    of 2^54 or more, and those of another length than most. ``deviation`` is exact, as a decimal of
    38 digits. Repeated rows and ids, and NULL ids, each give their own rows; without usable rows
    there are none. The rows are read twice and written never; only their distinct vectors are.
    """
    rows = embeddings.where(usable(F.col(vector))).select("vec_id", whole_vector(F.col(vector)).alias("x"))
    model = fit(rows, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], _SCHEMA)
    shares = F.array(*[F.lit(v) for v in model.explained])
    # The outer form, as the plain one puts a test for empty arrays, and with it the function, below itself.
    exploded = F.posexplode_outer("whitened").alias("_at", "whitened")
    found = add_whitened(rows, model).select("vec_id", "deviation", exploded)
    return found.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        (F.col("_at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


_SCHEMA = (
    "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double,"
    " identity_error double"
)
