"""Embedding near-duplicates: a pigeonhole join over blocks of the rotated vectors.

Unit vectors of cosine c are 2 - 2c apart in squared distance. With the coordinates cut into blocks,
a pair within the whole budget is within its proportional share in at least one block. Each block is
range-joined under its share, and what is found is verified exactly on the whole vectors. Inside a
task the range join walks a tree of cuts over the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.components import Forest, components
from tillscope.sources import written_table

COSINE = 0.95
BLOCKS = 4
#: Vectors at home in a shard of a block, about; splits of a block at most; sample for the rotation.
SHARD, SPLITS, SAMPLE = 1 << 18, 12, 8_192
#: Vectors in a leaf of a task's tree, about.
LEAF = 256
#: Added to a block's share of the budget: coordinates are compared as 32-bit floats.
SLACK = 1e-5
#: Cells of a distance matrix held at once, and pairs verified at once.
CELLS, PAIRS = 4_000_000, 50_000
#: Rows turned at once, few enough for a processor's cache.
CACHED = 256


class Rotation:
    """Orthonormal rotation of unit vectors of one dimension, and the splits of its blocks.

    Fitted on a sample: the principal directions are dealt to the blocks in turn, so all blocks
    spread alike, each with its widest direction first. A block's shards are the halves of its
    first directions, cut at the sample's medians. Any orthonormal basis and any cuts give the same
    links; the fit only evens out the work.
    """

    def __init__(self, sample: np.ndarray, dimension: int, splits: int) -> None:
        count = min(BLOCKS, dimension)
        basis, self.middle = np.eye(dimension), np.zeros(dimension)
        if len(sample) > 1:
            self.middle = sample.mean(axis=0)
            spread = sample - self.middle
            basis = np.linalg.eigh(spread.T @ spread)[1][:, ::-1]
        self.columns = [np.arange(b, dimension, count) for b in range(count)]
        self.basis = np.ascontiguousarray(basis)
        self.share = 2 * (1 - COSINE) / count + SLACK
        self.splits = [min(splits, len(c)) for c in self.columns]
        turned = self.turn(sample) if len(sample) else np.zeros((1, dimension), dtype=np.float32)
        self.cuts = [np.median(turned[:, c[:s]], axis=0) for c, s in zip(self.columns, self.splits)]

    def turn(self, unit: np.ndarray) -> np.ndarray:
        """Rotated coordinates. Term by term, so a vector's numbers don't depend on its batch."""
        out = np.zeros(unit.shape, dtype=np.float32)
        for at in range(0, len(unit), CACHED):
            moved = unit[at : at + CACHED] - self.middle
            total, term = np.zeros(moved.shape), np.empty(moved.shape)
            for d in range(unit.shape[1]):
                np.multiply(moved[:, d : d + 1], self.basis[d], out=term)
                total += term
            out[at : at + CACHED] = total
        return out

    def homes(self, turned: np.ndarray, block: int) -> np.ndarray:
        at = turned[:, self.columns[block][: self.splits[block]]] > self.cuts[block]
        return at @ (1 << np.arange(self.splits[block]))

    def visits(self, turned: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """All (row, shard) that hold a point within the block's share of the row."""
        row, shard, spent = np.arange(len(turned)), np.zeros(len(turned), dtype=np.int64), np.zeros(len(turned))
        for s in range(self.splits[block]):
            gap = turned[row, self.columns[block][s]].astype(float) - self.cuts[block][s]
            over = spent + gap * gap
            cross = over <= self.share
            own = gap > 0
            shard = np.concatenate([shard | own << s, (shard | ~own << s)[cross]])
            row, spent = np.concatenate([row, row[cross]]), np.concatenate([spent, over[cross]])
        return row, shard


def stacked(packed: pd.Series, dimension: int, kind: str) -> np.ndarray:
    """Vectors packed as bytes as the rows of a matrix, in their own precision."""
    return np.frombuffer(b"".join(packed), dtype=kind).reshape(-1, dimension)


def unit_vectors(vectors: pd.Series | list | np.ndarray) -> np.ndarray:
    x = vectors if isinstance(vectors, np.ndarray) else np.array(list(vectors))
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, as one product of matrices."""
    ones = np.ones((len(a), 1), dtype=a.dtype), np.ones((len(b), 1), dtype=b.dtype)
    own, other = ((x * x).sum(axis=1, keepdims=True) for x in (a, b))
    return np.hstack([-2 * a, own, ones[0]]) @ np.hstack([b, ones[1], other]).T


class BlockTree:
    """Points of a block, halved at the median of one coordinate after another down to leaves."""

    def __init__(self, points: np.ndarray, rows: np.ndarray, depth: int = 0) -> None:
        self.rows, self.parts = rows, ()
        while len(rows) > LEAF and depth < points.shape[1]:
            values = points[rows, depth]
            cut = np.median(values)
            inside = values <= cut if cut < values.max() else values < cut
            if inside.any():
                self.at, self.cut = depth, float(values[inside].max())
                self.parts = (BlockTree(points, rows[inside], depth + 1), BlockTree(points, rows[~inside], depth + 1))
                return
            depth += 1  # all alike here

    def near(self, guests: np.ndarray, share: float, row: np.ndarray, spent: np.ndarray) -> Iterator[tuple]:
        """(members, guests) of every leaf and the guests that can be within ``share`` of its members.

        ``row`` are rows of ``guests``, ``spent`` their squared distance to this node by the cuts
        above; a coordinate is cut once on a way, so the squares add up.
        """
        work = [(self, row, spent)]
        while work:
            node, row, spent = work.pop()
            if not node.parts:
                if len(row):
                    yield node.rows, row
                continue
            gap = guests[row, node.at].astype(float) - node.cut
            over = spent + gap * gap
            for part, own in zip(node.parts, (gap <= 0, gap > 0)):
                reached = own | (over <= share)
                work.append((part, row[reached], np.where(own, spent, over)[reached]))

    def inner(self, points: np.ndarray, share: float) -> Iterator[tuple]:
        """(members, others) that hold every pair within ``share`` once; a leaf with itself comes twice."""
        work = [self]
        while work:
            node = work.pop()
            if not node.parts:
                yield node.rows, node.rows
                continue
            left, right = node.parts
            gap = points[right.rows, node.at].astype(float) - node.cut
            reached = gap * gap <= share
            yield from left.near(points, share, right.rows[reached], (gap * gap)[reached])
            work += [left, right]


class Tile:
    """Vectors at home in a part of a shard, against themselves and all that visit it.

    Held are the vectors as they came and their rotated coordinates; unit vectors in double
    precision are made of those few that are verified.
    """

    def __init__(self, rotation: Rotation, block: int) -> None:
        self.rotation, self.block = rotation, block
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ready = False

    def add(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> None:
        self.parts.append((ids, copies, vectors, self.rotation.turn(unit_vectors(vectors))))

    def start(self) -> None:
        self.ids, self.copies, self.vectors, self.turned = (np.concatenate(p) for p in zip(*self.parts))
        self.parts = []
        near = self.rotation.columns[self.block]
        self.points = np.ascontiguousarray(self.turned[:, near])
        self.tree = BlockTree(self.points, np.arange(len(self.ids)))
        self.links, self.forest = np.zeros(len(self.ids), dtype=np.int64), Forest(len(self.ids))
        self.ready = True
        for i, j in self.pairs(self.vectors, self.turned, inner=True):
            np.add.at(self.links, i, self.copies[j])
            np.add.at(self.links, j, self.copies[i])
            self.forest.unite(i, j)

    def visit(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> pd.DataFrame:
        if not self.ready:
            self.start()
        links, anchor = np.zeros(len(ids), dtype=np.int64), np.full(len(ids), -1)
        for i, j in self.pairs(vectors, self.rotation.turn(unit_vectors(vectors)), inner=False):
            np.add.at(links, j, self.copies[i])
            np.add.at(self.links, i, copies[j])
            # One home stands for all that a visitor links: they are united among themselves.
            new = anchor[j] < 0
            anchor[j[new]] = i[new]
            self.forest.unite(i, anchor[j])
        found = anchor >= 0
        return pd.DataFrame({"id": ids[found], "links": links[found], "other": self.ids[anchor[found]]})

    def finish(self) -> pd.DataFrame:
        if not self.ready:
            self.start()
        root = self.forest.roots(np.arange(len(self.ids)))
        found = (self.links > 0) | (root != np.arange(len(root)))
        return pd.DataFrame({"id": self.ids[found], "links": self.links[found], "other": self.ids[root[found]]})

    def pairs(self, vectors: np.ndarray, turned: np.ndarray, inner: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs (home, other) whose first block within its share is this one.

        The rule is evaluated on the same numbers wherever two vectors meet, so of all blocks that
        find a pair exactly one reports it.
        """
        share = self.rotation.share
        points = self.points if inner else np.ascontiguousarray(turned[:, self.rotation.columns[self.block]])
        if inner:
            groups = self.tree.inner(points, share)
        else:
            everyone = np.arange(len(points))
            groups = self.tree.near(points, share, everyone, np.zeros(len(points)))
        waiting, held = [], 0
        for own, others in groups:
            step = max(1, CELLS // len(others))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                near = _apart(self.points[some], points[others]) <= share + SLACK
                i, j = np.divmod(np.flatnonzero(near.ravel()), len(others))
                i, j = some[i], others[j]
                if own is others:
                    i, j = i[i < j], j[i < j]
                waiting.append((i, j))
                held += len(i)
                if held >= PAIRS:
                    yield from self.settled(waiting, vectors, turned)
                    waiting, held = [], 0
        yield from self.settled(waiting, vectors, turned)

    def settled(self, waiting: list[tuple], vectors: np.ndarray, turned: np.ndarray) -> Iterator[tuple]:
        if not waiting:
            return
        i, j = (np.concatenate(p) for p in zip(*waiting))
        for first in range(0, len(i), PAIRS):
            yield from self.verified(i[first : first + PAIRS], j[first : first + PAIRS], vectors, turned)

    def verified(
        self, i: np.ndarray, j: np.ndarray, vectors: np.ndarray, turned: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for block in range(self.block + 1):
            columns = self.rotation.columns[block]
            gap = self.turned[i][:, columns].astype(float) - turned[j][:, columns]
            within = (gap * gap).sum(axis=1) <= self.rotation.share
            keep = within if block == self.block else ~within
            i, j = i[keep], j[keep]
        linked = (unit_vectors(self.vectors[i]) * unit_vectors(vectors[j])).sum(axis=1) >= COSINE
        if linked.any():
            yield i[linked], j[linked]


def _usable(vector: Column) -> Column:
    """Whether a vector can be linked: no NULL, no infinite or undefined part, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _fit(classes: DataFrame) -> dict[int, Rotation]:
    """A rotation for each dimension, from at most about ``SAMPLE`` vectors chosen by hash."""
    sizes = {r.d: r.n for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, scale = sum(sizes.values()), 1 << 30
    place = F.pmod(F.xxhash64(F.lit("rotation"), F.col("id")), F.lit(scale))
    rate = int(scale * min(1.0, SAMPLE / max(total, 1)))
    sample: dict[int, list] = {}
    for row in classes.where(place < rate).select("vector").toLocalIterator():
        sample.setdefault(len(row.vector), []).append(row.vector)
    return {
        d: Rotation(
            unit_vectors(sample[d]) if d in sample else np.zeros((0, d)),
            d, min(SPLITS, max(0, int(np.ceil(np.log2(n / SHARD))))),
        )
        for d, n in sizes.items()
    }


def links(classes: DataFrame) -> DataFrame:
    """Per shard: ``id``, ``links`` (copies of others linked there) and ``other``, an edge to a linked one.

    ``classes`` has distinct vectors ``vector`` with ``id`` and ``copies``. Every vector is at home
    in one shard of each block, and visits those later shards of the block that reach into its
    share of the budget. Shards with many at home are dealt in parts: a part meets its own members,
    the members of the parts before it and all visitors, so each pair meets once per block. A
    task holds one part and streams the rest; inside, a tree of cuts over the block keeps most of
    them apart without comparing them. Only counts and spanning edges leave a task.
    """
    spark = classes.sparkSession
    kind = "<f4" if classes.schema["vector"].dataType.simpleString() == "array<float>" else "<f8"
    rotations = spark.sparkContext.broadcast(_fit(classes))

    def located(batch: pd.DataFrame) -> Iterator[tuple]:
        for dimension, part in batch.groupby(batch["vector"].map(len)):
            rotation = rotations.value[int(dimension)]
            turned = rotation.turn(unit_vectors(part["vector"]))
            for block in range(len(rotation.columns)):
                yield int(dimension), block, rotation, part, turned

    def home_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dimension, block, rotation, _, turned in located(batch):
                shard, n = np.unique(rotation.homes(turned, block), return_counts=True)
                yield pd.DataFrame({"d": dimension, "block": block, "shard": shard, "n": n})

    # At most BLOCKS * 2^SPLITS rows per dimension; a dimension without splits has at most SHARD vectors.
    split = [d for d, rotation in rotations.value.items() if any(rotation.splits)]
    several = classes.where(F.size("vector").isin(split)).select("vector")
    counted = several.mapInPandas(home_counts, "d long, block long, shard long, n long")
    crowded = counted.groupBy("d", "block", "shard").agg(F.sum("n").alias("n")).where(F.col("n") > SHARD)
    parts = spark.sparkContext.broadcast(
        {(r.d, r.block, r.shard): -(-r.n // SHARD) for r in crowded.collect()} if split else {}
    )

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Bytes pass between the JVM and Python several times as fast as arrays do.
            batch["packed"] = [np.asarray(v, dtype=kind).tobytes() for v in batch["vector"]]
            for dimension, block, rotation, part, turned in located(batch):
                home = rotation.homes(turned, block)
                row, shard = rotation.visits(turned, block)
                row, shard = row[shard >= home[row]], shard[shard >= home[row]]
                cut = np.array([parts.value.get((dimension, block, int(s)), 1) for s in shard], dtype=np.int64)
                own = (part["id"].to_numpy().astype(np.uint64)[row] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20))
                own = np.where(shard == home[row], (own % cut.astype(np.uint64)).astype(np.int64), -1)
                # A visitor goes to every part, a member to its own and to those behind it.
                first = np.maximum(own, 0)
                times = cut - first
                at = np.repeat(np.arange(len(row)), times)
                number = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + first[at]
                for some in range(0, len(at), 20_000):
                    a, k = at[some : some + 20_000], number[some : some + 20_000]
                    r = row[a]
                    yield pd.DataFrame({
                        "d": dimension, "block": block, "shard": shard[a], "part": k,
                        "guest": own[a] != k, "id": part["id"].to_numpy()[r],
                        "copies": part["copies"].to_numpy()[r], "packed": part["packed"].to_numpy()[r],
                    })

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tile = None, None
        for batch in batches:
            for key, rows in batch.groupby(["d", "block", "shard", "part", "guest"], sort=False):
                if key[:4] != now:
                    if tile is not None:
                        yield tile.finish()
                    now, tile = key[:4], Tile(rotations.value[int(key[0])], int(key[1]))
                    empty = np.zeros(0, dtype=np.int64)
                    tile.add(empty, empty, np.zeros((0, int(key[0])), dtype=kind))
                values = rows["id"].to_numpy(), rows["copies"].to_numpy(), stacked(rows["packed"], int(key[0]), kind)
                if key[4]:
                    yield tile.visit(*values)
                else:
                    tile.add(*values)
        if tile is not None:
            yield tile.finish()

    tile = ["d", "block", "shard", "part"]
    dealt = classes.select("id", "copies", "vector").mapInPandas(
        deal, "d long, block long, shard long, part long, guest boolean, id long, copies long, packed binary"
    )
    met = dealt.repartition(*tile).sortWithinPartitions(*tile, "guest")
    return met.mapInPandas(meet, "id long, links long, other long")


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of each vector.

    Two vectors are linked at a cosine of ``COSINE`` or more, in double precision. Vectors that are
    NULL, empty, zero, or hold NULL or non-finite parts link with nothing, as do vectors of
    different lengths with each other and rows without an id. Rows that repeat an id are one vector,
    the smallest by value. Equal vectors are one class, found by an aggregation, and enter the join
    as one row with their number. Each id gives one row, in any order; an empty table gives none.
    """
    unique = embeddings.groupBy("vec_id").agg(F.min("embedding").alias("vector"))
    usable = unique.where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    classes = written_table(
        usable.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")),
        "vector-classes",
    )
    found = written_table(links(classes), "vector-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    grouped = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    resolved = (
        classes.join(counts, "id", "left")
        .join(grouped, F.col("id") == F.col("node"), "left")
        .select(
            "vector",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    members = usable.join(resolved, "vector").select("vec_id", "n_links", "component_id")
    return (
        unique.select("vec_id").join(members, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
