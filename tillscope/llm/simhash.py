"""SimHash near-duplicates: fingerprints joined through a tree of vantage points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import text_or_empty
from tillscope.llm.components import Forest, components
from tillscope.sources import written_table

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Fingerprints that a shard should hold at home, and fingerprints the tree is built from at most.
SHARD, SAMPLE = 1 << 17, 65_536
#: Fingerprints compared one by one at the bottom of a shard's own tree.
BOTTOM = 96
#: Pairs compared at once.
BLOCK = 1 << 20

UPPER = {c: c + 32 for c in range(65, 91)}
SPACES = " \t\n\x0b\x0c\r"


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes, repeats counted; 0 without words."""
    low = text.translate(UPPER)
    for space in SPACES[1:]:
        low = low.replace(space, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    count = max(len(words) - shingle + 1, 1)
    digest = xxhash.xxh64_intdigest
    if count == 1:
        return digest(" ".join(words).encode(), SEED)
    rows = zip(*[words[i:] for i in range(shingle)])
    hashes = np.fromiter([digest(" ".join(r), SEED) for r in rows], dtype="<u8", count=count)
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, count, 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > count, bitorder="little").view("<u8")[0])


def add_fingerprint(docs: DataFrame, shingle: int = SHINGLE, name: str = "fingerprint") -> DataFrame:
    """Add the 64-bit fingerprint of each whole text as a long (NULL texts count as empty)."""

    @F.pandas_udf("long")
    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch], dtype=np.uint64)
            yield pd.Series(found.view(np.int64))

    return docs.withColumn(name, marks(text_or_empty()))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int8)


class VantageTree:
    """Shards of the fingerprint space: inner nodes split by the distance to a vantage point.

    Node 2i+1 holds what is at most ``reach[i]`` away from ``point[i]``, node 2i+2 the rest; the
    last level are the shards. Built from a sample, so shards of a dense region are small; any
    fingerprint has exactly one home.
    """

    def __init__(self, sample: np.ndarray, levels: int) -> None:
        self.levels = levels
        inner = (1 << levels) - 1
        self.point, self.reach = np.zeros(inner, dtype=np.uint64), np.zeros(inner, dtype=np.int8)
        parts = {0: np.unique(sample)}
        for node in range(inner):
            own = parts.pop(node)
            if len(own):
                # The end of the sorted part lies at the edge of the region.
                self.point[node] = own[-1]
                away = distances(own, own[-1])
                self.reach[node] = np.median(away)
                inside = away <= self.reach[node]
                own, out = own[inside], own[~inside]
            else:
                out = own
            parts[2 * node + 1], parts[2 * node + 2] = own, out

    def homes(self, marks: np.ndarray) -> np.ndarray:
        node = np.zeros(len(marks), dtype=np.int64)
        for _ in range(self.levels):
            node = 2 * node + 2 - (distances(marks, self.point[node]) <= self.reach[node])
        return node

    def overlaps(self, marks: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """All (row, shard) whose region can hold something ``within`` of the row, by the triangle bound."""
        row, node = np.arange(len(marks)), np.zeros(len(marks), dtype=np.int64)
        for _ in range(self.levels):
            away = distances(marks[row], self.point[node])
            inside = away <= self.reach[node] + within
            outside = away > self.reach[node] - within
            node = np.concatenate([2 * node[inside] + 1, 2 * node[outside] + 2])
            row = np.concatenate([row[inside], row[outside]])
        return row, node


class MarkTree:
    """Fingerprints halved by their distance to a vantage point of their own, down to ``BOTTOM``."""

    def __init__(self, marks: np.ndarray, rows: np.ndarray) -> None:
        self.rows, self.near = rows, None
        if len(rows) <= BOTTOM:
            return
        self.point = marks[rows[len(rows) // 2]]
        away = distances(marks[rows], self.point)
        reach = int(np.median(away))
        reach = reach - 1 if reach == away.max() else reach
        inside = away <= reach
        if inside.any() and not inside.all():
            self.reach = reach
            self.near, self.far = MarkTree(marks, rows[inside]), MarkTree(marks, rows[~inside])

    def meeting(self, marks: np.ndarray, row: np.ndarray, within: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(members, guests) of every leaf and the guests, rows of ``marks``, that the triangle bound lets in."""
        work = [(self, row)]
        while work:
            node, row = work.pop()
            if node.near is None:
                if len(row):
                    yield node.rows, row
                continue
            away = distances(marks[row], node.point)
            work.append((node.near, row[away <= node.reach + within]))
            work.append((node.far, row[away > node.reach - within]))

    def inner(self, marks: np.ndarray, within: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(members, others) that hold every pair of members at most ``within`` apart."""
        work = [self]
        while work:
            node = work.pop()
            if node.near is None:
                yield node.rows, node.rows
                continue
            crossing = node.far.rows[distances(marks[node.far.rows], node.point) <= node.reach + within]
            yield from node.near.meeting(marks, crossing, within)
            work += [node.near, node.far]


def close(
    groups: Iterator[tuple[np.ndarray, np.ndarray]], homes: np.ndarray, others: np.ndarray, within: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (home, other) of the groups that are at most ``within`` apart."""
    for own, guests in groups:
        step = max(1, BLOCK // max(len(guests), 1))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            i, j = np.nonzero(distances(homes[some][:, None], others[guests][None, :]) <= within)
            yield some[i], guests[j]


def join_within(homes: np.ndarray, others: np.ndarray, within: int, forest: Forest, first: int) -> None:
    """Unite every home with the homes and others ``within`` its distance.

    ``homes`` are places 0.. of the forest, ``others`` places ``first``.. .
    """
    tree = MarkTree(homes, np.arange(len(homes)))
    for i, j in close(tree.inner(homes, within), homes, homes, within):
        forest.unite(i, j)
    for i, j in close(tree.meeting(others, np.arange(len(others)), within), homes, others, within):
        forest.unite(i, first + j)


class Shard:
    """Fingerprints at home in a part of a shard, among themselves and with all that visit it."""

    def __init__(self, within: int) -> None:
        self.within, self.parts, self.ready = within, [], False

    def add(self, marks: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((marks, ids))

    def start(self) -> None:
        self.marks, self.ids = (np.concatenate(p) for p in zip(*self.parts))
        order = np.argsort(self.marks, kind="stable")
        self.marks, self.ids, self.parts = self.marks[order], self.ids[order], []
        self.tree, self.forest = MarkTree(self.marks, np.arange(len(order))), Forest(len(order))
        self.ready = True
        for i, j in close(self.tree.inner(self.marks, self.within), self.marks, self.marks, self.within):
            self.forest.unite(i, j)

    def visit(self, marks: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        """An edge from each visitor that is linked to a home; all its homes are united."""
        if not self.ready:
            self.start()
        anchor = np.full(len(marks), -1)
        for i, j in close(self.tree.meeting(marks, np.arange(len(marks)), self.within), self.marks, marks, self.within):
            new = anchor[j] < 0
            anchor[j[new]] = i[new]
            self.forest.unite(i, anchor[j])
        found = anchor >= 0
        return pd.DataFrame({"a": ids[found], "b": self.ids[anchor[found]]})

    def finish(self) -> pd.DataFrame:
        """An edge from each home that is not the root of its group to the root."""
        if not self.ready:
            self.start()
        root = self.forest.roots(np.arange(len(self.ids)))
        linked = root != np.arange(len(root))
        return pd.DataFrame({"a": self.ids[linked], "b": self.ids[root[linked]]})


def links(classes: DataFrame, within: int = DISTANCE) -> DataFrame:
    """Edges ``a``, ``b`` that join all fingerprints linked by chains of steps ``within`` a distance.

    ``classes`` has distinct longs ``mark``, each with the ``id`` that stands for it. A tree of
    vantage points is built on the driver from a bounded sample (``SAMPLE``), with about one shard
    per ``SHARD`` fingerprints up to a shard for every eight of the sample, and sent to the tasks.
    Each fingerprint goes to its home shard and, as a visitor, to those later shards that the
    triangle bound cannot exclude, so a pair meets exactly once, in the later home of the two. A
    shard with more than ``SHARD`` at home is dealt in parts: a part meets its own members, those of
    the parts before it and all visitors. A task holds one part, with a vantage-point tree of its
    own, and streams the rest, so its memory does not depend on the table. A shard's pairs are found
    exactly and only their spanning stars leave the task: at most one edge per row that came in.
    """
    spark = classes.sparkSession
    total = classes.count()
    place = F.pmod(F.xxhash64(F.lit("vantage"), F.col("mark")), F.lit(1 << 30))
    few = classes.where(place < int((1 << 30) * min(1.0, SAMPLE / max(2 * total, 1))))
    sample = few.select("mark").limit(SAMPLE).toPandas()["mark"].to_numpy(dtype=np.int64)
    levels = int(np.ceil(np.log2(max(total / SHARD, 1))))
    levels = min(levels, max(int(np.log2(max(len(sample), 1) / 8)) if len(sample) >= 8 else 0, 0))
    shared = spark.sparkContext.broadcast(VantageTree(sample.view(np.uint64), levels))

    def home_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shard, n = np.unique(shared.value.homes(batch["mark"].to_numpy().view(np.uint64)), return_counts=True)
            yield pd.DataFrame({"shard": shard, "n": n})

    # At most a row per shard of the tree.
    counted = classes.select("mark").mapInPandas(home_counts, "shard long, n long").groupBy("shard")
    crowded = counted.agg(F.sum("n").alias("n")).where(F.col("n") > SHARD).collect()
    parts = spark.sparkContext.broadcast({r.shard: -(-r.n // SHARD) for r in crowded})

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = shared.value
        for batch in batches:
            marks, ids = batch["mark"].to_numpy().view(np.uint64), batch["id"].to_numpy()
            home = tree.homes(marks)
            for at in range(0, len(marks), 2048):
                own = slice(at, at + 2048)
                row, shard = tree.overlaps(marks[own], within)
                keep = shard >= home[own][row]
                row, shard = row[keep], shard[keep]
                cut = np.array([parts.value.get(int(s), 1) for s in shard], dtype=np.int64)
                drawn = marks[own][row] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
                part = np.where(shard == home[own][row], (drawn % cut.astype(np.uint64)).astype(np.int64), -1)
                # A visitor goes to every part, a member to its own and to those behind it.
                first = np.maximum(part, 0)
                times = cut - first
                to = np.repeat(np.arange(len(row)), times)
                number = np.arange(len(to)) - np.repeat(np.cumsum(times) - times, times) + first[to]
                yield pd.DataFrame({
                    "shard": shard[to], "part": number, "visitor": part[to] != number,
                    "mark": marks[own][row[to]].view(np.int64), "id": ids[own][row[to]],
                })

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, shard = None, None
        for batch in batches:
            for key, rows in batch.groupby(["shard", "part", "visitor"], sort=False):
                if key[:2] != now:
                    if shard is not None:
                        yield shard.finish()
                    now, shard = key[:2], Shard(within)
                    shard.add(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
                values = rows["mark"].to_numpy().view(np.uint64), rows["id"].to_numpy()
                if key[2]:
                    yield shard.visit(*values)
                else:
                    shard.add(*values)
        if shard is not None:
            yield shard.finish()

    dealt = classes.select("mark", "id").mapInPandas(
        deal, "shard long, part long, visitor boolean, mark long, id long"
    )
    met = dealt.repartition("shard", "part").sortWithinPartitions("shard", "part", "visitor")
    return met.mapInPandas(meet, "a long, b long")


def group(docs: DataFrame, shingle: int = SHINGLE, within: int = DISTANCE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (long) and ``component_id`` of each document.

    Documents whose fingerprints differ in ``within`` bits or fewer are linked; ``component_id`` is
    the smallest id reachable. Equal fingerprints are one class, found by an aggregation with
    map-side combine, so any number of copies costs one row in the join. Texts without words all
    have fingerprint 0 and are linked like any other. A NULL id links its class but is never the
    smallest, unless the component has no other: then ``component_id`` is NULL. Each input row,
    repeated or not, gives one row; an empty table gives none.
    """
    marked = written_table(
        add_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "fingerprint"),
        "fingerprints",
    )
    classes = written_table(
        marked.groupBy(F.col("fingerprint").alias("mark")).agg(F.min("doc_id").alias("id")), "classes"
    )
    # Marks stand for themselves in the search; ids come in afterwards, as they may be NULL.
    edges = links(classes.select("mark", F.col("mark").alias("id")), within)
    grouped = components(edges)
    member = classes.join(grouped, classes["mark"] == grouped["node"], "left").select(
        "mark", "id", F.coalesce("component", "mark").alias("component")
    )
    member = written_table(member, "members")
    smallest = member.groupBy("component").agg(F.min("id").alias("component_id"))
    resolved = member.join(smallest, "component").select("mark", "component_id")
    return marked.join(resolved, marked["fingerprint"] == resolved["mark"], "left").select(
        "doc_id", "fingerprint", "component_id"
    )


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, within: int = DISTANCE) -> DataFrame:
    """One document of each group, the one with the smallest id; all columns as they were.

    Rows that repeat the id which stays are that same document and stay with it; documents without
    an id stay if any of them does.
    """
    grouped = group(docs, shingle, within)
    kept = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    kept = kept.withColumnRenamed("doc_id", "_kept")
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
