"""Periodic runs of words: branching squares found in a suffix array, rotated and merged into runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import text_or_empty, words

#: Words of the shortest run that counts.
LEAST = 12
#: Words of short documents that share one suffix array; a longer document has one of its own.
TOGETHER = 200_000
#: Suffixes of smaller children looked at together.
BLOCK = 1 << 20


class Suffixes:
    """Suffix array, its inverse and the common prefixes of neighbours, of several sequences at once.

    ``keys`` holds the sequences one behind the other, with equal keys only within a sequence, so
    suffixes of different sequences have no common prefix; ``ends`` is where the sequence of each
    place ends. Prefixes are doubled: suffixes that are told apart already take no part in a round.
    ``levels[k]`` numbers the places so that equal numbers mean 2^k equal words from there.
    """

    def __init__(self, keys: np.ndarray, ends: np.ndarray) -> None:
        n = len(keys)
        self.ends = ends
        self.order = np.argsort(keys, kind="stable")
        slots, span, key = np.arange(n), 1, keys[self.order]
        rank = np.zeros(n, dtype=np.int64)
        self.levels: list[np.ndarray] = []
        while True:
            # The number of a group is one more than its first slot; 0 stands for "past the end".
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = key[1:] != key[:-1]
            rank[self.order[slots]] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))] + 1
            self.levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            slots = slots[tied]
            if not len(slots):
                break
            at = self.order[slots]
            behind = at + span
            inside = behind < ends[at]
            key = rank[at] * (n + 1) + np.where(inside, rank[np.where(inside, behind, 0)], 0)
            sort = np.argsort(key, kind="stable")
            self.order[slots], key = at[sort], key[sort]
            span *= 2
        self.inverse = rank - 1
        self.common = np.zeros(n, dtype=np.int64)
        self.common[1:] = self.forward(self.order[:-1], self.order[1:])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of equal words from places ``a`` and ``b`` on."""
        length = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a + length, b + length
            inside = (x < self.ends[a]) & (y < self.ends[b])
            level = self.levels[k]
            length += (inside & (level[np.where(inside, x, 0)] == level[np.where(inside, y, 0)])).astype(np.int64) << k
        return length

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of equal words that end just before ``a`` and ``b``, where a < b."""
        length = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            # Both stretches of 2^k words lie inside, so equal numbers mean equal words.
            x, y = a - length - (1 << k), b - length - (1 << k)
            inside, level = x >= 0, self.levels[k]
            length += (inside & (level[np.where(inside, x, 0)] == level[np.where(inside, y, 0)])).astype(np.int64) << k
        return length


def nearest_smaller(values: list[int]) -> tuple[list[int], list[int]]:
    """For each place the nearest place before (else 0) and behind (else the end) with a smaller value."""
    left, right, open_places = [0] * len(values), [len(values)] * len(values), []
    for at, value in enumerate(values):
        while open_places and values[open_places[-1]] > value:
            right[open_places.pop()] = at
        if open_places:
            top = open_places[-1]
            left[at] = left[top] if values[top] == value else top
        open_places.append(at)
    return left, right


def smaller_children(common: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every interval of the suffix array its children but the largest.

    An interval of depth ``m`` is a longest stretch of slots whose suffixes share their first m
    words, m > 0; slots where the neighbours share exactly m part it into its children. Gives, per
    child: first slot, slot past the last, the same of the interval, and the depth.
    """
    left, right = (np.array(x, dtype=np.int64) for x in nearest_smaller(common.tolist()))
    cuts = np.flatnonzero(common > 0)
    name = left[cuts] * (len(common) + 1) + right[cuts]
    sort = np.argsort(name, kind="stable")
    cuts, name = cuts[sort], name[sort]
    if not len(cuts):
        return (cuts,) * 5
    opens = np.ones(len(cuts), dtype=bool)
    opens[1:] = name[1:] != name[:-1]
    closes = np.append(opens[1:], True)
    before = np.where(opens, left[cuts], np.append(0, cuts[:-1]))
    first = np.concatenate([before, cuts[closes]])
    past = np.concatenate([cuts, right[cuts[closes]]])
    interval = np.concatenate([np.cumsum(opens), np.cumsum(opens)[closes]])
    cut = np.concatenate([cuts, cuts[closes]])
    sort = np.lexsort((past - first, interval))
    largest = np.append(interval[sort][1:] != interval[sort][:-1], True)
    keep = sort[~largest]
    return first[keep], past[keep], left[cut[keep]], right[cut[keep]], common[cut[keep]]


def branching_squares(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every square whose next word, if any, does not go on with the period.

    A square of period m starts at i if the suffixes i and i+m lie in one interval of depth m, and
    it is branching if they lie in different children; then one of the two is outside the largest
    child. So only suffixes of smaller children ask for the slots of i+m and i-m.
    """
    order, inverse = suffixes.order, suffixes.inverse
    children = smaller_children(suffixes.common)
    sizes = np.cumsum(children[1] - children[0])
    found = []
    at = 0
    while at < len(sizes):
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + BLOCK, side="right")))
        first, past, low, high, depth = (c[at:to] for c in children)
        count = past - first
        child = np.repeat(np.arange(to - at), count)
        slot = np.arange(len(child)) + np.repeat(first - (np.cumsum(count) - count), count)
        place, depth = order[slot], depth[child]
        for other, start in ((place + depth, place), (place - depth, place - depth)):
            valid = (other >= 0) & (other < len(order))
            asked = inverse[np.where(valid, other, 0)]
            hit = valid & (asked >= low[child]) & (asked < high[child])
            hit &= (asked < first[child]) | (asked >= past[child])
            found.append(np.stack([start[hit], depth[hit]]))
        at = to
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    start, period = np.unique(np.concatenate(found, axis=1), axis=1)
    return start, period


def runs_of(keys: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``least`` words or more, by start, then period.

    A branching square is the last square of its run: turning it left, word by word, meets all
    others, and where that stops the run starts. Squares of a period that is a multiple of the
    smallest one end up with the same start and end and are merged with it.
    """
    suffixes = Suffixes(keys, ends)
    start, period = branching_squares(suffixes)
    past = start + 2 * period
    start = start - suffixes.backward(start, start + period)
    sort = np.lexsort((period, past, start))
    start, past, period = start[sort], past[sort], period[sort]
    smallest = np.ones(len(start), dtype=bool)
    smallest[1:] = (start[1:] != start[:-1]) | (past[1:] != past[:-1])
    keep = smallest & (past - start >= least)
    start, past, period = start[keep], past[keep], period[keep]
    sort = np.lexsort((period, start))
    return np.stack([start, past - start, period], axis=1)[sort]


def _analysed(texts: list[list[bytes]], least: int) -> Iterator[tuple]:
    """Starts, lengths, periods and collapsed text of each list of words."""
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    known: dict[bytes, int] = {}
    ids = [known.setdefault(w, len(known)) for t in texts for w in t]
    keys = np.array(ids, dtype=np.int64) + np.repeat(np.arange(len(texts)), counts) * max(len(known), 1)
    found = runs_of(keys, np.repeat(bounds[1:], counts), least)
    first = np.searchsorted(found[:, 0], bounds)
    # +1 where a dropped stretch begins and -1 behind it.
    depth = np.zeros(bounds[-1] + 1, dtype=np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(depth)[:-1] == 0
    for no, text in enumerate(texts):
        own = found[first[no] : first[no + 1]]
        if len(own):
            text = [w for w, k in zip(text, kept[bounds[no] : bounds[no + 1]].tolist()) if k]
        yield own[:, 0] - bounds[no], own[:, 1], own[:, 2], b" ".join(text).decode()


def add_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Add ``runs``, an array of (start, length, period) by start, then period, and ``collapsed``.

    A run is a stretch of words with smallest period q, of at least ``least`` and 2q words, that no
    neighbouring word extends with that period; a run starts at a word number, from 0. ``collapsed``
    is the text's words joined by one space, without those that a run holds after its first q. A
    text without runs keeps all its words; NULL counts as empty and gives no runs and no words.
    Columns of those names are replaced, all others, and repeated rows, stay.

    One pass without a shuffle, a row independent of all others: the work is words times the
    logarithm of the longest repeat, also for a text that is one word a million times, and so is
    the memory, of one text at a time or of short ones together (``TOGETHER`` words).
    """

    @F.pandas_udf("starts array<long>, lengths array<long>, periods array<long>, collapsed string")
    def analysed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, waiting, held = [], [], 0
            for value in batch:
                # Bytes are split at the six ASCII white-space characters, and at no others.
                found = value.encode().split()
                if waiting and held + len(found) > TOGETHER:
                    rows.extend(_analysed(waiting, least))
                    waiting, held = [], 0
                waiting.append(found)
                held += len(found)
            rows.extend(_analysed(waiting, least))
            yield pd.DataFrame(rows, columns=["starts", "lengths", "periods", "collapsed"])

    found = F.col("_found")
    runs = F.transform(
        F.arrays_zip(found["starts"], found["lengths"], found["periods"]),
        lambda r: F.struct(r["starts"].alias("start"), r["lengths"].alias("length"), r["periods"].alias("period")),
    )
    return (
        docs.withColumn("_found", analysed(text_or_empty()))
        .withColumns({"runs": runs, "collapsed": found["collapsed"]})
        .drop("_found")
    )


def plant_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, of about every tenth document with words repeated up to its end.

    With h = crc32 of the id in decimals, g = floor(h/10) and n words, documents with h%10 = 0 have
    each word i >= a replaced by word a + (i-a) % p, where a = g%n and p = 1 + floor((n-a)/(3+g%8)).
    A NULL id or text stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    n, a, p = F.size("_words").cast("long"), F.col("_from"), F.col("_period")
    repeated = F.transform(
        "_words",
        lambda w, i: F.when(i >= a, F.get("_words", (a + (i - a) % p).cast("int"))).otherwise(w),
    )
    return (
        docs.select("doc_id", "text")
        .withColumn("_words", F.when((h % 10 == 0) & F.col("text").isNotNull(), words(F.col("text"))))
        .withColumn("_from", F.when(n > 0, g % n))
        .withColumn("_period", 1 + F.floor((n - a) / (3 + g % 8)).cast("long"))
        .select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))
    )


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per document: number of runs, the longest run, and digests of all runs and the collapsed text."""
    found = add_runs(docs, least)
    # Longest first; of equals the smallest start, then period.
    top = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("_top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_top.s")).alias("start"),
        F.col("_top.n").alias("length"),
        (-F.col("_top.p")).alias("period"),
        F.floor(1000 * F.col("_top.n") / -F.col("_top.p")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
