"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import WORD
from tillscope.operators.ntile import add_position
from tillscope.sources import written_table

#: Weights of the sources in code-point order (NULL last), repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds this many times the words of all documents, and no source more than ``MOST`` times its own.
SHARE, MOST = 1.5, 2.0
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_rates(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``, ``rate``.

    Words are counted per source with map-side combine, so a source with a third of the documents
    costs no more than others. The sources are numbered by a distributed sort and stored; the level
    that ``share`` of all words leaves per unit of weight is then raised until no further source
    exceeds ``most`` times its size, one small aggregation over the stored sources per step. A
    source without words has target and rate 0.
    """
    sized = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    # As (is NULL, text): NULL comes last, and the text sorts by its UTF-8 bytes, that is by code point.
    placed = add_position(sized, [F.col("source")], "_place", "_sources")
    names = F.array(*[F.lit(float(w)) for w in weights])
    weighted = written_table(
        placed.select(
            "source", "source_size",
            F.element_at(names, (F.col("_place") % len(weights) + 1).cast("int")).alias("_weight"),
        ),
        "sources",
    )
    cap = F.lit(most) * F.col("source_size")
    words, weight = weighted.agg(F.sum("source_size"), F.sum("_weight")).first()
    wanted = share * (words or 0)
    level, full = (wanted / weight if weight else 0.0), -1
    while True:
        over = cap < F.lit(level) * F.col("_weight")
        count, capped, free = weighted.agg(
            F.count_if(over),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0.0)),
        ).first()
        if count == full or not free:
            break
        level, full = (wanted - capped) / free, count
    target = F.least(cap, F.lit(level) * F.col("_weight"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return written_table(
        weighted.select("source", "source_size", target.alias("target"), rate.alias("rate")),
        "rates",
    )


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents with ``source_size``, ``target`` and ``copies``: how often the mix holds each.

    ``copies`` is the whole part of the source's rate, plus one with a probability equal to the
    fraction, drawn from a hash of the id: reruns and lost executors change nothing, and repeated
    rows with one id get the same copies. The rates are read from a stored table whose file size
    lets Catalyst broadcast it; with very many sources it shuffles and adaptive execution splits a
    hot source. Columns of these names in the input are replaced.
    """
    own = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    renamed = rates.withColumnRenamed("source", "_mix_source").withColumnRenamed("rate", "_mix_rate")
    joined = docs.select(*own).join(
        renamed, F.col("source").eqNullSafe(F.col("_mix_source")), "left"
    )
    whole = F.floor("_mix_rate")
    extra = (draw(F.col("doc_id"), seed) < F.col("_mix_rate") - whole).cast("long")
    return joined.select(*own, "source_size", "target", (whole + extra).alias("copies"))


def mix_sources(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as its source's rate says, all columns kept.

    NULL texts hold no words; a document without words is repeated like any other of its source.
    An empty table gives an empty mix.
    """
    planned = with_copies(docs, source_rates(docs), seed)
    repeats = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return (
        planned.where("copies > 0").withColumn("_mix_copy", repeats).select(*docs.columns)
    )
