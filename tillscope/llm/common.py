"""What the corpus operators share: words, texts, samples of labelled rows, shared constants."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.sources import written_table

#: A word is a longest stretch without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = r"[\x20\x09-\x0D]+"

#: A key that holds more than one row in so many is hot.
HOT = 200

#: Rows with this remainder of crc32(doc_id as text) are held out; models never learn from them.
FOLDS, HELD_OUT_FOLD = 5, 0


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, as an array without empty entries."""
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], hint: str = "shuffle_hash") -> DataFrame:
    """Inner join of rows with a table of one row per key, in which ``n`` is the key's number of rows.

    A key with more than the ``HOT``-th part of all rows is joined by broadcast: there are fewer
    than ``HOT`` such keys, whatever the size of the tables, and their rows stay where they are. All
    other rows are shuffled by key, as ``hint`` says, and none of their keys can fill a task. ``n``
    is left out; ``per_key`` is written once, ``rows`` read twice.
    """
    per_key = written_table(per_key, "per-key")
    total = per_key.agg(F.sum("n")).first()[0] or 0
    hot = per_key.where(F.col("n") * HOT > total).drop("n")
    rest = per_key.where(F.col("n") * HOT <= total).drop("n")
    others = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti")
    return rows.join(F.broadcast(hot), list(keys)).unionByName(others.join(rest.hint(hint), list(keys)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept out of learning (a NULL id counts as the empty text)."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(key) % FOLDS == HELD_OUT_FOLD


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most about ``most`` labelled texts to learn from: ``text``, ``label`` (0 or 1), ``order``.

    Rows are chosen by a hash of their id at a rate that makes ``most`` the expected number (the
    spread is its square root); with fewer labelled rows all are taken. An id with several labels
    counts as 1 if any is. NULL labels and ids, and held-out ids, are never used. The chosen ids
    are the only side that is broadcast: ``most`` bounds them. Documents that repeat an id count as
    one, with the text of the smallest hash, so ``most`` bounds the rows too; the texts are reduced
    map-side, so an id that very many rows hold is not gathered in one place.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    total = known.count()
    parts = 1 << 40
    rate = int(parts * min(1.0, most / max(total, 1)))
    place = F.xxhash64(F.lit("training"), F.col("doc_id"))
    chosen = known.where(F.pmod(place, F.lit(parts)) < rate)
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    return (
        texts.groupBy("doc_id", "label")
        .agg(F.min(F.struct(F.xxhash64("text").alias("mark"), "text"))["text"].alias("text"))
        .select("text", "label", place.alias("order"))
    )
