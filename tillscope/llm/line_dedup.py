"""Line dedup: repeated runs of lines, found through winnowed fingerprints, go at their later places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.common import WORD, join_per_key, let, text_or_empty
from tillscope.sources import written_table

#: Words of a gram at least, and words over which a window of grams starts.
GRAM = 25
WINDOW = GRAM
#: A repeated run of so many words is deleted. Every run of GRAM + WINDOW words shares a fingerprint.
LEAST_WORDS = GRAM + WINDOW


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's lines and their winnowed fingerprints, as arrays: no shuffle, a row per row.

    Columns ``id``, ``mark`` (hash of the text), and of the lines that have words ``line`` (number),
    ``words`` and 128 bits ``hash``, ``check``; ``picks`` are the fingerprints: 128 bits ``a``, ``b``
    of the gram's lines, and the places ``since`` to ``until`` in these arrays at which the windows
    that pick it begin. A gram starts at every line and takes lines until it has ``GRAM`` words. A
    window is the grams that start within the first ``WINDOW`` words after a line's beginning; its
    smallest gram is picked, of equals the first, so the windows of a pick follow each other. Two
    equal runs of ``GRAM + WINDOW`` words begin with the same window, hence with the same pick. Each
    gram looks at ``GRAM`` lines at most, so a document costs time in proportion to its lines.
    """
    def entry(content: Column, number: Column) -> Column:
        return F.struct(
            number.alias("line"),
            F.regexp_count(content, F.lit(WORD)).alias("words"),
            F.xxhash64(content).alias("hash"),
            F.xxhash64(F.lit(1), content).alias("check"),
        )

    text = text_or_empty()
    lines = F.filter(F.transform(F.split(text, "\n"), entry), lambda x: x["words"] > 0)

    def columns(rows: Column) -> Column:
        return F.struct(*[rows[name].alias(name) for name in ("line", "words", "hash", "check")])

    def reached(words: Column, i: Column) -> Column:
        return _lines_of(F.slice(words, i + 1, GRAM), GRAM)

    def with_spans(own: Column) -> Column:
        spans = F.transform(own["words"], lambda _, i: reached(own["words"], i))
        return let(spans, lambda spans: let(grams(own, spans), lambda g: F.struct(
            *[own[name].alias(name) for name in ("line", "words", "hash", "check")],
            picks(spans, g).alias("picks"),
        )))

    def grams(own: Column, spans: Column) -> Column:
        def gram(span: Column, i: Column) -> Column:
            return F.when(span["total"] >= GRAM, F.struct(
                F.xxhash64(F.slice(own["hash"], i + 1, span["n"])).alias("a"),
                F.xxhash64(F.slice(own["check"], i + 1, span["n"])).alias("b"),
                i.alias("i"),
            ))

        return F.transform(spans, gram)

    def picks(spans: Column, found: Column) -> Column:
        # The lines that start within WINDOW words are the gram's own lines, as WINDOW is GRAM.
        smallest = F.transform(spans, lambda span, i: F.array_min(F.slice(found, i + 1, span["n"])))
        # Windows without a gram are the last ones.
        return let(F.filter(smallest, lambda p: p.isNotNull()), stretched)

    def stretched(smallest: Column) -> Column:
        def place(k: Column) -> Column:
            return F.get(smallest, F.greatest(k, F.lit(0)))["i"]

        begun = F.filter(
            F.transform(smallest, lambda p, k: F.struct(p["a"].alias("a"), p["b"].alias("b"), k.alias("since"))),
            lambda p, k: (k == 0) | (place(k) != place(k - 1)),
        )
        return let(begun, lambda begun: F.transform(begun, lambda p, k: F.struct(
            p["a"].alias("a"), p["b"].alias("b"), p["since"].alias("since"),
            (F.coalesce(F.get(begun, k + 1)["since"], F.size(smallest)) - 1).alias("until"),
        )))

    own = let(let(lines, columns), with_spans)
    return docs.select(
        F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"),
        F.xxhash64(text).alias("mark"),
        own.alias("own"),
    ).select("id", "mark", "own.*")


def _lines_of(words: Column, least: int) -> Column:
    """Number ``n`` of lines from the start until they have ``least`` words, and their ``total``."""
    def step(s: Column, w: Column) -> Column:
        more = F.struct((s["n"] + 1).alias("n"), (s["total"] + w).alias("total"))
        return F.when(s["total"] >= least, s).otherwise(more)

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("total"))
    return F.aggregate(words, start, step)


def _stretches(since: Column, until: Column) -> Column:
    """The stretches of lines that begin at the places: ``a``, ``b`` (128 bits), ``first``, ``last``.

    Let e(i) be the line with which the lines from i on reach ``LEAST_WORDS``. From i on there is a
    stretch to e(i), and one to each line behind it and before e(i + 1); of two neighbouring lines
    that both have ``LEAST_WORDS`` one to the second. So every run of ``LEAST_WORDS`` is the union
    of stretches that overlap, whatever its ends, and there are at most three a line on average.
    Which lines behind i are a stretch depends on these lines alone.
    """
    def end(i: Column) -> Column:
        found = _lines_of(F.slice("words", i + 1, LEAST_WORDS), LEAST_WORDS)
        return let(found, lambda f: F.when(f["total"] >= LEAST_WORDS, i + f["n"] - 1))

    def from_one(e: Column, k: Column, ends: Column) -> Column:
        i, following = since + k, F.coalesce(F.get(ends, k + 1), F.size("words"))
        pair = (e == i) & (following == i + 1) & (following < F.size("words"))
        last = F.when(pair, following).otherwise(F.greatest(e, following - 1))
        return F.transform(F.sequence(e, last), lambda j: F.struct(
            F.xxhash64(F.slice("hash", i + 1, j - i + 1)).alias("a"),
            F.xxhash64(F.slice("check", i + 1, j - i + 1)).alias("b"),
            i.alias("first"), j.alias("last"),
        ))

    ends = F.transform(F.sequence(since, until + 1), end)
    return let(ends, lambda ends: F.flatten(F.transform(
        F.filter(F.slice(ends, 1, until - since + 1), lambda e: e.isNotNull()),
        lambda e, k: from_one(e, k, ends),
    )))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Stretches of ``LEAST_WORDS`` words that stand at an earlier place too: all, whatever their source.

    Columns ``id``, ``mark`` (the document, by id and hash of its text), ``first``, ``last`` (line
    numbers from 0) and ``source`` (id of the document that holds the stretch first). The order of
    places is by id, text hash and line. A run that stands at an earlier place is the union of such
    stretches. Only where a fingerprint is shared can one begin; those are hashed whole, and each is
    compared with the first place of its hash, so there are no pairs, however many documents share
    it. That takes the place of extending each shared fingerprint line by line: the stretches are
    all extensions to just ``LEAST_WORDS`` that the picked windows allow, and longer runs are their
    unions, so the result is exact and no fingerprint is compared with one place only. All tables
    here grow with the corpus, so the joins are shuffled by hint rather than broadcast while they
    happen to be small, but for hot fingerprints and stretches (``join_per_key``); only hashes of
    lines and stretches travel, no texts.
    """
    own = written_table(fingerprints(docs).dropDuplicates(["id", "mark"]), "line-fingerprints")
    found = own.select("id", "mark", F.inline("picks"))
    several = found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = (
        join_per_key(found, several, ["a", "b"])
        .groupBy("id", "mark")
        .agg(F.collect_list(F.struct("since", "until")).alias("windows"))
    )
    lines = own.select("id", "mark", "line", "words", "hash", "check").hint("merge")
    begun = F.transform("windows", lambda w: _stretches(w["since"], w["until"]))
    stretches = written_table(
        shared.join(lines, ["id", "mark"])
        .select("id", "mark", "line", F.inline(F.flatten(begun)))
        .select("id", "mark", "a", "b", F.get("line", "first").alias("first"), F.get("line", "last").alias("last")),
        "line-stretches",
    )
    place = F.struct("id", "mark", "first")
    lead = stretches.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("lead"))
    return (
        join_per_key(stretches, lead.where("n > 1"), ["a", "b"])
        .where(place != F.col("lead"))
        .select("id", "mark", "first", "last", F.col("lead.id").alias("source"))
    )


def _deletions(runs: DataFrame) -> DataFrame:
    """Per document, its runs merged where they touch, in order: ``removed``."""
    own = ["id", "mark"]
    ordered = Window.partitionBy(*own).orderBy("first", "last")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    starts = F.coalesce((F.col("first") > F.max("last").over(earlier) + 1).cast("int"), F.lit(1))
    return (
        runs.withColumn("starts", starts)
        .withColumn("part", F.sum("starts").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*own, "part")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("source").alias("source"))
        .groupBy(*own)
        .agg(F.sort_array(F.collect_list(F.struct("first", "last", "source"))).alias("removed"))
    )


def _kept(lines: Column, removed: Column) -> Column:
    """The stretches of lines between the removed ones."""
    def stretch(r: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(removed, F.greatest(i - 1, F.lit(0)))["last"] + 1).otherwise(F.lit(0))
        return F.slice(lines, before + 1, r["first"] - before)

    end = F.element_at(removed, -1)["last"] + 1
    rest = F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0)))
    return F.concat(F.flatten(F.transform(removed, stretch)), rest)


def with_removals(docs: DataFrame) -> DataFrame:
    """The documents with ``removed``: the deleted runs (``first``, ``last``, ``source``), else NULL."""
    removed = written_table(_deletions(repeated_runs(docs.select("doc_id", "text"))), "line-removals")
    renamed = removed.select(
        F.col("id").alias("_id"), F.col("mark").alias("_mark"), F.col("removed")
    )
    own = [c for c in docs.columns if c != "removed"]
    same = (F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))) == F.col("_id")) & (
        F.xxhash64(text_or_empty()) == F.col("_mark")
    )
    # The removals grow with the corpus: one shuffle of the texts, at every size.
    return docs.select(*own).join(renamed.hint("shuffle_hash"), same, "left").drop("_id", "_mark")


def remove_lines(text: Column, removed: Column) -> Column:
    """The text without the removed runs; as it was where there are none."""
    rest = F.array_join(_kept(F.split(text, "\n"), removed), "\n")
    return F.when(removed.isNull(), text).otherwise(rest)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without the runs of lines that stand at an earlier place, all columns kept.

    A run counts from ``LEAST_WORDS`` words on, in the same document or another one; its first place
    (by id, then by hash of the text, then by line) stays. Places may overlap: a line that is
    repeated over and over is a run at each of its places, and all lines from the second place on
    go, so that the first place is left up to there, one line. Only whole equal lines count. A text that
    is one repeated run becomes empty; ``n_chars``, if there, follows the new text. NULL texts stay
    NULL and hold no lines; a NULL id sorts first; rows that agree in id and text are one document.
    An empty table stays empty.
    """
    marked = with_removals(docs)
    marked = marked.withColumn("_left", remove_lines(F.col("text"), F.col("removed")))
    changed = {"text": F.col("_left")}
    if "n_chars" in docs.columns:
        size = F.length("_left").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("removed").isNull(), F.col("n_chars")).otherwise(size)
    return marked.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """``doc_id``, the ``text`` that is left, ``n_lines``, ``removed_lines`` and ``removed`` runs.

    Each run has its first and last line (from 0) and the id of the document that holds it first.
    """
    marked = with_removals(docs.select("doc_id", "text"))
    taken = F.aggregate(
        F.coalesce("removed", F.array().cast("array<struct<first:int,last:int,source:bigint>>")),
        F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1,
    )
    return marked.select(
        "doc_id",
        remove_lines(F.col("text"), F.col("removed")).alias("text"),
        F.size(F.split(text_or_empty(), "\n")).cast("long").alias("n_lines"),
        taken.alias("removed_lines"),
        "removed",
    )
