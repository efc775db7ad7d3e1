"""Document fingerprints: one-permutation MinHash with optimal densification, by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.common import let, text_or_empty, words

SHINGLE = 5
#: Bins (a power of two) and low-order bits kept of each bin's smallest hash.
BINS_LOG2, BITS = 8, 4
BINS = 1 << BINS_LOG2
#: Fillers tried for an empty bin as a chain of alternatives; then all are looked through.
TRIES = 12
#: Texts in a bucket of the order of the documents, on average, and buckets at most, about.
BUCKET_ROWS, BUCKETS = 2_000, 65_536
#: Keys drawn for each bucket, so that the buckets come out alike.
DRAWN = 32


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Sorted distinct hashes of the text's shingles.

    A text of fewer words is one shingle; one without words has the shingle of no words, so that
    such texts are alike and unlike all others. A shingle's hash chains the hashes of its words.
    """
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))

    def chain(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (shingle - 1))
        full = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(shingle)]))
        short = F.array(F.aggregate(w, F.xxhash64(F.lit(0)), lambda h, x: F.xxhash64(h, x)))
        return F.when(F.size(w) >= shingle, full).otherwise(short)

    return F.sort_array(let(hashed, chain))


def _bin(h: Column) -> Column:
    """The bin of a hash: its top bits, in the order of the signed hashes."""
    return (F.shiftright(h, 64 - BINS_LOG2) + (BINS >> 1)).cast("int")


def _filler(bin_: int, attempt: int) -> int:
    """The bin that an empty bin asks at an attempt; over ``BINS`` attempts each bin once.

    A fixed rule (multiplicative hashing of the bin's number): start and odd step differ by bin, so
    bins that are empty together are filled from different places.
    """
    start, step = _walk(bin_)
    return (start + step * attempt) % BINS


def _walk(bin_: int) -> tuple[int, int]:
    start = (bin_ * 2654435761 + 40503) >> 7
    step = 2 * ((bin_ * 1640531527 + 60493) >> 9) + 1
    return start % BINS, step % BINS


def _constant(values: list[int], kind: str) -> Column:
    """A long array as one constant: a literal text that the optimizer parses once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _low_and_gap(h: Column, gap: Column) -> Column:
    low = h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    return F.concat(F.array(low), F.array_repeat(F.lit(None).cast("int"), gap))


def signature(hashes: Column) -> Column:
    """The low-order bits of each bin's smallest hash, as an array of ``BINS`` numbers.

    In the sorted hashes a bin's smallest comes first, so one pass finds them all. Empty bins are
    then filled from the bin that their own sequence of fillers meets first, which keeps two texts'
    bins equal exactly when the sets they stand for agree.
    """

    def of(h: Column) -> Column:
        firsts = F.filter(
            h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(h, F.greatest(i - 1, F.lit(0)))))
        )
        return let(firsts, fill)

    def fill(firsts: Column) -> Column:
        kept = F.transform(firsts, lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
        return F.when(F.size(firsts) == BINS, kept).otherwise(let(slots(firsts), densify))

    def slots(firsts: Column) -> Column:
        # Bins before the first hash, between two neighbours, and behind the last one are empty.
        ends = F.concat(F.transform(firsts, lambda x: _bin(x)), F.array(F.lit(BINS)))
        return let(ends, lambda e: F.concat(
            F.array_repeat(F.lit(None).cast("int"), F.get(e, F.lit(0))),
            F.flatten(F.transform(firsts, lambda x, i: _low_and_gap(x, F.get(e, i + 1) - F.get(e, i) - 1))),
        ))

    order = _constant([_filler(b, t) for b in range(BINS) for t in range(TRIES)], "int")
    starts = _constant([_walk(b)[0] for b in range(BINS)], "int")
    steps = _constant([_walk(b)[1] for b in range(BINS)], "int")

    def densify(slot: Column) -> Column:
        def one(x: Column, b: Column) -> Column:
            tried = [F.get(slot, F.get(order, b * TRIES + t)) for t in range(TRIES)]
            # Rare: only texts with very few shingles look through all the others.
            others = F.transform(
                F.sequence(F.lit(TRIES), F.lit(BINS - 1)),
                lambda t: F.get(slot, (F.get(starts, b) + F.get(steps, b) * t) % BINS),
            )
            return F.coalesce(x, *tried, F.get(F.filter(others, lambda v: v.isNotNull()), F.lit(0)))

        return F.transform(slot, one)

    return let(hashes, of)


def packed(values: Column) -> Column:
    """The signature as text: one hexadecimal digit per bin and four bits."""
    digits = F.array(*[F.lit(format(v, "x")) for v in range(1 << BITS)])
    return F.array_join(F.transform(values, lambda v: F.get(digits, v)), "")


def fingerprint(text: Column) -> Column:
    """Fingerprint of a whole text: ``BINS`` hexadecimal digits; equal texts have equal ones."""
    return packed(signature(shingle_hashes(text)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1.

    Low-order bits agree by chance with probability 2^-BITS, which the estimate takes out.
    """
    chance = 2.0**-BITS
    pairs = F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"])) / F.lit(float(BINS))
    return F.greatest((same - F.lit(chance)) / F.lit(1 - chance), F.lit(0.0))


def _splitters(keys: DataFrame, bucket_rows: int) -> list[tuple[int, int]]:
    """Keys at which the buckets of the order by ``_id``, then ``_hash`` begin, the smallest first.

    Keys are drawn with the same small chance, by a hash of them, ``DRAWN`` a bucket; in their order
    each ``DRAWN``-th begins a bucket. So a bucket holds about ``bucket_rows`` rows, and an id that
    very many texts share is divided like any other stretch. One task sorts the drawn keys, 16 bytes
    each, at most about ``DRAWN * BUCKETS`` of them.
    """
    smallest, total = keys.agg(F.min(F.struct("_id", "_hash")), F.count(F.lit(1))).first()
    if smallest is None:
        return []
    parts = 1 << 40
    rate = int(parts * min(1.0, DRAWN * min(BUCKETS, total / bucket_rows) / total))
    drawn = keys.where(F.pmod(F.xxhash64(F.lit("bucket"), "_id", "_hash"), F.lit(parts)) < rate).distinct()
    place = F.row_number().over(Window.orderBy("_id", "_hash"))
    chosen = drawn.withColumn("_place", place).where(F.col("_place") % DRAWN == 0).select("_id", "_hash")
    return sorted({tuple(smallest), *map(tuple, chosen.collect())})


def with_next(docs: DataFrame, columns: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``next_<column>`` of the next row by ascending ``doc_id``; the last row's next is the first.

    NULL ids come first; rows with equal ids are in the order of a hash of their text. No window
    over the whole table: rows go to buckets of that order, which begin at keys drawn by hash. The
    first row of a bucket holds exactly the key that the bucket begins at, and also visits the
    bucket before as its end, so one shuffle of the texts is enough. An id with very many texts
    spreads over buckets; only rows that agree in id and text lie in one. The driver and the plan
    hold two numbers per bucket, for at most about ``BUCKETS``; beyond 131 million rows the buckets
    grow, to 1.5 GB at 100 TB of texts, which are sorted on disk.
    """
    ordered = docs.withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))).withColumn("_hash", F.xxhash64("text"))
    bounds = _splitters(ordered.select("_id", "_hash"), bucket_rows)
    if not bounds:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    ids, hashes = (_constant(list(part), "bigint") for part in zip(*bounds))
    jumps = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def search(low: Column, jump: Column) -> Column:
        probe = low + jump
        reached = (F.get(ids, probe) < F.col("_id")) | (
            (F.get(ids, probe) == F.col("_id")) & (F.get(hashes, probe) <= F.col("_hash"))
        )
        return F.when((probe < len(bounds)) & reached, probe).otherwise(low)

    # Binary search for the last bucket that does not begin behind the row.
    bucket = F.aggregate(F.lit(jumps), F.lit(0), search)
    own = F.col("_bucket")
    is_first = (F.get(ids, own) == F.col("_id")) & (F.get(hashes, own) == F.col("_hash"))
    before = F.when(own > 0, own - 1).otherwise(len(bounds) - 1)
    places = F.when(
        is_first,
        F.array(F.struct(own.alias("bucket"), F.lit(0).alias("turn")), F.struct(before.alias("bucket"), F.lit(1).alias("turn"))),
    ).otherwise(F.array(F.struct(own.alias("bucket"), F.lit(0).alias("turn"))))
    follow = Window.partitionBy("_at.bucket").orderBy("_at.turn", "_id", "_hash", "text")
    placed = ordered.withColumn("_bucket", bucket).withColumn("_at", F.explode(places))
    led = placed.select("*", *[F.lead(c).over(follow).alias(f"next_{c}") for c in columns])
    return led.where("_at.turn = 0").drop("_id", "_hash", "_bucket", "_at")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text ends in the first characters of the next document in place of its own second
    half. Returns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``, one row per row. NULL texts count as
    empty; a single row is its own next.
    """
    marked = docs.select("doc_id", text_or_empty().alias("text")).withColumn(
        "mark", fingerprint(F.col("text"))
    )
    follow = with_next(marked, ["text", "mark"])
    size = F.length("text")
    taken = F.floor(size / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), size - taken), F.substring("next_text", F.lit(1), taken)
    )
    return (
        follow.select("doc_id", size.cast("long").alias("n_chars"), "mark", "next_mark", edited.alias("edited"))
        .withColumn("edited_mark", fingerprint(F.col("edited")))
        .select(
            "doc_id", "n_chars",
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            F.col("mark").alias("fingerprint"),
            F.col("edited_mark").alias("edited_fingerprint"),
            likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
            likeness(F.col("mark"), F.col("next_mark")).alias("near_next"),
        )
    )
