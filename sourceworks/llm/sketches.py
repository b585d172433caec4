"""Document fingerprints: bottom-k sketches of word shingles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceworks.llm.text import whole, window_hashes, words

SHINGLE = 5
SIZE = 128
SLICE_BYTES, MOST_SLICES = 32 << 20, 20_000


def with_sketch(df: DataFrame, text: Column, out: str, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the sketch of a text: the ``size`` smallest distinct hashes of its shingles, ascending.

    Shingles are runs of ``shingle`` words; a text with fewer words is one
    shingle, one without words has an empty sketch.
    """
    count = F.size("_hashes")
    shingles = (
        F.when(count == 0, F.array().cast("array<bigint>"))
        .when(count < shingle, F.array(F.xxhash64("_hashes")))
        .otherwise(window_hashes("_hashes", shingle))
    )
    hashed = df.withColumn("_words", words(text)).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    sketched = hashed.withColumn("_shingles", shingles).withColumn(
        out, F.slice(F.sort_array(F.array_distinct("_shingles")), 1, size)
    )
    return sketched.drop("_words", "_hashes", "_shingles")


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of two parts together, from their sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of common shingles among all of both texts; 1 for two empty sketches."""
    both = F.array_intersect(F.array_intersect(a, b), merged(a, b, size))
    among = F.least(F.size(F.array_union(a, b)), F.lit(size))
    return F.when(among == 0, F.lit(1.0)).otherwise(F.size(both) / among)


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles: exact up to ``size``, then from the largest hash kept."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / share)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too; 1 if ``a`` is empty."""
    common = resemblance(a, b, size) * distinct_shingles(merged(a, b, size), size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, size)))


def as_string(sketch: Column) -> Column:
    """A sketch as text: base64 of its hashes, eight bytes each."""
    digits = F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return F.base64(F.unhex(digits))


def with_next_text(docs: DataFrame) -> DataFrame:
    """Columns of ``docs`` (doc_id, text) and ``_slice``, ``_guest``, ``_turn``, for windows in order of id.

    Documents are cut into slices of about ``SLICE_BYTES`` at quantiles of their ids (above ``MOST_SLICES`` slices
    these grow, and windows over them spill; the bounds are a constant of the plan). The document at the
    start of a slice is also a guest at the end of the slice before it (the first
    document of all: of the last slice), so ``lead`` over ``order_in_slice()``
    sees the next document of every row that is no guest, and no slice holds more
    than its share. Texts are shuffled once.
    """
    first, nulls, size = docs.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull()), F.sum(F.octet_length("text"))).first()
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = min(max(least, (size or 0) // SLICE_BYTES + 1), MOST_SLICES)
    steps = [k / slices for k in range(1, slices)]
    marks = docs.agg(F.percentile_approx("doc_id", steps, 10 * slices)).first()[0]
    marks = sorted({m for m in marks or [] if m != first})
    starts = F.array(*[F.lit(m).cast("bigint") for m in marks]) if marks else F.array().cast("array<bigint>")
    # The slice of an id, first by every width-th mark, then by the marks between.
    width = max(1, math.isqrt(len(marks)))
    coarse = F.array(*[F.lit(m).cast("bigint") for m in marks[::width]]) if marks else starts
    block = F.size(F.filter(coarse, lambda m: m <= F.col("doc_id")))
    near = F.slice(starts, F.greatest((F.col("_block") - 1) * width + 1, F.lit(1)), width)
    place = F.when(F.col("_block") > 0, (F.col("_block") - 1) * width + F.size(F.filter(near, lambda m: m <= F.col("doc_id")))).otherwise(0)
    opens = F.array_contains(near, F.col("doc_id"))
    begins = F.col("doc_id").eqNullSafe(F.lit(None if nulls else first).cast("bigint"))
    seat = lambda place, guest, turn: F.struct(place.cast("int").alias("_slice"), F.lit(guest).alias("_guest"), F.lit(turn).alias("_turn"))
    seats = F.filter(
        F.array(
            seat(F.col("_place"), False, 0),
            F.when(F.coalesce(opens, F.lit(False)), seat(F.col("_place") - 1, True, 1)),
            F.when(begins, seat(F.lit(len(marks)), True, 2)),
        ),
        lambda s: s.isNotNull(),
    )
    return (
        docs.withColumn("_block", F.coalesce(block, F.lit(0)))
        .withColumn("_place", F.coalesce(place, F.lit(0)))
        .select("doc_id", "text", F.inline(seats))
    )


def order_in_slice():
    return Window.partitionBy("_slice").orderBy("_turn", F.asc_nulls_first("doc_id"), "_tie")


def fingerprints(docs: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document in order of id; the last document
    is followed by the first, a single one by itself. Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_shingles (estimated distinct shingles), contained (share of the text's
    shingles that the edited text keeps).

    Null texts count as empty. Null ids come first; documents with equal ids
    follow each other by a hash of their texts. An empty table gives no rows.
    """
    rows = with_next_text(docs.select("doc_id", whole("text").alias("text"))).withColumn(
        "_tie", F.xxhash64("text")
    )
    window = order_in_slice()
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"),
        F.expr("substring(_next, 1, cast(n_chars div 2 as int))"),
    )
    followed = rows.withColumn("n_chars", F.char_length("text").cast("bigint")).withColumn(
        "_next", F.lead("text").over(window)
    )
    shown = F.when(F.col("_guest"), F.lit("")).when(half == 0, F.col("text")).otherwise(edited)
    changed = followed.withColumn("_edited", shown)
    own = with_sketch(changed, F.col("text"), "_own", size, shingle).drop("text", "_next")
    both = with_sketch(own, F.col("_edited"), "_other", size, shingle)
    joined = both.withColumn("_after", F.lead("_own").over(window)).where(~F.col("_guest"))
    own, other = F.col("_own"), F.col("_other")
    return joined.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        as_string(own).alias("fingerprint"),
        as_string(other).alias("edited_fingerprint"),
        resemblance(own, other, size).alias("near_edited"),
        resemblance(own, F.col("_after"), size).alias("near_next"),
        distinct_shingles(own, size).alias("n_shingles"),
        containment(own, other, size).alias("contained"),
    )
