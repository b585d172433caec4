"""Quality rules: counts inside a text, and lines that too many documents of a host share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceworks.llm.text import WORD, whole, window_hashes, words
from sourceworks.session import cut_lineage

SYMBOLS = r"[#*$%&|<>]"
FEW_REPEATS = 64
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "kept")


def normal_line(line: Column) -> Column:
    """A line as it is compared between documents: lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.lower(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def _positions_by_lookup() -> Column:
    """Positions of windows whose hash is among the repeated ones."""
    return F.filter(
        F.sequence(F.lit(0), F.size("_windows") - 1),
        lambda i: F.array_contains(F.col("_repeated"), F.get(F.col("_windows"), i)),
    )


def _positions_by_sort() -> Column:
    """The same positions from sorted (hash, position) pairs: equal neighbours are repeated."""
    alike = lambda s, i: F.coalesce(F.get(F.col("_pairs"), i)["h"] == s["h"], F.lit(False))
    repeated = F.filter("_pairs", lambda s, i: alike(s, i + 1) | alike(s, i - 1))
    return F.sort_array(F.transform(repeated, lambda s: s["i"]))


def text_counts(df: DataFrame) -> DataFrame:
    """``df`` (with a non-null ``text``) and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated windows are those whose hash occurs twice in the sorted hashes of
    the text; a run of their positions p covers min(3, next p - p) words each, the
    last one three. Positions are looked up where few hashes repeat and else come
    from a second sort, with the same result, so that a text of any length costs
    no more than sorting it.
    """
    count = F.size("_words")
    few = F.size("_repeated") <= FEW_REPEATS
    pairs = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_at"), i + 1) - p, F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda total, step: total + step,
    )
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    return (
        df.withColumn("_words", words(F.col("text")))
        .withColumn("n_words", count.cast("bigint"))
        .withColumn(
            "word_chars", F.aggregate("_words", F.lit(0).cast("bigint"), lambda total, w: total + F.char_length(w))
        )
        .withColumn("n_symbols", F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint"))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn(
            "_windows",
            F.when(F.col("n_words") >= 3, window_hashes("_hashes", 3)).otherwise(F.array().cast("array<bigint>")),
        )
        .withColumn("_sorted", F.sort_array("_windows"))
        .withColumn(
            "_repeated", F.array_distinct(F.filter("_sorted", lambda h, i: h == F.get(F.col("_sorted"), i + 1)))
        )
        .withColumn("_pairs", F.when(few, None).otherwise(pairs))
        .withColumn(
            "_at", F.when(F.size("_repeated") == 0, F.array().cast("array<int>")).when(few, _positions_by_lookup()).otherwise(_positions_by_sort())
        )
        .withColumn("n_repeat_words", covered)
        .drop("_words", "_hashes", "_windows", "_sorted", "_repeated", "_pairs", "_at")
    )


def _common_lines(facts: DataFrame, most_documents: int) -> DataFrame:
    """Lines (host, hash) of more than ``most_documents`` distinct documents."""
    held = facts.select("_host", "_text", F.explode(F.array_distinct(F.transform("_lines", lambda s: s["h"]))).alias("_line"))
    lines = held.groupBy("_host", "_line").agg(F.count_distinct("_text").alias("_held"))
    return lines.where(F.col("_held") > most_documents).select("_host", "_line")


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    carry: Sequence[str] | None = None,
    most_documents: int = 100,
    least_left: float = 0.5,
) -> DataFrame:
    """Counts and a verdict for every document.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated
    3-word windows. Otherwise the lines decide: a normalised line is common when
    more than ``most_documents`` distinct documents of its host hold it, whatever the
    host's size. Common lines are removed, and a document is kept if at least ``least_left`` of its words are
    left. Distinct documents are different texts: copies of a text vouch for its
    lines once.

    Columns: those of ``carry`` (default: all of ``docs``; a ``text`` among them
    comes back without its common lines), then n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, n_left (words outside common lines) and
    kept. Carried columns with one of these names give way to the new ones.

    A null text counts as empty and fails; documents with a null host share one
    host; rows with equal ids are judged separately; an empty table gives no rows.
    """
    carried = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    rows = docs.select(
        F.struct(F.lit(0).alias("_"), *carried).alias("_given"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_name"),
        F.col(host).isNull().alias("_none"),
        whole("text").alias("text"),
    )
    counted = text_counts(rows)
    line_rows = F.transform(
        "_lines", lambda line: F.struct(F.xxhash64(normal_line(line)).alias("h"), F.size(words(line)).alias("w"))
    )
    facts = cut_lineage(
        counted.select(
            "_given",
            F.struct("_none", "_name").alias("_host"),
            F.monotonically_increasing_id().alias("_row"),
            *RESULT[:5],
            F.xxhash64("text", F.char_length("text")).alias("_text"),
            line_rows.alias("_lines"),
        )
    )
    common = _common_lines(facts, most_documents)
    removed = (
        facts.select("_host", "_row", F.explode("_lines").alias("_s"))
        .select("_host", "_row", F.col("_s.h").alias("_line"), F.col("_s.w").alias("_w"))
        .join(common, ["_host", "_line"])
        .groupBy("_row")
        .agg(F.sum("_w").alias("_removed"), F.collect_set("_line").alias("_common"))
    )
    left = F.col("n_words") - F.coalesce("_removed", F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = (
        facts.join(removed, "_row", "left")
        .withColumn("base_failed", failed)
        .withColumn("n_left", left)
        .withColumn("kept", ~failed & (left >= F.col("n_words") * least_left))
    )
    given = [_without_common() if c == "text" else F.col(f"_given.`{c}`").alias(c) for c in carried]
    return judged.select(*given, *RESULT)


def _without_common() -> Column:
    lines = F.split("_given.text", "\n")
    left = F.filter(
        lines, lambda line: ~F.coalesce(F.array_contains("_common", F.xxhash64(normal_line(line))), F.lit(False))
    )
    return F.when(F.col("_common").isNull(), F.col("_given.text")).otherwise(F.array_join(left, "\n")).alias("text")
