"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceworks.llm.ranking import ranked
from sourceworks.llm.text import WORD, fraction, seeded, whole
from sourceworks.session import cut_lineage

WEIGHTS = (5, 2, 1)


def size_in_words() -> Column:
    """Words of the text; none in a null one."""
    return F.regexp_count(whole("text"), F.lit(WORD)).cast("bigint")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets of sources: ``share`` of all sizes by weight, none above ``most`` times its source's size.

    ``sources`` has source and source_size. Weights go round the sources in code
    point order, null last. What a capped source can't take is shared again by
    weight until none is above. As the amount for one unit of weight only grows,
    each round is one aggregate over the sources.
    """
    placed = ranked(sources.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_place", "_sources")
    weight = F.lit(float(weights[-1]))
    for k, value in enumerate(weights[:-1], start=1):
        weight = F.when(F.col("_place") % len(weights) == k, F.lit(float(value))).otherwise(weight)
    weighed = cut_lineage(
        placed.select("source", "source_size", weight.alias("_weight"), (F.col("source_size") * float(most)).alias("_cap"))
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    unit = 0.0
    while True:
        above = F.col("_weight") * F.lit(unit) > F.col("_cap")
        capped, free = weighed.agg(
            F.sum(F.when(above, F.col("_cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("_weight")))
        ).first()
        again = (share * total - capped) / free if free else unit
        if again <= unit:
            break
        unit = again
    return weighed.select(
        "source", "source_size", F.least(F.col("_cap"), F.col("_weight") * F.lit(unit)).alias("target")
    )


def systematic_mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """How often the mix takes each document.

    Every document of a source expects target / source_size copies. With the
    documents of a source in a line, a prefix sum of the expected copies and one
    random offset per source, a document is taken once for each whole number its
    step crosses. The line is ordered by size (then by seeded digest), so any
    stretch of like documents gives its share and the words taken come near the
    target.

    Columns: doc_id, source, size (words), source_size, target, copies, taken
    (size * copies). Null texts have no words; a null source is one of its own;
    documents without words are sampled too and add nothing; an empty table
    gives no rows.
    """
    rows = cut_lineage(
        docs.select(
            "doc_id",
            "source",
            size_in_words().alias("size"),
            seeded(seed, F.col("doc_id")).alias("_order"),
        )
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, share, most)
    line = ranked(rows, ["source"], ["size", "_order", "doc_id"], "_rank", "_rows").join(
        targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    )
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = fraction(seeded(seed + "-offset", F.col("source")))
    crossed = F.floor(F.col("_rank") * F.col("_expected") + F.col("_start")) - F.floor(
        (F.col("_rank") - 1) * F.col("_expected") + F.col("_start")
    )
    copies = F.least(crossed, F.ceil(F.lit(float(most)))).cast("bigint")
    return (
        line.withColumn("_expected", expected)
        .withColumn("_start", start)
        .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
    )
