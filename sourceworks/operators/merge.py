"""Merging data sets and comparing staging with production.

The catalog only names these; the semantics here are our reading of the names:
``Exclusive`` sets do not overlap, ``Intersect`` sets have common records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping_keys(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur on both sides."""
    return first.select(*key).join(second.select(*key), list(key), "left_semi").distinct()


def merge_exclusive(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """Union of two sets that must not share a key; raises when they do."""
    if not overlapping_keys(first, second, key).isEmpty():
        raise ValueError("exclusive data sets share records")
    return first.unionByName(second)


def merge_intersect(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """Union of two overlapping sets; a shared record is taken from the first."""
    return first.unionByName(second.join(first.select(*key), list(key), "left_anti"))


def match_counts(production: DataFrame, staging: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of both sides, staging rows with a production match, and new staging rows.

    Both sides reduce to counts per key before they meet, so a heavy key is
    combined early and the sides are read once.
    """
    counted = (
        production.select(*key, F.lit(1).alias("p"), F.lit(0).alias("s"))
        .unionByName(staging.select(*key, F.lit(0).alias("p"), F.lit(1).alias("s")))
        .groupBy(*key)
        .agg(F.sum("p").alias("p"), F.sum("s").alias("s"))
    )
    matched = F.col("p") > 0
    return counted.agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("production_count"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("staging_count"),
        F.coalesce(F.sum(F.when(matched, F.col("s")).otherwise(0)), F.lit(0)).alias("match_count"),
        F.coalesce(F.sum(F.when(matched, 0).otherwise(F.col("s"))), F.lit(0)).alias("new_count"),
    )
