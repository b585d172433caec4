"""Numbering and previous rows that survive a group holding most of the rows.

A plain ``row_number() over (partition by group ...)`` puts a whole group in one
task. Here rows are range-partitioned on (group, order) and sorted; a row's number is its place in
the sorted partition plus the group's rows in earlier partitions, which are a
table of at most one row per group and partition, however the keys are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourceworks.session import cut_lineage


def _ranged(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``_seq``, its place in the order of (group, order), ``_slice``, its partition, and ``_group``.

    The sorted rows are written once, because range bounds come from a sample and
    must not change between two uses. The group columns become one struct: it is
    never null itself, and null members are equal.
    """
    placed = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    written = cut_lineage(placed.withColumn("_seq", F.monotonically_increasing_id()))
    return written.withColumns(
        {
            "_slice": F.shiftright("_seq", 33),
            "_group": F.struct(*group) if group else F.struct(F.lit(0).alias("all")),
        }
    )


def number_by_sort(
    df: DataFrame, group: Sequence[str], order: Sequence[str], out: str, total: str | None = None
) -> DataFrame:
    """Row number (from 1) per group in order of any sortable columns.

    The last order column should make rows unique: equal rows are numbered in no
    set order. ``total`` names an optional column with the size of the group.
    """
    placed = _ranged(df, group, order)
    sizes = placed.groupBy("_group", "_slice").agg(F.count(F.lit(1)).alias("_size"), F.min("_seq").alias("_first"))
    inside = Window.partitionBy("_group")
    earlier = inside.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")]
    if total:
        columns.append(F.sum("_size").over(inside).alias(total))
    offsets = sizes.select("_group", "_slice", "_first", *columns)
    number = F.col("_seq") - F.col("_first") + F.col("_before") + 1
    extra = [total] if total else []
    return placed.join(offsets, ["_group", "_slice"]).select(*df.columns, *extra, number.alias(out))


def number_in_groups(
    df: DataFrame, group: Sequence[str], key: str, out: str, total: str | None = None
) -> DataFrame:
    """Row number per group in order of ``key``, which is unique in its group."""
    return number_by_sort(df, group, [key], out, total)


def previous_in_groups(df: DataFrame, group: Sequence[str], key: str, out: str) -> DataFrame:
    """The preceding ``key`` (unique in its group) of the same group, null for the first."""
    placed = _ranged(df, group, [key])
    lagged = placed.withColumn("_lag", F.lag(key).over(Window.partitionBy("_group", "_slice").orderBy("_seq")))
    ends = placed.groupBy("_group", "_slice").agg(F.max(key).alias("_end"))
    across = Window.partitionBy("_group").orderBy("_slice")
    carried = ends.select("_group", "_slice", F.lag("_end").over(across).alias("_carried"))
    joined = lagged.join(carried, ["_group", "_slice"])
    return joined.select(*df.columns, F.coalesce("_lag", "_carried").alias(out))
