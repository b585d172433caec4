"""Row numbers in groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourceworks.session import cut_lineage


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], rank: str, total: str) -> DataFrame:
    """``df`` with the row number (from 1) in its group by ``order``, and the group's size.

    Rows are range-partitioned on (group, order), so a group that holds most of
    the rows spreads over many partitions; a row's number is its place in the
    sorted partition plus the sizes of the group's earlier partitions, a table of
    at most one row per group and partition. Bounds of ranges come from a sample, so the sorted
    rows are written before they are used twice. Null members of a group are
    equal. Rows that agree in all order columns are numbered arbitrarily among
    themselves: give a unique last column where that matters.
    """
    ranged = df.repartitionByRange(*group, *order) if group or order else df
    placed = cut_lineage(
        ranged.sortWithinPartitions(*group, *order).withColumn("_seq", F.monotonically_increasing_id())
    )
    keyed = placed.withColumn("_group", F.struct(F.lit(0).alias("all"), *group)).withColumn(
        "_part", F.shiftright("_seq", 33)
    )
    sizes = keyed.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_seq").alias("_first"))
    inside = Window.partitionBy("_group")
    earlier = inside.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_group",
        "_part",
        "_first",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_size").over(inside).alias(total),
    )
    number = F.col("_seq") - F.col("_first") + F.col("_before") + 1
    return keyed.join(offsets, ["_group", "_part"]).select(*df.columns, number.alias(rank), total)
