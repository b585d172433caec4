"""Column profiles: build, merge, store, compare; key ranges of a source."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceworks.functions.values import SOURCE_TYPE, UNTYPED, text_length
from sourceworks.operators.ordering import number_in_groups

PROFILE_COLUMNS = ["table_name", "column_index", "name", "type", "min_length", "max_length", "record_count"]


def profile(
    df: DataFrame, table_name: str, by: Sequence[str] = (), typed: bool = False
) -> DataFrame:
    """A1/A2: minimum and maximum text length per column plus the record count.

    One aggregate over one scan; partial results combine before the shuffle. A
    null value counts as the empty text. ``by`` gives one profile per group,
    ``typed`` keeps the declared source types, else every type is VARCHAR.
    """
    fields = [f for f in df.schema.fields if f.name not in by]
    # Lengths are columns of their own, so that each value is rendered once for both measures.
    lengths = df.select(
        *by, *[text_length(F.col(f"`{f.name}`"), f.dataType).alias(f"_len{i}") for i, f in enumerate(fields)]
    )
    measures = [F.count(F.lit(1)).alias("_rows")]
    for i in range(len(fields)):
        measures += [F.min(f"_len{i}").alias(f"_min{i}"), F.max(f"_len{i}").alias(f"_max{i}")]
    measured = lengths.groupBy(*by).agg(*measures) if by else lengths.agg(*measures)
    entries = [
        F.struct(
            F.lit(i).alias("column_index"),
            F.lit(field.name).alias("name"),
            F.lit(field.metadata.get(SOURCE_TYPE, "") if typed else UNTYPED).alias("type"),
            F.col(f"_min{i}").alias("min_length"),
            F.col(f"_max{i}").alias("max_length"),
            F.col("_rows").alias("record_count"),
        )
        for i, field in enumerate(fields)
    ]
    return measured.select(F.lit(table_name).alias("table_name"), *by, F.inline(F.array(*entries)))


def union_profiles(profiles: Sequence[DataFrame]) -> DataFrame:
    """Profiles of several tables as one DataFrame (and one job)."""
    return reduce(DataFrame.unionByName, profiles)


def merge_profiles(parts: DataFrame) -> DataFrame:
    """A3: combine partial profiles of the same tables, matched by column index."""
    return (
        parts.groupBy("table_name", "column_index")
        .agg(
            F.max("name").alias("name"),
            F.coalesce(F.max(F.nullif("type", F.lit(""))), F.lit("")).alias("type"),
            F.min("min_length").alias("min_length"),
            F.max("max_length").alias("max_length"),
            F.sum("record_count").alias("record_count"),
        )
        .select(*PROFILE_COLUMNS)
    )


def repeated_names(columns: DataFrame, table: Sequence[str] = ("table_name",), name: str = "name") -> DataFrame:
    """Names that occur more than once in a table, with their frequency."""
    return columns.groupBy(*table, name).agg(F.count(F.lit(1)).alias("frequency")).where("frequency > 1")


def suffix_repeats(
    columns: DataFrame, index: str, table: Sequence[str] = ("table_name",), name: str = "name"
) -> DataFrame:
    """Repeated names of a table get a suffix that counts down in index order."""
    numbered = number_in_groups(columns, [*table, name], index, "_nth", total="_all")
    suffix = (F.col("_all") - F.col("_nth") + 1).cast("string")
    renamed = F.when(F.col("_all") > 1, F.concat_ws("_", F.col(name), suffix)).otherwise(F.col(name))
    return numbered.withColumn(name, renamed).drop("_nth", "_all")


def upsert_profile(stored: DataFrame, fresh: DataFrame, key: Sequence[str] = ("st_oid", "name")) -> DataFrame:
    """Stored column rows with fresh measurements put over them.

    Rows are matched on ``key``; other stored columns (the label among them) are
    kept, and new rows have them null.
    """
    measured = [c for c in fresh.columns if c not in key]
    kept = [c for c in stored.columns if c not in key]
    old, new = stored.alias("old"), fresh.withColumn("_fresh", F.lit(True)).alias("new")
    joined = old.join(new, list(key), "full_outer")
    columns = [F.col(k) for k in key]
    for name in kept:
        if name in measured:
            value = F.when(F.col("new._fresh"), F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))
            columns.append(value.alias(name))
        else:
            columns.append(F.col(f"old.{name}"))
    return joined.select(*columns)


def finish_profile(manifest: DataFrame, counts: DataFrame) -> DataFrame:
    """D3: clear the analyze flag and set the record count of profiled tables (the greatest one given)."""
    done = counts.groupBy("st_oid").agg(F.max("record_count").cast("int").alias("_count"))
    joined = manifest.join(done, "st_oid", "left")
    changed = {
        "analyze_table": F.when(F.col("_count").isNotNull(), F.lit(False)).otherwise(F.col("analyze_table")),
        "record_count": F.coalesce("_count", "record_count"),
    }
    return joined.withColumns(changed).select(*manifest.columns)


def profile_drift(before: DataFrame, after: DataFrame, key: Sequence[str] = ("table_name", "name")) -> DataFrame:
    """Q10: columns that were added, removed or changed in length."""
    old = before.select(*key, F.struct("min_length", "max_length").alias("old"))
    new = after.select(*key, F.struct("min_length", "max_length").alias("new"))
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(~F.col("old").eqNullSafe(F.col("new")), "length")
    )
    return (
        old.join(new, list(key), "full_outer")
        .withColumn("drift", change)
        .where(F.col("drift").isNotNull())
        .select(
            *key,
            "drift",
            F.col("old.min_length").alias("old_min_length"),
            F.col("old.max_length").alias("old_max_length"),
            F.col("new.min_length").alias("new_min_length"),
            F.col("new.max_length").alias("new_max_length"),
        )
    )


def attach_table_ids(profiles: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest id of each profiled table, by name within its run's file."""
    ids = manifest.select("run_id", "file_name", "table_name", "st_oid")
    return profiles.join(ids, ["run_id", "file_name", "table_name"])


def key_range(df: DataFrame, key: str) -> DataFrame:
    """Least and greatest key (-1 when there is none), count, whether dense."""
    measured = df.agg(
        F.coalesce(F.max(key), F.lit(-1)).cast("bigint").alias("max_key"),
        F.coalesce(F.min(key), F.lit(-1)).cast("bigint").alias("min_key"),
        F.count(F.lit(1)).alias("source_count"),
    )
    dense = (F.col("max_key") != -1) & (F.col("max_key") - F.col("min_key") + 1 == F.col("source_count"))
    return measured.withColumn("dense", dense)
