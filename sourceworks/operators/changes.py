"""Sparse updates of keyed tables, and small set operations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceworks.session import cut_lineage


def fold_changes(changes: DataFrame, key: str, sequence: str) -> DataFrame:
    """One change map per key, each field with its newest value; null is a value.

    Fields reduce one by one before the map is put together, so a key with very
    many changes never has more than one entry per field in one place.
    """
    fields = changes.select(key, sequence, F.explode("changes").alias("field", "value"))
    newest = fields.groupBy(key, "field").agg(F.max_by("value", sequence).alias("value"))
    entries = F.collect_list(F.struct("field", "value"))
    return newest.groupBy(key).agg(F.map_from_entries(entries).alias("changes"))


def sparse_update(table: DataFrame, changes: DataFrame, key: str, updatable: Sequence[str]) -> DataFrame:
    """Set only the supplied fields; a supplied null clears the field.

    ``changes`` has (key, changes map<string,string>) with one row per key (see
    ``fold_changes``); values are cast to the type of their column.
    """
    types = {f.name: f.dataType for f in table.schema.fields}
    joined = table.join(changes.select(key, "changes"), key, "left")
    changed = {
        name: F.when(
            F.coalesce(F.map_contains_key("changes", F.lit(name)), F.lit(False)),
            F.try_element_at("changes", F.lit(name)).cast(types[name]),
        ).otherwise(F.col(name))
        for name in updatable
    }
    return joined.withColumns(changed).select(*table.columns)


def set_status(
    table: DataFrame, statuses: DataFrame, key: str, column: str = "task_status", sequence: str = "sequence"
) -> DataFrame:
    """Set one column by key; ``statuses`` has (key, column, sequence), of which the last of a key counts."""
    new = statuses.groupBy(key).agg(F.max_by(column, sequence).alias("_new"))
    return (
        table.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).select(*table.columns)
    )


def without_item(items: Column, item: str) -> Column:
    """An array without one item."""
    return F.array_except(items, F.array(F.lit(item)))


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on both sides; empty when the sides are disjoint."""
    return left.select(key).intersect(right.select(key))


def merged_map(left: Column, right: Column) -> Column:
    """U4: union of two maps, the right side wins on equal keys."""
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.when(right.isNull(), left).when(left.isNull(), right).otherwise(F.map_concat(kept, right))


def write_parted(table: DataFrame, path: str, key: str, parts: int = 64) -> None:
    """Write a table as ``parts`` folders by the hash of its key, so that a change of few keys rewrites few of them."""
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    table.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def files_with_keys(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """(part, file) of the files of a parted table that hold any of the keys; only the key column is read."""
    table = spark.read.parquet(path).select(key, "part", F.col("_metadata.file_path").alias("file"))
    return table.join(keys.select(key).distinct(), key, "left_semi").select("part", "file").distinct()


def rewrite_keys(
    spark: SparkSession, path: str, keys: DataFrame, key: str, change: Callable[[DataFrame], DataFrame], parts: int = 64
) -> DataFrame:
    """Apply a change (D1 to D6, D10 to D12) to the rows of a parted table that share a part with any of the keys.

    ``keys`` are all keys that the change touches, new ones too; ``change`` takes rows and returns them changed, with no
    other effect than on these keys. Other parts are neither read nor written: theirs are overwritten dynamically, when all
    new rows lie ready. A part that loses its last row goes. Returns (part) of the parts rewritten.
    """
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    touched = cut_lineage(keys.select(part.alias("part")).distinct())
    table = spark.read.parquet(path)
    old = table.join(touched, "part", "left_semi").drop("part")
    new = cut_lineage(change(old).withColumn("part", part))
    new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for row in touched.join(new.select("part"), "part", "left_anti").collect():  # at most as many as there are parts
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"part={row.part}"), True)
    return touched
