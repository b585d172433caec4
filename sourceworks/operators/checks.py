"""Data-quality checks: each returns violating rows (table_name, rule, key, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceworks import schemas
from sourceworks.functions.names import loader_type
from sourceworks.functions.values import array_not_blank, is_count_map, not_blank

# Patterns of manifest columns.
TABLE_NAME_PATTERN = r"^[0-9A-Z_]+$"
FILE_NAME_PATTERN = r"^.+\..+$"
FILE_ID_PATTERN = r"^F\d+$"


def matches(column: str, pattern: str) -> tuple[Column, Column]:
    """Q1: rule that a value matches a pattern; null passes."""
    return ~F.col(column).rlike(pattern), F.col(column)


def filled(column: str) -> tuple[Column, Column]:
    """Q2: rule that a text is null or not blank."""
    return ~not_blank(F.col(column)), F.col(column)


def items_filled(column: str) -> tuple[Column, Column]:
    """Q2: rule that an array has items and none is blank."""
    return ~array_not_blank(F.col(column)), F.to_json(column)


def one_of(column: str, allowed: Sequence[str]) -> tuple[Column, Column]:
    """Q6: rule that a value is a member of an enumeration; null passes."""
    return ~F.col(column).isin(list(allowed)), F.col(column)


def required(column: str) -> tuple[Column, Column]:
    """Q6: rule that a value is there."""
    return F.col(column).isNull(), F.lit(None).cast("string")


def sub_table_fits(file_name: str = "file_name", sub_table: str = "sub_table") -> tuple[Column, Column]:
    """Q5: rule that a sub table is named exactly for loaders that have sub tables."""
    needs = loader_type(F.col(file_name)).isin(schemas.SUB_TABLE_LOADERS)
    named = F.coalesce(~F.col(sub_table).rlike(r"^\s*$"), F.lit(False))
    return F.coalesce(needs, F.lit(False)) != named, F.col(sub_table)


def counts_decode(column: str) -> tuple[Column, Column]:
    """F16: rule that a JSON text decodes to label counts; null passes."""
    return F.col(column).isNotNull() & ~is_count_map(F.col(column)), F.col(column)


def row_violations(
    df: DataFrame, table_name: str, key: Column, rules: Mapping[str, tuple[Column, Column]]
) -> DataFrame:
    """All row rules of a table in one pass over it."""
    found = [
        F.when(broken, F.struct(F.lit(rule).alias("rule"), value.cast("string").alias("value")))
        for rule, (broken, value) in rules.items()
    ]
    broken = F.filter(F.array(*found), lambda v: v.isNotNull())
    exploded = df.select(key.cast("string").alias("key"), F.explode(broken).alias("_v"))
    return exploded.select(F.lit(table_name).alias("table_name"), "_v.rule", "key", "_v.value")


def unique_violations(df: DataFrame, table_name: str, columns: Sequence[str], rule: str) -> DataFrame:
    """Q3: keys that occur more than once, with their frequency as the value."""
    repeated = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return repeated.select(
        F.lit(table_name).alias("table_name"),
        F.lit(rule).alias("rule"),
        key.alias("key"),
        F.col("_n").cast("string").alias("value"),
    )


def reference_violations(
    child: DataFrame, table_name: str, key: Column, foreign: str, parent: DataFrame, parent_key: str, rule: str
) -> DataFrame:
    """Q4: child rows whose reference has no parent row; a null reference passes."""
    known = parent.select(F.col(parent_key).alias("_known"))
    orphans = child.where(F.col(foreign).isNotNull()).join(known, F.col(foreign) == F.col("_known"), "left_anti")
    return orphans.select(
        F.lit(table_name).alias("table_name"),
        F.lit(rule).alias("rule"),
        key.cast("string").alias("key"),
        F.col(foreign).cast("string").alias("value"),
    )


def cascade_delete(child: DataFrame, foreign: str, deleted: DataFrame, parent_key: str) -> DataFrame:
    """Q4: child rows without those whose parent was deleted."""
    gone = deleted.select(F.col(parent_key).alias("_gone"))
    return child.join(gone, F.col(foreign) == F.col("_gone"), "left_anti")


def set_null_on_delete(child: DataFrame, foreign: str, deleted: DataFrame, parent_key: str) -> DataFrame:
    """Q4: child rows with the reference to a deleted parent cleared."""
    gone = deleted.select(F.col(parent_key).alias("_gone")).distinct()
    joined = child.join(gone, F.col(foreign) == F.col("_gone"), "left")
    return joined.withColumn(foreign, F.when(F.col("_gone").isNull(), F.col(foreign))).select(*child.columns)


def restricted_deletes(child: DataFrame, foreign: str, deleted: DataFrame, parent_key: str) -> DataFrame:
    """Q4: parents that may not be deleted because a child refers to them."""
    used = child.select(F.col(foreign).alias(parent_key))
    return deleted.join(used, parent_key, "left_semi")


def runs_without_tables(runs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Q7: runs that have no manifest row."""
    empty = runs.join(manifest.select("run_id"), "run_id", "left_anti")
    return empty.select(
        F.lit("pipeline_runs").alias("table_name"),
        F.lit("has_source_table").alias("rule"),
        F.col("run_id").cast("string").alias("key"),
        F.lit(None).cast("string").alias("value"),
    )


def manifest_violations(manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """Q1-Q7: every rule of the manifest table."""
    rules = {
        "table_name_pattern": matches("table_name", TABLE_NAME_PATTERN),
        "file_name_pattern": matches("file_name", FILE_NAME_PATTERN),
        "file_id_pattern": matches("file_id", FILE_ID_PATTERN),
        "file_id_required": required("file_id"),
        "encoding_filled": filled("encoding"),
        "sub_table_filled": filled("sub_table"),
        "url_filled": filled("url"),
        "comments_filled": filled("comments"),
        "delimiter_filled": filled("delimiter"),
        "delimiter_one_char": (F.length("delimiter") > 1, F.col("delimiter")),
        "collect_type_known": one_of("collect_type", schemas.FILE_COLLECT_TYPES),
        "loader_type_known": one_of("loader_type", schemas.LOADER_TYPES),
        "sub_table_fits_loader": sub_table_fits(),
    }
    name = "source_tables"
    parts = [
        row_violations(manifest, name, F.col("st_oid"), rules),
        unique_violations(manifest.where(F.col("file_id").isNotNull()), name, ["run_id", "file_id"], "file_id_unique"),
        unique_violations(manifest, name, ["run_id", "table_name"], "table_name_unique"),
        reference_violations(manifest, name, F.col("st_oid"), "run_id", runs, "run_id", "run_exists"),
        runs_without_tables(runs, manifest),
    ]
    return reduce(DataFrame.unionByName, parts)


def column_violations(columns: DataFrame, manifest: DataFrame) -> DataFrame:
    """Q2-Q4, L4: rules of the stored column profile."""
    name = "source_table_columns"
    return (
        row_violations(columns, name, F.col("name"), {"label_filled": filled("label"), "name_filled": filled("name")})
        .unionByName(unique_violations(columns, name, ["st_oid", "name"], "name_unique"))
        .unionByName(reference_violations(columns, name, F.col("name"), "st_oid", manifest, "st_oid", "table_exists"))
    )


def template_violations(template_tasks: DataFrame) -> DataFrame:
    """Q3: repeated places in a template."""
    place = ["pipeline_id", "parent_task", "parent_task_order"]
    return unique_violations(template_tasks, "pipeline_tasks", place, "place_unique")
