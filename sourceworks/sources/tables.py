"""Warehouse tables: text-table sink, seed loads, catalog look-ups, queries."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceworks.functions.values import table_as_text
from sourceworks.operators.ordering import number_by_sort


def table_exists(spark: SparkSession, name: str) -> bool:
    """Whether a table is in the catalog."""
    return spark.catalog.tableExists(name.lower())


def column_list(spark: SparkSession, name: str) -> list[str]:
    """Column names of a table in order."""
    if not table_exists(spark, name):
        raise ValueError(f"no table named {name}")
    return spark.table(name.lower()).columns


def write_text_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Replace a table with the rows of ``df``, every column as text.

    ``path`` makes it an external Parquet table. The target must not be a source
    of ``df``.
    """
    writer = table_as_text(df).write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name.lower())


def register_text_table(spark: SparkSession, name: str, columns: Iterable[str], path: str) -> None:
    """Make a folder of Parquet files with these text columns a table, in place of one of the same name; starts no job."""
    listed = ", ".join(f"`{c}` STRING" for c in columns)
    spark.sql(f"DROP TABLE IF EXISTS `{name.lower()}`")
    spark.sql(f"CREATE TABLE `{name.lower()}` ({listed}) USING parquet LOCATION '{path}'")


def append_seed(
    target: DataFrame, seed: DataFrame, identity: str, order: Iterable[str]
) -> DataFrame:
    """Seed rows under the target's schema, with ids that go on from the greatest one."""
    order = list(order)
    # Rows that agree in the order columns are told apart by the others, so ids are the same in every run.
    numbered = number_by_sort(seed, [], [*order, *[c for c in seed.columns if c not in order]], "_nth")
    top = target.agg(F.coalesce(F.max(identity), F.lit(0))).scalar()
    given = numbered.withColumn(identity, top + F.col("_nth"))
    columns = [
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in given.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in target.schema.fields
    ]
    return target.unionByName(given.select(*columns))


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """A seed CSV with header, as text columns under their own names."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


def run_query(spark: SparkSession, sql: str, parameters: Mapping[str, object]) -> DataFrame:
    """A query with named parameters; a list parameter stands for the members of ``IN (:names)``.

    Each member is a parameter of its own, so that the list reaches the scan as a
    filter; values never become part of the text. An empty list is ``IN (NULL)``, which
    no row meets.
    """
    bound: dict[str, object] = {}
    for name, value in parameters.items():
        if not isinstance(value, (list, tuple, set)):
            bound[name] = value
            continue
        members = {f"{name}__{k}": member for k, member in enumerate(value)}
        bound |= members
        markers = ", ".join(f":{m}" for m in members) or "NULL"
        # Quoted text is matched first and kept.
        sql = re.sub(rf"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|:{name}\b", lambda m, new=markers: m[1] or new, sql)
    return spark.sql(sql, args=bound)
