"""Sub tables of a database as all-text tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceworks.functions.names import table_header
from sourceworks.functions.values import SOURCE_TYPE, table_as_text, type_label


def typed_as_source(df: DataFrame) -> DataFrame:
    """A typed table under normalized names, as text, with its declared types as labels."""
    names = table_header(df.columns)
    renamed = df.select(
        *[
            F.col(f"`{f.name}`").alias(name, metadata={SOURCE_TYPE: type_label(f.dataType)})
            for name, f in zip(names, df.schema.fields, strict=True)
        ]
    )
    return table_as_text(renamed)


def range_predicates(key: str, least: int, greatest: int, page: int) -> list[str]:
    """One condition per key range, for parallel reads of a table."""
    if page < 1:
        raise ValueError("page size must be positive")
    return [
        f"{key} >= {low} AND {key} <= {low + page - 1}" for low in range(least, greatest + 1, page)
    ]


def covering_predicates(key: str, least: int, greatest: int, page: int) -> list[str]:
    """Conditions of which every row meets exactly one, also rows without a key, and those outside a range that has grown since."""
    inner = range_predicates(key, least, greatest, page)
    if not inner:
        return []
    return [*inner, f"{key} < {least} OR {key} > {least + len(inner) * page - 1} OR {key} IS NULL"]


def read_sub_table(
    spark: SparkSession, url: str, sub_table: str, predicates: Sequence[str] | None = None, **properties: str
) -> DataFrame:
    """A database table over JDBC; ``predicates`` give one task each."""
    if predicates:
        typed = spark.read.jdbc(url, sub_table, predicates=list(predicates), properties=properties)
    else:
        typed = spark.read.jdbc(url, sub_table, properties=properties)
    return typed_as_source(typed)
