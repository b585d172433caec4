"""Fetch plans for paged services and key ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_CAP = 10_000


def page_size(max_record_count: Column) -> Column:
    """Rows per request: the service's limit, at most 10,000; null when it is not positive."""
    return F.when(max_record_count > 0, F.least(max_record_count, F.lit(PAGE_CAP)).cast("bigint"))


def _steps(count: Column) -> Column:
    """0 .. count-1 as rows."""
    return F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1)))


def page_plan(services: DataFrame) -> DataFrame:
    """One row per page offset for services that page.

    ``services`` has (url, source_count, max_record_count, pagination).
    """
    paged = services.where("pagination").withColumn("page", page_size(F.col("max_record_count")))
    count = F.ceil(F.col("source_count") / F.col("page")).cast("bigint")
    return paged.select("url", "page", _steps(count).alias("step")).select(
        "url", (F.col("step") * F.col("page")).alias("offset"), F.col("page").alias("page_rows")
    )


def range_plan(services: DataFrame) -> DataFrame:
    """One row per key range for services that do not page but have a key field.

    ``services`` also has (oid_field, min_key, max_key). A source without any key
    (-1) gives no ranges.
    """
    ranged = services.where("NOT pagination AND oid_field <> '' AND max_key <> -1").withColumn(
        "page", page_size(F.col("max_record_count"))
    )
    count = F.ceil((F.col("max_key") - F.col("min_key") + 1) / F.col("page")).cast("bigint")
    low = F.col("min_key") + F.col("step") * F.col("page")
    return ranged.select("url", "oid_field", "min_key", "page", _steps(count).alias("step")).select(
        "url", "oid_field", low.alias("low"), (low + F.col("page") - 1).alias("high")
    )


def _geometry_part() -> Column:
    return F.when(F.col("server_type") == "TABLE", "").otherwise(
        F.concat(F.lit("&geometryType="), "geometry_type", F.lit("&outSR=4269"))
    )


def fetch_queries(services: DataFrame) -> DataFrame:
    """Request addresses of every service: by page, else by key range, else none."""
    described = services.select("url", _geometry_part().alias("_geo"))
    tail = F.concat("_geo", F.lit("&outFields=*&f=json"))
    by_page = page_plan(services).join(described, "url").select(
        "url",
        F.col("offset").alias("start"),
        F.concat(
            "url", F.lit("/query?where=1+%3D+1&resultOffset="), F.col("offset").cast("string"),
            F.lit("&resultRecordCount="), F.col("page_rows").cast("string"), tail,
        ).alias("query"),
    )
    by_range = range_plan(services).join(described, "url").select(
        "url",
        F.col("low").alias("start"),
        F.concat(
            "url", F.lit("/query?where="), "oid_field", F.lit("+>%3D+"), F.col("low").cast("string"),
            F.lit("+and+"), "oid_field", F.lit("+<%3D+"), F.col("high").cast("string"), tail,
        ).alias("query"),
    )
    return by_page.unionByName(by_range)
