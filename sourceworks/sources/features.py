"""Feature services: description documents and pages of features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceworks.functions.values import SOURCE_TYPE, UNTYPED
from sourceworks.operators.changes import merged_map

POINT = "esriGeometryPoint"
MULTIPOINT = "esriGeometryMultipoint"
POLYGON = "esriGeometryPolygon"
# Columns that a geometry type adds.
GEOMETRY_COLUMNS = {POINT: ["X", "Y"], MULTIPOINT: ["POINTS"], POLYGON: ["RINGS"]}

PAGE = "features array<struct<attributes: map<string,string>, geometry: map<string,string>>>, error string"
DESCRIPTION = """
    type string, name string, maxRecordCount int, geometryType string,
    supportsPagination boolean, supportsStatistics boolean,
    advancedQueryCapabilities struct<supportsPagination: boolean, supportsStatistics: boolean>,
    fields array<struct<name: string, type: string>>"""


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Response pages, one file each, as (path, body). A page holds at most 10,000 features."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")
    )


def checked_pages(pages: DataFrame) -> DataFrame:
    """Pages with their outcome: ok, retry (an error was reported) or fatal."""
    # Exploding an array of one keeps filters on the page from parsing the text once more for each condition.
    parsed = pages.withColumn("_page", F.explode(F.array(F.from_json("body", PAGE))))
    outcome = (
        F.when(F.col("_page.features").isNotNull(), "ok").when(F.col("_page.error").isNotNull(), "retry").otherwise("fatal")
    )
    return parsed.withColumn("outcome", outcome)


def geometry_fields(geometry: Column, geometry_type: str) -> Column:
    """geometry as a map of text columns; an absent geometry gives nulls."""
    if geometry_type == POINT:
        return F.transform_keys(geometry, lambda k, _: F.upper(k))
    if geometry_type == MULTIPOINT:
        return F.create_map(F.lit("POINTS"), F.try_element_at(geometry, F.lit("points")))
    if geometry_type == POLYGON:
        return F.create_map(F.lit("RINGS"), F.try_element_at(geometry, F.lit("rings")))
    return F.lit(None).cast("map<string,string>")


def feature_rows(pages: DataFrame, fields: Sequence[str], geometry_type: str = "") -> DataFrame:
    """S7/S12 (F23, F24, U4): features of all good pages as one table of nullable text columns.

    ``fields`` are the columns of the service description, geometry columns
    included; geometry values win over attributes of the same name.
    """
    good = checked_pages(pages).where("outcome = 'ok'")
    features = good.select(F.explode("_page.features").alias("_feature"))
    record = merged_map(F.col("_feature.attributes"), geometry_fields(F.col("_feature.geometry"), geometry_type))
    return features.select(record.alias("_record")).select(
        *[
            F.try_element_at("_record", F.lit(name)).alias(name, metadata={SOURCE_TYPE: UNTYPED})
            for name in fields
        ]
    )


def service_metadata(descriptions: DataFrame) -> DataFrame:
    """Service descriptions (url, body, count) as metadata rows.

    The nested capability object wins over the top-level flags; the shape field
    and geometry fields give way to the columns of the geometry type.
    """
    d = F.from_json("body", DESCRIPTION)
    nested = F.col("d.advancedQueryCapabilities")
    geometry = F.coalesce("d.geometryType", F.lit(""))
    extra = F.array().cast("array<string>")
    for kind, columns in GEOMETRY_COLUMNS.items():
        extra = F.when(geometry == kind, F.array(*map(F.lit, columns))).otherwise(extra)
    fields = F.coalesce("d.fields", F.array().cast("array<struct<name:string,type:string>>"))
    plain = F.filter(
        fields,
        lambda f: f["name"].isNotNull()
        & (f["name"] != "Shape")
        & (F.coalesce(f["type"], F.lit("")) != "esriFieldTypeGeometry"),
    )
    keys = F.filter(fields, lambda f: f["type"] == "esriFieldTypeOID")

    def flag(name: str) -> Column:
        own = F.when(nested.isNotNull(), nested[name]).otherwise(F.col(f"d.{name}"))
        return F.coalesce(own, F.lit(False))

    return descriptions.withColumn("d", d).select(
        "url",
        F.coalesce("d.name", F.lit("")).alias("name"),
        F.coalesce("count", F.lit(-1)).cast("bigint").alias("source_count"),
        F.coalesce("d.type", F.lit("")).alias("server_type"),
        F.coalesce("d.maxRecordCount", F.lit(-1)).alias("max_record_count"),
        flag("supportsPagination").alias("pagination"),
        flag("supportsStatistics").alias("stats"),
        geometry.alias("geometry_type"),
        F.concat(F.transform(plain, lambda f: f["name"]), extra).alias("fields"),
        F.coalesce(F.try_element_at(keys, F.lit(1))["name"], F.lit("")).alias("oid_field"),
    )
