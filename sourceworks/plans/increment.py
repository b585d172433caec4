"""Profiles of a folder of flat files that grow with it: only new versions of files are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceworks.operators.ordering import number_by_sort
from sourceworks.operators.profile import merge_profiles
from sourceworks.session import cut_lineage
from sourceworks.sources.records import flat_source_records, profile_records

VERSION = ["file_name", "length", "checksum"]
PARTIAL = (
    "file_name string, length bigint, checksum string, table_name string, column_index int, name string, type string, "
    "min_length int, max_length int, record_count bigint"
)


def profile_versions(
    spark: SparkSession,
    folder: str,
    versions: DataFrame,
    stored: DataFrame,
    table_name: str,
    delimiter: str = ",",
    qualified: bool = True,
    encoding: str = "utf8",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile, partial profiles, files read) of the flat files of one table.

    ``versions`` names the files below ``folder`` with length and checksum, as the backup manifest (S19) has them;
    ``stored`` has the partial profiles of an earlier call (``PARTIAL``), a row for each column of a file version. Files whose
    version is not among them are read by one plan; the partial profiles of all current versions are merged (A3). What is
    stored of versions that are gone is left out of the new partial profiles.
    """
    current = versions.select(*VERSION)
    known = stored.join(current, VERSION, "left_semi")
    fresh = cut_lineage(current.join(stored.select(*VERSION).distinct(), VERSION, "left_anti"))
    numbered = cut_lineage(number_by_sort(fresh, [], ["file_name"], "st_oid"))
    files = numbered.select(
        "st_oid",
        F.concat(F.lit(folder.rstrip("/") + "/"), "file_name").alias("path"),
        "length",
        F.lit(delimiter).alias("delimiter"),
        F.lit(qualified).alias("qualified"),
        F.lit(encoding).alias("encoding"),
    )
    tables = numbered.select("st_oid", F.lit(table_name).alias("table_name"))
    found = profile_records(flat_source_records(files), tables).join(numbered, "st_oid")
    columns = [part.split()[0] for part in PARTIAL.split(", ")]
    partial = cut_lineage(known.select(*columns).unionByName(found.select(*columns)))
    return merge_profiles(partial), partial, fresh
