"""Whole intake steps of a run: scan the folder, profile the files, load the files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sourceworks.functions.names import loader_type
from sourceworks.operators.manifest import compare_files, set_flags
from sourceworks.operators.profile import finish_profile, profile, union_profiles, upsert_profile
from sourceworks.session import cut_lineage
from sourceworks.sources.dispatch import read_source
from sourceworks.sources.files import list_files
from sourceworks.sources.records import files_of_tables, profile_records, source_records, write_records
from sourceworks.sources.tables import register_text_table, write_text_table

TABLES_PER_JOB = 50
FILE_LOADERS = ("Flat", "DBF", "Excel")


def _flagged(manifest: DataFrame, run_id: int, flag: str) -> DataFrame:
    return manifest.where((F.col("run_id") == run_id) & F.col(flag))


def _loaders(chosen: DataFrame) -> set[str]:
    """Loaders that a run needs; a file without one is refused."""
    found = {r.loader for r in chosen.select(loader_type(F.col("file_name")).alias("loader")).distinct().collect()}
    if None in found:
        name = chosen.where(loader_type(F.col("file_name")).isNull()).select(F.min("file_name")).first()[0]
        raise ValueError(f"extension of {name!r} is not supported")
    return found


def _database_entries(chosen: DataFrame) -> Iterator[Row]:
    """Tables of databases, each read by a query of its own; fetched as they are needed."""
    rows = chosen.where(~loader_type(F.col("file_name")).isin(*FILE_LOADERS))
    return rows.orderBy("st_oid").toLocalIterator(prefetchPartitions=True)


def _file_records(spark: SparkSession, chosen: DataFrame, folder: str, loaders: set[str]) -> DataFrame:
    """Records of all flagged files; a table without a file that has a header is refused."""
    files = cut_lineage(files_of_tables(spark, chosen, folder))
    wanted = chosen.where(loader_type(F.col("file_name")).isin(*FILE_LOADERS))
    lost = wanted.join(files.select("st_oid"), "st_oid", "left_anti").select(F.min("file_name")).first()[0]
    if lost is not None:
        raise ValueError(f"{folder}/{lost} has no header record")
    return source_records(files, loaders)


def scan_folder(spark: SparkSession, manifest: DataFrame, run_id: int, folder: str) -> DataFrame:
    """What the run needs against what its folder holds (see ``compare_files``)."""
    expected = manifest.where(F.col("run_id") == run_id).select("run_id", "st_oid", "file_name", "collect_type")
    found = list_files(spark, folder).select(F.lit(run_id).cast("bigint").alias("run_id"), "file_name")
    return compare_files(expected, found)


def profile_run(
    spark: SparkSession, manifest: DataFrame, run_id: int, folder: str, jdbc_url: Callable | None = None
) -> Iterator[DataFrame]:
    """Profiles of a run's flagged tables; rows carry the manifest id (``st_oid``) of their table.

    All files are read by one plan, whose number of jobs doesn't depend on that of the tables. Tables of databases
    follow, in unions of up to 50.
    """
    chosen = _flagged(manifest, run_id, "analyze_table")
    loaders = _loaders(chosen)
    if loaders & set(FILE_LOADERS):
        yield profile_records(_file_records(spark, chosen, folder, loaders), chosen)
    batch: list[DataFrame] = []
    for entry in _database_entries(chosen) if loaders - set(FILE_LOADERS) else ():
        table = read_source(spark, folder, entry, jdbc_url)
        batch.append(profile(table, entry.table_name, typed=True).withColumn("st_oid", F.lit(entry.st_oid)))
        if len(batch) == TABLES_PER_JOB:
            yield union_profiles(batch)
            batch = []
    if batch:
        yield union_profiles(batch)


def finish_analysis(
    manifest: DataFrame, stored: DataFrame, profiles: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """D2 and D3 for fresh profiles: the new manifest and the new column table."""
    fresh = profiles.select("st_oid", "name", "type", "min_length", "max_length", "column_index")
    counts = profiles.groupBy("st_oid").agg(F.max("record_count").alias("record_count"))
    return finish_profile(manifest, counts), upsert_profile(stored, fresh)


def load_run(
    spark: SparkSession,
    manifest: DataFrame,
    run_id: int,
    folder: str,
    target: str | None = None,
    jdbc_url: Callable | None = None,
) -> DataFrame:
    """Load a run's flagged tables as text tables; returns the manifest with their flags cleared.

    Files are read by one plan and their tables written by one job, each to a new folder below ``target`` (or
    the warehouse); then the catalog is told of the tables one by one, which starts no job. So a table is replaced as a whole, and
    a run that breaks off can be started again. Folders of earlier loads are left to their owner. The driver
    holds the column names of the run's tables, as the catalog does. Tables of databases are written one after another.
    """
    chosen = _flagged(manifest, run_id, "load")
    loaders, loaded = _loaders(chosen), []
    if loaders & set(FILE_LOADERS):
        records = cut_lineage(_file_records(spark, chosen, folder, loaders))
        names = {r.st_oid: r.cells for r in records.where("header").select("st_oid", "cells").toLocalIterator()}
        tables = {r.st_oid: r.table_name for r in chosen.select("st_oid", "table_name").toLocalIterator() if r.st_oid in names}
        base = (target or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
        version = uuid.uuid4().hex
        places = {st_oid: f"{base}/{name.lower()}/{version}" for st_oid, name in tables.items()}
        write_records(records, names, places)
        for st_oid, name in tables.items():
            register_text_table(spark, name, names[st_oid], places[st_oid])
        loaded += [(st_oid,) for st_oid in tables]
    for entry in _database_entries(chosen) if loaders - set(FILE_LOADERS) else ():
        table = read_source(spark, folder, entry, jdbc_url)
        path = f"{target.rstrip('/')}/{entry.table_name.lower()}" if target else None
        write_text_table(table, entry.table_name, path)
        loaded.append((entry.st_oid,))
    keys = spark.createDataFrame(loaded, "st_oid bigint")
    return set_flags(manifest, keys, "st_oid", {"load": False})
