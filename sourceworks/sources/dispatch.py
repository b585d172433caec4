"""Reader of a manifest row, chosen by the extension of its file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sourceworks.functions.names import delimiter_of, loader_of
from sourceworks.sources.database import covering_predicates, read_sub_table
from sourceworks.sources.dbf import read_dbf
from sourceworks.sources.flat import read_flat
from sourceworks.sources.sheets import read_sheet


def read_source(spark: SparkSession, folder: str, entry, jdbc_url=None, jdbc_key=None) -> DataFrame:
    """The table of one manifest row (any object with its fields, such as a ``Row``).

    Only spreadsheets and databases have sub tables. ``jdbc_url`` maps the path of
    a database file to a JDBC address. ``jdbc_key`` maps an address and a sub table to the whole-number key it is read by
    in parallel, as (key, least, greatest, rows a task); without one, or where it gives none, one task reads the table.
    """
    path = f"{folder.rstrip('/')}/{entry.file_name}"
    loader = loader_of(entry.file_name)
    if loader == "Flat":
        return read_flat(
            spark,
            path,
            delimiter=delimiter_of(entry.delimiter),
            qualified=bool(entry.qualified),
            encoding=entry.encoding or "utf8",
        )
    if loader == "DBF":
        return read_dbf(spark, path)
    if not (entry.sub_table or "").strip():
        raise ValueError(f"{loader} file {entry.file_name} cannot have a null sub table")
    if loader == "Excel":
        if entry.file_name.lower().endswith(".xls"):
            raise ValueError(f"{entry.file_name}: legacy binary workbooks must be saved as .xlsx first")
        return read_sheet(spark, path, entry.sub_table)
    if jdbc_url is None:
        raise ValueError(f"{entry.file_name}: a database file needs a JDBC address")
    url = jdbc_url(path)
    key = jdbc_key(url, entry.sub_table) if jdbc_key else None
    return read_sub_table(spark, url, entry.sub_table, covering_predicates(*key) if key else None)
