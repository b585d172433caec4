"""File decoders as SQL table functions over a table of files.

Each takes ``TABLE(files)`` with a column ``path`` (and ``sheet`` for workbooks) and gives every column of that table
followed by its own. Files are opened by the tasks that decode them; a task has one file at a time.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from sourceworks.functions.names import table_header
from sourceworks.session import ship_package
from sourceworks.sources.dbf import BINARY_FIELDS, FIELD_TYPES, MEMO_FIELDS, RANGE_BYTES, binary_text, dbf_layout, memo_texts, plain_text
from sourceworks.sources.files import open_file
from sourceworks.sources.sheets import cells_of_sheet


_TEXTS = ArrayType(StringType())


def _extended(files: AnalyzeArgument, needs: tuple[str, ...], columns: dict[str, DataType]) -> AnalyzeResult:
    """The columns of the given table, then those of the decoder."""
    if not files.isTable:
        raise ValueError("give a table of files: TABLE(files)")
    missing = [c for c in needs if c not in files.dataType.names]
    if missing:
        raise ValueError(f"the table of files has no column {missing[0]}")
    clash = [name for name in columns if name in files.dataType.names]
    if clash:
        raise ValueError(f"the table of files already has a column {clash[0]}")
    return AnalyzeResult(StructType([*files.dataType.fields, *[StructField(n, t) for n, t in columns.items()]]))


class SheetRecords:
    """Rows of sheets: row_no, header, kinds and raws (see ``sheet_text``)."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        return _extended(files, ("path", "sheet"), {"row_no": IntegerType(), "header": BooleanType(), "kinds": _TEXTS, "raws": _TEXTS})

    def eval(self, file: Row) -> Iterator[tuple]:
        with open_file(file["path"]) as stream:
            for row in cells_of_sheet(stream, file["sheet"]):
                yield (*file, *row)


class DbfRecords:
    """Records of tables: header (whose cells are the column names), cells, and in the header row the types."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        return _extended(files, ("path",), {"header": BooleanType(), "cells": _TEXTS, "types": _TEXTS})

    def eval(self, file: Row) -> Iterator[tuple]:
        layout = dbf_layout(file["path"])
        names = table_header([name for name, *_ in layout.fields])
        yield (*file, True, names, [FIELD_TYPES[letter] for _, letter, *_ in layout.fields])
        step = max(1, RANGE_BYTES // max(1, layout.record_bytes))
        with open_file(file["path"]) as stream:
            for first in range(0, layout.records, step):
                stream.seek(layout.start + first * layout.record_bytes)
                block = stream.read(min(step, layout.records - first) * layout.record_bytes)
                whole = len(block) // layout.record_bytes
                records = np.frombuffer(block, np.uint8, whole * layout.record_bytes).reshape(whole, layout.record_bytes)
                kept = records[records[:, 0] != ord("*")]
                columns = []
                for _, letter, offset, width in layout.fields:
                    raw = kept[:, offset : offset + width]
                    if letter in BINARY_FIELDS:
                        columns.append(binary_text(letter, raw).tolist())
                    elif letter in MEMO_FIELDS:
                        columns.append(memo_texts(file["path"], layout.version, raw))
                    else:
                        texts = np.char.decode(np.ascontiguousarray(raw).view(f"S{width}").ravel(), "latin-1").tolist()
                        columns.append([plain_text(letter, t) for t in texts])
                for cells in zip(*columns, strict=True):
                    yield (*file, False, list(cells), None)


class ArchiveEntries:
    """Entries of archives: entry and length; only directories are read."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        return _extended(files, ("path",), {"entry": StringType(), "length": LongType()})

    def eval(self, file: Row) -> Iterator[tuple]:
        with open_file(file["path"]) as stream, zipfile.ZipFile(stream) as archive:
            for entry in archive.infolist():
                if not entry.is_dir():
                    yield (*file, entry.filename, entry.file_size)


_NUMBER = "try_cast(raw AS DOUBLE)"
_PLAIN = f"""CASE WHEN floor({_NUMBER}) = {_NUMBER} AND abs({_NUMBER}) < 9.0e18 THEN CAST(try_cast({_NUMBER} AS BIGINT) AS STRING)
                  ELSE CAST({_NUMBER} AS STRING) END"""


def register(spark: SparkSession) -> None:
    """The table functions ``sheet_records``, ``dbf_records`` and ``archive_entries``, and ``sheet_text(kind, raw)`` for cells."""
    ship_package(spark)
    for name, decoder in (("sheet_records", SheetRecords), ("dbf_records", DbfRecords), ("archive_entries", ArchiveEntries)):
        spark.udtf.register(name, udtf(decoder))
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION sheet_text(kind STRING, raw STRING) RETURNS STRING
            RETURN coalesce(regexp_replace(
                CASE WHEN kind = 'str' THEN raw
                     WHEN kind = 'n' THEN {_PLAIN}
                     WHEN startswith(kind, 'date') THEN
                          CASE WHEN {_NUMBER} >= 0 THEN CAST(date_add(
                                   CASE WHEN kind = 'date1904' THEN DATE'1904-01-01'
                                        WHEN CAST(floor({_NUMBER}) AS INT) < 61 THEN DATE'1899-12-31'
                                        ELSE DATE'1899-12-30' END, CAST(floor({_NUMBER}) AS INT)) AS STRING)
                               ELSE {_PLAIN} END
                     WHEN kind = 'b' THEN CASE WHEN raw IN ('1', 'true') THEN 'TRUE' ELSE 'FALSE' END
                     WHEN kind <> 'blank' THEN raw END,
                '^\\\\s+|\\\\s+$', ''), '')"""
    )
