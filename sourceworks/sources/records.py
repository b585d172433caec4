"""Records of many files of any kind in one long form, so that a whole run is read by one plan.

A row is a record of one table: ``st_oid``, ``header`` and ``cells``. The header row of
a table has its column names as cells, and ``types`` with their declared types (null in other rows). Files are
opened by tasks only, and the number of jobs does not depend on that of the tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourceworks.functions.names import loader_type, table_header
from sourceworks.functions.values import SOURCE_TYPE, UNTYPED
from sourceworks.session import cut_lineage, dealt, ship_package
from sourceworks.sources.dbf import BINARY_FIELDS, FIELD_TYPES, MEMO_FIELDS, RANGE_BYTES, binary_text, dbf_layout, field_text, memo_texts
from sourceworks.sources.files import open_file, written_whole
from sourceworks.sources.sheets import cell_text, sheet_cells
from sourceworks.sources.spanning import BLOCK_SIZE, ENDS, FILE_KEYS, block_ends, blocks_of, record_cells, started_blocks

RECORD = "st_oid bigint, header boolean, cells array<string>, types array<string>"
_ROWS = 20_000
_TEXTS = pa.list_(pa.string())


def files_of_tables(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """The files below ``folder`` of each manifest row, with what its reader needs.

    A row's file is the entry of the folder under its file_name, or all files below it where that is a folder.
    Columns: st_oid, path, length, loader, sub_table, delimiter, qualified, encoding.
    """
    base = folder.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "length")
    plain = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    below = F.substring_index(plain, base.split("://")[-1].removeprefix("file:") + "/", -1)
    named = listed.where("length > 0").withColumn("file_name", F.substring_index(below, "/", 1))
    wanted = manifest.select(
        "st_oid",
        "file_name",
        loader_type(F.col("file_name")).alias("loader"),
        "sub_table",
        F.coalesce(F.nullif(F.substring("delimiter", 1, 1), F.lit("")), F.lit(",")).alias("delimiter"),
        F.coalesce("qualified", F.lit(False)).alias("qualified"),
        F.coalesce("encoding", F.lit("utf8")).alias("encoding"),
    )
    return named.join(wanted, "file_name").select(
        "st_oid", "path", "length", "loader", "sub_table", "delimiter", "qualified", "encoding"
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = [pa.int64(), pa.bool_(), _TEXTS, _TEXTS]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["st_oid", "header", "cells", "types"]
    )


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= _ROWS:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _flat_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of blocks whose start is known; the header of a table comes from its first file."""

    def rows():
        for batch in batches:
            for block in batch.to_pylist():
                for at, cells in record_cells(block):
                    if at != block["header_at"]:
                        yield block["st_oid"], False, cells, None
                    elif block["heads"]:
                        names = table_header(cells)
                        yield block["st_oid"], True, names, [UNTYPED] * len(names)

    yield from _batches(rows())


def flat_source_records(files: DataFrame) -> DataFrame:
    """S1 for many files, each with its own delimiter, quoting and encoding."""
    ship_package(files.sparkSession)
    keyed = files.select("st_oid", "path", "length", "delimiter", "qualified", "encoding")
    blocks = blocks_of(keyed)
    ends = dealt(blocks, "path", "start", size=BLOCK_SIZE).mapInPandas(block_ends, f"{FILE_KEYS}, {ENDS}")
    started = started_blocks(ends, ["st_oid", "path"])
    asked = started.select("st_oid", "path", "start", "stop", "delimiter", "qualified", "encoding", "inside", "header_at", "heads")
    return dealt(asked, "path", "start", size=BLOCK_SIZE).mapInArrow(_flat_rows, RECORD)


def _dbf_ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Header rows of DBF files, as a range without records, and the ranges of their records."""
    for batch in batches:
        rows = []
        for st_oid, path in zip(batch.column("st_oid").to_pylist(), batch.column("path").to_pylist(), strict=True):
            layout = dbf_layout(path)
            step = max(1, RANGE_BYTES // max(1, layout.record_bytes))
            rows.append((st_oid, path, 0, 0))
            rows += [(st_oid, path, first, min(step, layout.records - first)) for first in range(0, layout.records, step)]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["st_oid", "path", "first", "count"]
        )


def _dbf_cells(encoding: str):
    """Raw fields of records, with the letters of their types."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked in zip(*[batch.column(c).to_pylist() for c in ("st_oid", "path", "first", "count")], strict=True):
                yield _dbf_range(*asked, encoding)

    return run


def _dbf_range(st_oid: int, path: str, first: int, count: int, encoding: str) -> pa.RecordBatch:
    layout = dbf_layout(path)
    letters = [letter for _, letter, *_ in layout.fields]
    if not count:
        columns = [pa.array([n], pa.string()) for n in table_header([name for name, *_ in layout.fields])]
        header, size = True, 1
    else:
        with open_file(path) as stream:
            stream.seek(layout.start + first * layout.record_bytes)
            block = stream.read(count * layout.record_bytes)
        whole = len(block) // layout.record_bytes
        records = np.frombuffer(block, np.uint8, whole * layout.record_bytes).reshape(whole, layout.record_bytes)
        kept = records[records[:, 0] != ord("*")]
        columns, header, size = [], False, len(kept)
        for _, letter, offset, width in layout.fields:
            raw = kept[:, offset : offset + width]
            if letter in BINARY_FIELDS:
                texts = binary_text(letter, raw)
            elif letter in MEMO_FIELDS:
                texts = memo_texts(path, layout.version, raw, encoding)
            else:
                texts = np.char.decode(np.ascontiguousarray(raw).view(f"S{width}").ravel(), encoding)
            columns.append(pa.array(texts, pa.string()))
    width = len(columns)
    flat = pa.concat_arrays(columns)
    order = np.arange(width * size).reshape(width, size).T.ravel()
    cells = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * width, pa.int32()), flat.take(pa.array(order)))
    return pa.RecordBatch.from_arrays(
        [pa.array([st_oid] * size, pa.int64()), pa.array([header] * size, pa.bool_()), cells, pa.array([letters] * size, _TEXTS)],
        names=["st_oid", "header", "cells", "letters"],
    )


def _by_letter(raw: Column, letter: Column) -> Column:
    text = F.lit("")
    for kind in FIELD_TYPES:
        text = F.when(letter == kind, field_text(kind, raw)).otherwise(text)
    return text


def dbf_source_records(files: DataFrame, encoding: str = "latin-1") -> DataFrame:
    """S5 for many files (st_oid, path); deleted records are left out."""
    ship_package(files.sparkSession)
    ranges = dealt(files.select("st_oid", "path"), "path", size="0").mapInArrow(
        _dbf_ranges, "st_oid bigint, path string, first bigint, count bigint"
    )
    raw = dealt(ranges, "path", "first", "count", size=f"{RANGE_BYTES}").mapInArrow(
        _dbf_cells(encoding), "st_oid bigint, header boolean, cells array<string>, letters array<string>"
    )
    names = F.create_map(*[F.lit(x) for pair in FIELD_TYPES.items() for x in pair])
    texts = F.when(F.col("header"), F.col("cells")).otherwise(F.zip_with("cells", "letters", _by_letter))
    types = F.when(F.col("header"), F.transform("letters", lambda x: F.element_at(names, x)))
    return raw.select("st_oid", "header", texts.alias("cells"), types.alias("types"))


def sheet_source_records(files: DataFrame) -> DataFrame:
    """S3 for many sheets; the first row of a sheet, which its task meets first, is its header."""
    decoded = sheet_cells(files.select("path", F.col("sub_table").alias("sheet"), "st_oid"))
    texts = F.zip_with("kinds", "raws", cell_text)
    untyped = F.when(F.col("header"), F.transform("names", lambda _: F.lit(UNTYPED)))
    return decoded.select(
        "st_oid", "header", F.when(F.col("header"), F.col("names")).otherwise(texts).alias("cells"), untyped.alias("types")
    )


def source_records(files: DataFrame, loaders: Iterable[str]) -> DataFrame:
    """The records of files (see ``files_of_tables``) of the named loaders, each by its reader.

    Spreadsheets need a sub table; a row without one, and a legacy workbook, fail when they are read.
    """
    readers = {"Flat": flat_source_records, "DBF": dbf_source_records, "Excel": sheet_source_records}
    parts = [readers[name](files.where(F.col("loader") == name)) for name in sorted(set(loaders) & set(readers))]
    if not parts:
        return files.sparkSession.createDataFrame([], RECORD)
    return reduce(DataFrame.unionByName, parts)


def profile_records(records: DataFrame, tables: DataFrame) -> DataFrame:
    """A1, A2 in long form: st_oid, table_name, column_index, name, type, min_length, max_length, record_count.

    One aggregate over all tables, by table, position and, for header rows, name and type. Its measures are numbers: a
    greatest text could not be hashed, so that all cells would be sorted for it. A missing value counts as the
    empty text. ``tables`` has (st_oid, table_name). What is left after the aggregate has two rows per column.
    """
    cells = records.select("st_oid", "header", "types", F.posexplode("cells").alias("column_index", "_text"))
    length = F.when(~F.col("header"), F.coalesce(F.char_length("_text"), F.lit(0)))
    name = F.when(F.col("header"), F.col("_text")).alias("name")
    kind = F.when(F.col("header"), F.get("types", F.col("column_index"))).alias("type")
    parts = cells.groupBy("st_oid", "column_index", name, kind).agg(
        F.min(length).alias("_min"), F.max(length).alias("_max"), F.count_if(~F.col("header")).alias("_seen")
    )
    measured = parts.groupBy("st_oid", "column_index").agg(
        F.max("name").alias("name"),
        F.max("type").alias("type"),
        F.min("_min").alias("_min"),
        F.max("_max").alias("_max"),
        F.sum("_seen").alias("_seen"),
    )
    first = F.when(F.col("column_index") == 0, F.col("_seen"))  # every record has a first cell
    counted = measured.withColumn("record_count", F.max(first).over(Window.partitionBy("st_oid"))).where("name is not null")
    shortest = F.when(F.col("_seen") < F.col("record_count"), 0).otherwise(F.col("_min"))
    return counted.join(tables.select("st_oid", "table_name"), "st_oid").select(
        "st_oid",
        "table_name",
        "column_index",
        "name",
        "type",
        F.when(F.col("record_count") > 0, shortest).cast("int").alias("min_length"),
        F.when(F.col("record_count") > 0, F.coalesce("_max", F.lit(0))).cast("int").alias("max_length"),
        "record_count",
    )


def table_of_records(records: DataFrame) -> DataFrame:
    """The records of files with one and the same header as text columns named by it; files with different headers are refused."""
    written = cut_lineage(records)
    headers = written.where("header").select("cells", "types").distinct().limit(2).collect()
    if len(headers) > 1:
        raise ValueError(f"files have different headers, among them {headers[0].cells} and {headers[1].cells}")
    columns = list(zip(headers[0].cells, headers[0].types, strict=True)) if headers else []
    return written.where("not header").select(
        *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n, metadata={SOURCE_TYPE: t}) for i, (n, t) in enumerate(columns)]
    )


def _table_writer(headers: dict[int, list[str]], folders: dict[int, str]):
    """Write the rows of each table that a task holds, which follow each other, to one file of the table's folder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        part = TaskContext.get().partitionId()
        rows = (
            (st_oid, header, cells)
            for batch in batches
            for st_oid, header, cells in zip(*[batch.column(c).to_pylist() for c in ("st_oid", "header", "cells")], strict=True)
        )
        for st_oid, own in groupby(rows, key=lambda r: r[0]):
            names, count = headers[st_oid], 0
            schema = pa.schema([(n, pa.string()) for n in names])
            file = f"{folders[st_oid]}/part-{part:05d}.parquet"
            with written_whole(file) as out, pq.ParquetWriter(out, schema, compression="zstd") as writer:
                while some := list(islice(own, _ROWS)):
                    texts = [cells for _, header, cells in some if not header]
                    columns = [pa.array([(c[k] if k < len(c) else None) or "" for c in texts], pa.string()) for k in range(len(names))]
                    writer.write_table(pa.Table.from_arrays(columns, schema=schema))
                    count += len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([st_oid], pa.int64()), pa.array([file]), pa.array([count], pa.int64())], names=["st_oid", "file", "rows"]
            )

    return run


def write_records(records: DataFrame, headers: dict[int, list[str]], folders: dict[int, str]) -> DataFrame:
    """S16 for many tables in one job: (st_oid, file, rows) of the Parquet files written to the folder of each table.

    A task writes one file for each table it has rows of, whole or not at all and under the same name when it is tried
    again. Rows of a table stay in as many tasks as they were read by. A table without records gets a file without rows.
    """
    ship_package(records.sparkSession)
    placed = records.select("st_oid", "header", "cells", F.spark_partition_id().alias("_from"))
    sorted_ = placed.repartition("st_oid", "_from").sortWithinPartitions("st_oid").select("st_oid", "header", "cells")
    return cut_lineage(sorted_.mapInArrow(_table_writer(headers, folders), "st_oid bigint, file string, rows bigint"))
