"""Delimited text files as all-text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceworks.functions.names import table_header
from sourceworks.functions.values import SOURCE_TYPE, UNTYPED
from sourceworks.sources.spanning import file_cells, file_shapes, files_at, first_record, rule_of, wide_characters

UNREADABLE = "_unreadable"
# With a marker that no file contains, "" stays the empty text and a bare empty field is null.
_NO_NULL_MARKER = "\u0002"
# Names of encodings that Spark knows under another name.
ENCODINGS = {"utf8": "UTF-8", "latin1": "ISO-8859-1", "ascii": "US-ASCII", "utf16": "UTF-16"}
MAX_COLUMNS = 100_000


def _options(delimiter: str, qualified: bool, encoding: str) -> dict:
    quote = '"' if qualified else ""
    return {
        "sep": delimiter,
        "quote": quote,
        "escape": quote,
        "encoding": ENCODINGS.get(encoding.lower().replace("-", ""), encoding),
        "nullValue": _NO_NULL_MARKER,
        "emptyValue": "",
        "mode": "PERMISSIVE",
    }


def _first_file(spark: SparkSession, path: str) -> str:
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    found = files.agg(F.min("path")).first()[0]
    if found is None:
        raise ValueError(f"{path} has no header record")
    return found


def flat_header(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    qualified: bool = True,
    encoding: str = "UTF-8",
    max_columns: int = MAX_COLUMNS,
) -> list[str]:
    """Normalized column names from the first record (of the first file); only its beginning is read."""
    record = first_record(_first_file(spark, path), delimiter, qualified, _options(delimiter, qualified, encoding)["encoding"])
    if record is None:
        raise ValueError(f"{path} has no header record")
    if record.count(delimiter) >= max_columns:
        raise ValueError(f"the header of {path} may have more than {max_columns} columns: raise max_columns")
    return table_header(rule_of(delimiter, qualified).cells(record))


def read_flat(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    qualified: bool = True,
    encoding: str = "UTF-8",
    keep_unreadable: bool = False,
    max_columns: int = MAX_COLUMNS,
) -> DataFrame:
    """A flat file as text columns; the first record of each file is its header.

    Records are found by one rule for files of any size (see ``spanning``). A first pass over their bytes
    tells whether Spark's CSV reader follows that rule for these files: line by line where no record goes
    over lines, so that files are split and only wanted columns parsed; or file by file, where each
    is no larger than a block. Else tasks cut the records and fields of a block by the rule.
    ``keep_unreadable`` adds a column with the source text of records that are too
    short or too long. A file wider than ``max_columns`` is refused.
    """
    names = flat_header(spark, path, delimiter, qualified, encoding, max_columns)
    options = _options(delimiter, qualified, encoding) | {"maxColumns": max_columns + 1}
    if keep_unreadable:
        options["columnNameOfCorruptRecord"] = UNREADABLE
    fields = [T.StructField(n, T.StringType(), True, {SOURCE_TYPE: UNTYPED}) for n in names]
    read = fields + ([T.StructField(UNREADABLE, T.StringType())] if keep_unreadable else [])
    shapes = file_shapes(files_at(spark, path, delimiter, qualified, options["encoding"]))
    native = not wide_characters(options["encoding"])
    if native and (shapes.by_line or (shapes.whole and not keep_unreadable)):
        reader = spark.read.schema(T.StructType(read)).options(**options, header=True, enforceSchema=True)
        reader = reader.option("columnPruning", not keep_unreadable)  # a record's width shows in all its columns
        rows = reader.option("multiLine", not shapes.by_line).csv(path)
        if not keep_unreadable:
            return rows
        # Spark reads the text of bad records only together with another column
        beside = F.substring(F.coalesce(F.col(f"`{names[0]}`"), F.lit("")), 1, 0)
        return rows.withColumn(UNREADABLE, F.concat(UNREADABLE, beside))
    records = file_cells(shapes, len(names))
    columns = [F.get("cells", F.lit(i)).alias(f.name, metadata=f.metadata) for i, f in enumerate(fields)]
    return records.select(*columns, *([F.col("ragged").alias(UNREADABLE)] if keep_unreadable else []))


def split_unreadable(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q8/Q9: good records, and the source text of records of the wrong width."""
    good = checked.where(F.col(UNREADABLE).isNull()).drop(UNREADABLE)
    bad = checked.where(F.col(UNREADABLE).isNotNull()).select(F.col(UNREADABLE).alias("record"))
    return good, bad


def write_flat(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """CSV files with a header, every value quoted and quotes doubled."""
    text = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    text.write.mode("overwrite").options(
        header=True, sep=delimiter, quote='"', escape='"', quoteAll=True, emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
