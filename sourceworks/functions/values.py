"""Expressions over values: text rendering, blank checks, JSON maps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE_TYPE = "source_type"
UNTYPED = "VARCHAR"

# Type labels of typed sources, by Spark type.
TYPE_LABELS = {
    "boolean": "BOOLEAN",
    "tinyint": "TINYINT",
    "smallint": "SMALLINT",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "float": "REAL",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "binary": "VARBINARY",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def type_label(data_type: T.DataType) -> str:
    """Label of a declared source type; '' when there is no name for it."""
    if isinstance(data_type, T.DecimalType):
        return "DECIMAL"
    return TYPE_LABELS.get(data_type.simpleString(), "")


def _iso_local(stamp: Column) -> Column:
    # The cast already writes ISO fields without trailing zeros; only the separator differs.
    return F.translate(stamp.cast("string"), " ", "T")


def utc_wall_clock(stamp: Column) -> Column:
    """A zoned timestamp as its wall-clock time in UTC."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(stamp), epoch)


def as_text(value: Column, data_type: T.DataType) -> Column:
    """a typed value as text; null is the empty text."""
    if isinstance(data_type, T.StringType):
        text = value
    elif isinstance(data_type, T.BooleanType):
        text = F.when(value, "TRUE").when(~value, "FALSE")
    elif isinstance(data_type, T.BinaryType):
        text = F.make_valid_utf8(value.cast("string"))
    elif isinstance(data_type, T.TimestampType):
        text = F.concat(_iso_local(utc_wall_clock(value)), F.lit("Z"))
    elif isinstance(data_type, T.TimestampNTZType):
        text = _iso_local(value)
    elif isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def text_length(value: Column, data_type: T.DataType) -> Column:
    """Length of ``as_text``, without rendering values whose text has a known shape."""
    rendered = F.length(as_text(value, data_type))
    if isinstance(data_type, T.BooleanType):
        return F.when(value, 4).when(~value, 5).otherwise(0)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        # Seconds end at 19 characters; each digit of the fraction before its trailing zeros adds one.
        fraction = F.unix_micros(value.cast("timestamp")) % 1_000_000
        length = F.when(fraction == 0, 19)
        for digits in range(1, 6):
            length = length.when(fraction % 10 ** (6 - digits) == 0, 20 + digits)
        length = length.otherwise(26)
        if isinstance(data_type, T.TimestampType):
            length = length + 1
        four_digit_year = (value >= F.lit("0001-01-02").cast(data_type)) & (value < F.lit("9999-12-31").cast(data_type))
        return F.when(value.isNull(), 0).when(four_digit_year, length).otherwise(rendered)
    return rendered


def table_as_text(df: DataFrame) -> DataFrame:
    """All columns as text (F2); the declared type stays as field metadata."""
    return df.select(
        *[
            as_text(F.col(f"`{field.name}`"), field.dataType).alias(
                field.name,
                metadata={SOURCE_TYPE: field.metadata.get(SOURCE_TYPE) or type_label(field.dataType)},
            )
            for field in df.schema.fields
        ]
    )


def not_blank(text: Column) -> Column:
    """true for null or text with something besides white space."""
    return ~F.coalesce(text, F.lit("x")).rlike(r"^\s*$")


def array_not_blank(items: Column) -> Column:
    """true when there are items and none of them is blank; null passes."""
    clean = ~F.exists(items, lambda item: F.coalesce(item, F.lit("x")).rlike(r"^\s*$"))
    return F.coalesce((F.size(items) > 0) & clean, F.lit(True))


def iso_date(date: Column) -> Column:
    """ISO local date."""
    return F.date_format(date, "yyyy-MM-dd")


def iso_datetime(stamp: Column) -> Column:
    """F8: ISO local date and time in the session's zone, '' for null."""
    return F.coalesce(_iso_local(stamp), F.lit(""))


def joined(items: Column) -> Column:
    """array items as one text."""
    return F.array_join(items, ", ")


def blank_to_null(text: Column) -> Column:
    """blank text becomes null."""
    return F.when(~text.rlike(r"^\s*$"), text)


def count_map(json_text: Column) -> Column:
    """F16: JSON text as map(label -> count); null when any part is not a count."""
    parsed = F.from_json(json_text, "map<string,int>")
    return F.when(~F.exists(F.map_values(parsed), lambda n: n.isNull()), parsed)


def is_count_map(json_text: Column) -> Column:
    """F16: whether the text decodes to label counts."""
    return count_map(json_text).isNotNull()


def member_of(value: Column, allowed: Iterable[str]) -> Column:
    """enumeration membership."""
    return value.isin(list(allowed))


def csv_record(columns: Iterable[Column]) -> Column:
    """One CSV record with every value quoted and quotes doubled."""
    quoted = [
        F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
        for c in columns
    ]
    return F.concat_ws(",", *quoted)
