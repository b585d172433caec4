import datetime as dt
import re
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourceworks.functions import names as N
from sourceworks.functions import values as V
from sourceworks.operators.changes import merged_map, without_item


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, name",
    [
        (" Tank #  no. ", "TANK_NUM_NO"),
        ("1st Date", "_1ST_DATE"),
        ("Prénom", "PRNOM"),
        ("a" * 80, "A" * 60),
        ("a\tb\n c", "A_B_C"),
        ("straße", "STRASSE"),
    ],
)
def test_column_name(spark, raw, name):
    assert one(spark, N.column_name(F.lit(raw))) == name
    assert N.header_name(raw, 0) == name


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=90))
def test_header_name_is_valid_and_stable(raw):
    name = N.header_name(raw, 7)
    assert re.fullmatch(r"[A-Z0-9_]{1,60}", name)
    assert N.header_name(name, 7) == name


def test_header_name_without_letters():
    assert N.table_header(["***", None, "x"]) == ["COLUMN_0", "COLUMN_1", "X"]


def test_repeats_count_down():
    assert N.number_repeats(["A", "B", "A"]) == ["A_2", "B", "A_1"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["A", "B", "C"]), max_size=12))
def test_repeats_become_unique(header):
    assert len(set(N.number_repeats(header))) == len(header)


def test_colliding_suffix_is_refused():
    with pytest.raises(ValueError, match="A_1"):
        N.table_header(["A", "A_1", "A"])


def test_loader(spark):
    assert [N.loader_of(n) for n in ("a.csv", "a.b.XLSX", "x.dbf", "y.accdb")] == ["Flat", "Excel", "DBF", "MDB"]
    for bad in ("noext", "a.pdf", "a."):
        with pytest.raises(ValueError):
            N.loader_of(bad)
    assert one(spark, N.loader_type(F.lit("a.pdf"))) is None
    assert one(spark, N.loader_type(F.lit("a.TXT"))) == "Flat"


def test_locations(spark):
    date = F.lit(dt.date(2021, 3, 4))
    assert one(spark, N.run_files_location(F.lit("/data"), date)) == "/data/2021-03-04/files"
    assert one(spark, N.run_zip_location(F.lit("/data"), date)) == "/data/2021-03-04/zip"
    assert one(spark, N.backup_name(F.lit("DS1"), date)) == "DS1_2021-03-04"


def test_small_name_functions(spark):
    assert one(spark, N.snake_case(F.lit("PipelineRunTasks"))) == "pipeline_run_tasks"
    assert one(spark, N.display_label(F.lit("record_count of_mDB"))) == "Record Count Of MDB"
    assert one(spark, N.id_number(F.lit("F12x7"))) == 12
    assert one(spark, N.id_number(F.lit("none"))) is None
    assert one(spark, N.file_id(F.lit(12))) == "F12"
    assert one(spark, N.url_file_name(F.lit("https://h/a/b.zip"))) == "b.zip"
    assert one(spark, N.delimiter_char(F.lit(None).cast("string"))) == ","
    assert one(spark, N.delimiter_char(F.lit("|x"))) == "|"
    assert N.delimiter_of(None) == "," and N.delimiter_of("\t") == "\t"


def text(spark, value, kind):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(V.as_text(F.col("v"), df.schema[0].dataType)).first()[0]


@pytest.mark.parametrize(
    "value, kind, expected",
    [
        (None, "string", ""),
        (None, "boolean", ""),
        (True, "boolean", "TRUE"),
        (False, "boolean", "FALSE"),
        (Decimal("1.50"), "decimal(10,2)", "1.50"),
        (Decimal("0.0000001"), "decimal(20,10)", "0.0000001000"),
        (dt.date(2021, 3, 4), "date", "2021-03-04"),
        (dt.datetime(2021, 3, 4, 5, 6), "timestamp_ntz", "2021-03-04T05:06:00"),
        (dt.datetime(2021, 3, 4, 5, 6, 7, 120000), "timestamp_ntz", "2021-03-04T05:06:07.12"),
        (bytearray(b"caf\xc3\xa9"), "binary", "café"),
        (bytearray(b"a\xffb"), "binary", "a�b"),
        (12, "bigint", "12"),
        (1.5, "double", "1.5"),
    ],
)
def test_as_text(spark, value, kind, expected):
    assert text(spark, value, kind) == expected


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_text_length_is_the_length_of_the_text(spark, kind):
    stamps = ["2021-03-04 05:06:07", "1950-01-01 00:00:00.1", "2021-03-04 05:06:07.12", "2021-03-04 05:06:07.000001",
              "0001-01-01 00:00:00", "0950-06-07 01:02:03.123", "2021-03-04 05:06:07.12345", "9999-12-31 23:59:59.9999", None]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast(kind).alias("v"))
    kind_type = df.schema[0].dataType
    got = df.select(V.text_length(F.col("v"), kind_type), F.length(V.as_text(F.col("v"), kind_type))).collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_zoned_timestamp_is_shown_in_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stamp = F.timestamp_micros(F.lit(1636263000000000))  # inside the repeated hour of that zone
        df = spark.range(1).select(stamp.alias("v"))
        assert df.select(V.as_text(F.col("v"), df.schema[0].dataType)).first()[0] == "2021-11-07T05:30:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_blank_checks(spark):
    data = spark.createDataFrame([(None,), ("",), (" \t",), ("a ",)], "v string")
    assert [r[0] for r in data.select(V.not_blank(F.col("v"))).collect()] == [True, False, False, True]
    assert [r[0] for r in data.select(V.blank_to_null(F.col("v"))).collect()] == [None, None, None, "a "]
    arrays = spark.createDataFrame([([],), (["a", None],), (["a", " "],), (None,)], "v array<string>")
    assert [r[0] for r in arrays.select(V.array_not_blank(F.col("v"))).collect()] == [False, True, False, True]


def test_count_map(spark):
    data = spark.createDataFrame([('{"a":1,"b":2}',), ('{"a":"x"}',), ('{"a":null}',), ("nope",), (None,)], "v string")
    assert [r[0] for r in data.select(V.count_map(F.col("v"))).collect()] == [{"a": 1, "b": 2}, None, None, None, None]


def test_csv_record(spark):
    assert one(spark, V.csv_record([F.lit('a"b'), F.lit("")])) == '"a""b",""'


def test_map_union_and_list_difference(spark):
    left, right = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))
    assert one(spark, merged_map(left, right)) == {"a": 1, "b": 3}
    assert one(spark, without_item(F.array(F.lit("admin"), F.lit("qa")), "admin")) == ["qa"]
