import io
import random
import re
import struct
import zipfile
from types import SimpleNamespace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourceworks.functions.values import SOURCE_TYPE
from sourceworks.operators.profile import profile
from sourceworks.plans import fetch, intake
from sourceworks.schemas import catalog_schema
from sourceworks.sources import archives, database, dbf, dispatch, features, files, flat, records, sheets, spanning, tables


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def values(df):
    return [tuple(r) for r in df.collect()]


def test_flat_header_quotes_nulls_and_line_ends(spark, tmp_path):
    path = write(tmp_path / "plain.csv", 'Id #,My  Name,1st,My  Name\n1,"say ""hi""",,"two\nlines"\n2,"",b,c\n')
    df = flat.read_flat(spark, path)
    assert df.columns == ["ID_NUM", "MY_NAME_2", "_1ST", "MY_NAME_1"]
    assert sorted(values(df)) == [("1", 'say "hi"', None, "two\nlines"), ("2", "", "b", "c")]


def test_flat_without_quoting(spark, tmp_path):
    path = write(tmp_path / "u.tsv", 'a\tb\n5" x\t"y\n')
    assert values(flat.read_flat(spark, path, delimiter="\t", qualified=False)) == [('5" x', '"y')]


def test_flat_encoding(spark, tmp_path):
    path = write(tmp_path / "latin1.csv", "name\ncafé\n", "latin-1")
    assert values(flat.read_flat(spark, path, encoding="latin1")) == [("café",)]


def test_header_only_file(spark, tmp_path):
    df = flat.read_flat(spark, write(tmp_path / "h.csv", "a,b\n"))
    assert [(r.record_count, r.min_length) for r in profile(df, "t").collect()] == [(0, None), (0, None)]


def test_empty_file_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="header"):
        flat.flat_header(spark, write(tmp_path / "e.csv", ""))


def test_records_of_the_wrong_width(spark, tmp_path):
    path = write(tmp_path / "ragged.txt", "a\tb\tc\n1\t2\t3\n1\t2\n\n1\t2\t3\t4\n")
    good, bad = flat.split_unreadable(flat.read_flat(spark, path, delimiter="\t", keep_unreadable=True))
    assert values(good) == [("1", "2", "3")]
    assert sorted(values(bad)) == [("1\t2",), ("1\t2\t3\t4",)]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text('ab",\n ', max_size=6), st.text('x";', max_size=4)), min_size=1, max_size=8))
def test_written_records_come_back(spark, tmp_path_factory, data):
    path = str(tmp_path_factory.mktemp("round") / "t")
    flat.write_flat(spark.createDataFrame(data, "a string, b string").coalesce(1), path)
    assert sorted(values(flat.read_flat(spark, path))) == sorted(data)


@pytest.fixture
def blocks(spark):
    def of(size):
        spark.conf.set("spark.sourceworks.flatBlockBytes", size)

    yield of
    spark.conf.unset("spark.sourceworks.flatBlockBytes")


@pytest.mark.parametrize("block", [1, 5, 16, 1_000_000])
@pytest.mark.parametrize(
    "body, records",
    [
        ('"x\ry",1\n', [("x\ry", "1")]),
        ('"x\r\ny",1\r\n', [("x\r\ny", "1")]),
        ("   \n1,2\n", [("   ", None), ("1", "2")]),
        ('"x"y,1\n"p\nq",2\n', [('"x"y', "1"), ("p\nq", "2")]),
        ("1,2\r3,4\r", [("1", "2"), ("3", "4")]),
        ('1,2\n\n\r\n3,"4"', [("1", "2"), ("3", "4")]),
        ('5" pipe,"say ""hi"""\n', [('5" pipe', 'say "hi"')]),
        ('"","\n\n"\n,é\n', [("", "\n\n"), (None, "é")]),
    ],
)
def test_one_record_rule_for_all_blocks(spark, tmp_path, blocks, block, body, records):
    blocks(block)
    for mark in ("", "\ufeff"):
        path = write(tmp_path / f"f{len(mark)}.csv", f"{mark}a,b\n{body}")
        df = flat.read_flat(spark, path)
        assert df.columns == ["A", "B"] and sorted(values(df), key=repr) == sorted(records, key=repr)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text('ab",\n\r é', max_size=12), min_size=1, max_size=12), st.integers(1, 30))
def test_records_do_not_depend_on_blocks(spark, tmp_path_factory, blocks, lines, block):
    """Any text gives the same rows, or the same error, in one block and in many."""
    path = write(tmp_path_factory.mktemp("any") / "f.csv", "h1,h2\n" + "\n".join(lines))

    def read(size):
        blocks(size)
        try:
            return sorted(values(flat.read_flat(spark, path)), key=repr)
        except Exception as error:
            assert "never closed" in str(error)
            return "open"

    assert read(block) == read(1_000_000)


@pytest.mark.parametrize("block", [7, 40])
def test_written_values_come_back_from_any_blocks(spark, tmp_path, blocks, block):
    pick = random.Random(block)
    parts = ["a", '"', "\n", "\r", ",", "\r\n", '""', "é", " "]
    data = [("".join(pick.choices(parts, k=pick.randint(0, 6))), str(k)) for k in range(60)]
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    for name, rows_ in (("one.csv", data[:25]), ("two.csv", data[25:])):
        write(tmp_path / name, '\n\n"h\n1",h2\n' + "".join(f"{quote(a)},{b}\n" for a, b in rows_))
    blocks(block)
    got = flat.read_flat(spark, str(tmp_path))
    assert got.columns == ["H_1", "H2"] and sorted(values(got)) == sorted(data)


@pytest.mark.parametrize("block", [3, 1_000_000])
def test_field_that_never_closes_is_refused(spark, tmp_path, blocks, block):
    blocks(block)
    path = write(tmp_path / "open.csv", 'a,b\n1,"x\n2,y\n')
    with pytest.raises(Exception, match="never closed"):
        flat.read_flat(spark, path).collect()


def test_wide_files_need_a_larger_limit(spark, tmp_path):
    path = write(tmp_path / "wide.csv", ",".join(f"c{i}" for i in range(30)) + "\n")
    with pytest.raises(ValueError, match="max_columns"):
        flat.flat_header(spark, path, max_columns=20)
    assert len(flat.flat_header(spark, path)) == 30


@pytest.mark.parametrize("encoding", ["utf-16", "latin1"])
def test_other_encodings(spark, tmp_path, encoding):
    path = write(tmp_path / "e.csv", 'näme,b\n"x\ny",é\n', encoding)
    df = flat.read_flat(spark, path, encoding=encoding)
    assert df.columns == ["NME", "B"] and values(df) == [("x\ny", "é")]


@pytest.mark.parametrize("block", [4, 1_000_000])
def test_unreadable_records_among_spanning_ones(spark, tmp_path, blocks, block):
    blocks(block)
    path = write(tmp_path / "r.csv", 'a,b\n1,"x\ny"\n2\n3,"p\nq",more\n')
    good, bad = flat.split_unreadable(flat.read_flat(spark, path, keep_unreadable=True))
    assert values(good) == [("1", "x\ny")]
    assert sorted(values(bad)) == [("2",), ('3,"p\nq",more',)]


def test_workbook_cells(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    sheet = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>when</t></is></c>'
        '<c r="C1" t="inlineStr"><is><t>ok</t></is></c><c r="D1" t="inlineStr"><is><t>note</t></is></c></row>'
        '<row r="3"><c r="A3"><v>12</v></c><c r="B3" s="1"><v>44259.75</v></c><c r="C3" t="b"><v>1</v></c>'
        '<c r="D3" t="inlineStr"><is><r><t xml:space="preserve"> rich </t></r><r><t>text </t></r></is></c>'
        '<c r="F3"><v>9</v></c></row>'
        '<row r="4"><c r="A4"><v>1.5</v></c><c r="B4" s="2"><v>60</v></c><c r="D4" t="e"><v>#N/A</v></c></row>'
        '<row r="5"><c r="A5"><v>1E3</v></c><c r="B5" s="3"><v>2.5</v></c><c r="C5" t="b"><v>0</v></c></row>'
    )
    path = tmp_path / "book.xlsx"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Sites" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Tank #</t></si></sst>")
        book.writestr(
            "xl/styles.xml",
            f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00&quot;d&quot;"/></numFmts>'
            '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
        )
        book.writestr("xl/worksheets/s.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")
    df = sheets.read_sheet(spark, str(path), "Sites")
    assert df.columns == ["TANK_NUM", "WHEN", "OK", "NOTE"]
    assert values(df) == [
        ("12", "2021-03-04", "TRUE", "rich text"), ("1.5", "1900-03-01", "", "#N/A"), ("1000", "2.5", "FALSE", ""),
    ]
    with pytest.raises(Exception, match="no sheet named"):
        sheets.read_sheet(spark, str(path), "Tanks")


def dbf_bytes(fields, records):
    width = 1 + sum(size for *_, size in fields)
    head = struct.pack("<B3BIHH20x", 3, 24, 1, 1, len(records), 33 + 32 * len(fields), width)
    for name, letter, size in fields:
        head += struct.pack("<11sc4xBB14x", name.encode(), letter.encode(), size, 0)
    return head + b"\r" + "".join(records).encode("latin-1") + b"\x1a"


def test_dbf(spark, tmp_path):
    path = tmp_path / "points.dbf"
    fields = [("site name", "C", 5), ("AMOUNT", "N", 6), ("DAY", "D", 8), ("OK", "L", 1)]
    records = [(" ", "café", "1.50", "20210304", "T"), ("*", "gone", "0", "", "F"), (" ", "", "-.5", "", "?"), (" ", "x", "00070", "", "f")]
    path.write_bytes(dbf_bytes(fields, [f"{mark}{c:<5}{n:>6}{d:<8}{ok}" for mark, c, n, d, ok in records]))
    df = dbf.read_dbf(spark, str(path), range_bytes=30)
    assert df.columns == ["SITE_NAME", "AMOUNT", "DAY", "OK"]
    assert [f.metadata[SOURCE_TYPE] for f in df.schema] == ["CHARACTER", "NUMERIC", "DATE", "LOGICAL"]
    assert sorted(values(df)) == [("", "-0.5", "", ""), ("café", "1.50", "2021-03-04T00:00:00Z", "TRUE"), ("x", "70", "", "FALSE")]


def test_typed_sub_table(spark):
    df = database.typed_as_source(spark.sql("select 1 as `Id #`, true as ok, cast(1.50 as decimal(5,2)) as amount, 'a\"b' as note"))
    assert df.columns == ["ID_NUM", "OK", "AMOUNT", "NOTE"]
    assert [f.metadata[SOURCE_TYPE] for f in df.schema] == ["INTEGER", "BOOLEAN", "DECIMAL", "VARCHAR"]
    assert values(df) == [("1", "TRUE", "1.50", 'a"b')]


def test_range_predicates():
    assert database.range_predicates("ID", 5, 27, 10) == ["ID >= 5 AND ID <= 14", "ID >= 15 AND ID <= 24", "ID >= 25 AND ID <= 34"]
    with pytest.raises(ValueError, match="positive"):
        database.range_predicates("ID", 1, 2, 0)


def test_feature_pages(spark, tmp_path):
    bodies = {
        "ok.json": '{"features":[{"attributes":{"OID":1,"NAME":null,"X":"old"},"geometry":{"x":1.25,"y":2}},{"attributes":{"OID":2}}]}',
        "err.json": '{"error":{"code":500}}',
        "none.json": '{"count":3}',
    }
    for name, body in bodies.items():
        write(tmp_path / name, body)
    pages = features.read_pages(spark, str(tmp_path))
    outcomes = {r.path.rsplit("/", 1)[1]: r.outcome for r in features.checked_pages(pages).collect()}
    assert outcomes == {"ok.json": "ok", "err.json": "retry", "none.json": "fatal"}
    found = features.feature_rows(pages, ["OID", "NAME", "X", "Y"], features.POINT)
    assert sorted(values(found)) == [("1", None, "1.25", "2"), ("2", None, None, None)]


def test_service_metadata(spark):
    body = """{"type":"Feature Layer","name":"Wells","maxRecordCount":500,"supportsPagination":true,
               "advancedQueryCapabilities":{"supportsStatistics":true},"geometryType":"esriGeometryPoint",
               "fields":[{"name":"OBJECTID","type":"esriFieldTypeOID"},{"name":"Shape","type":"x"},
                         {"name":"G","type":"esriFieldTypeGeometry"},{"name":"A","type":"esriFieldTypeString"}]}"""
    row = features.service_metadata(spark.createDataFrame([("u", body, 7)], "url string, body string, count bigint")).first()
    assert (row.pagination, row.stats, row.fields, row.oid_field) == (False, True, ["OBJECTID", "A", "X", "Y"], "OBJECTID")
    bare = features.service_metadata(spark.createDataFrame([("u", "{}", None)], "url string, body string, count bigint")).first()
    assert (bare.source_count, bare.max_record_count, bare.fields) == (-1, -1, [])


def services(spark, **over):
    base = dict(url="u", source_count=25, max_record_count=10, pagination=True, oid_field="", min_key=-1, max_key=-1,
                server_type="TABLE", geometry_type="")
    row = {**base, **over}
    return spark.createDataFrame(
        [tuple(row.values())],
        "url string, source_count bigint, max_record_count int, pagination boolean, oid_field string, min_key bigint, max_key bigint, server_type string, geometry_type string",
    )


def test_page_plan(spark):
    assert sorted(r.offset for r in fetch.page_plan(services(spark)).collect()) == [0, 10, 20]
    assert fetch.page_plan(services(spark, max_record_count=-1)).count() == 0
    assert [r.page_rows for r in fetch.page_plan(services(spark, max_record_count=20000)).collect()] == [10000]


def test_range_plan(spark):
    ranged = services(spark, pagination=False, oid_field="OID", min_key=5, max_key=27)
    assert sorted((r.low, r.high) for r in fetch.range_plan(ranged).collect()) == [(5, 14), (15, 24), (25, 34)]
    assert fetch.range_plan(services(spark, pagination=False)).count() == 0


def test_fetch_query_text(spark):
    layer = services(spark, source_count=1, server_type="Layer", geometry_type="esriGeometryPoint")
    assert fetch.fetch_queries(layer).first().query == (
        "u/query?where=1+%3D+1&resultOffset=0&resultRecordCount=10&geometryType=esriGeometryPoint&outSR=4269&outFields=*&f=json"
    )


def test_dbf_binary_and_memo_fields(spark, tmp_path):
    fields = [("ID", "I", 4), ("AUTO", "+", 4), ("RATE", "B", 8), ("COST", "Y", 8), ("AT", "T", 8), ("NOTE", "M", 4)]
    header = b"".join(n.encode().ljust(11, b"\0") + t.encode() + bytes(4) + bytes([w]) + bytes(15) for n, t, w in fields) + b"\r"
    rows_ = [(7, 1, 2.5, -12_345, (2_440_588, 1_000), b"    "), (-7, 2, 0.1, 5, (0, 0), b"0001")]
    body = b"".join(b" " + struct.pack("<iidq", a, b, c, d) + struct.pack("<ii", *e) + f for a, b, c, d, e, f in rows_)
    width = 1 + sum(w for *_, w in fields)
    lead = struct.pack("<4BIHH20x", 3, 121, 1, 1, len(rows_), 32 + len(header), width)
    (tmp_path / "b.dbf").write_bytes(lead + header + body)
    df = dbf.read_dbf(spark, str(tmp_path / "b.dbf"))
    assert values(df) == [("7", "1", "2.5", "-1.2345", "1970-01-01T00:00:01Z", ""), ("-7", "2", "0.1", "0.0005", "", "")]
    assert [f.metadata[SOURCE_TYPE] for f in df.schema.fields][-1] == "MEMO"


def test_archives_listing_and_backup(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "bundle.zip", "w") as bundle:
        bundle.writestr("a.csv", "x\n1\n")
        bundle.writestr("deep/b c.csv", b"\xff\x00\x01" * 5)
    target = tmp_path / "out"
    written = archives.expand_archives(files.list_files(spark, str(tmp_path), "*.zip"), str(target))
    assert sorted((r.entry, r.length) for r in written.collect()) == [("a.csv", 4), ("deep/b c.csv", 15)]
    assert (target / "bundle.zip" / "deep" / "b c.csv").read_bytes() == b"\xff\x00\x01" * 5
    listing = files.list_files(spark, str(target))
    assert sorted((r.file_name, r.length, r.loader_type) for r in listing.collect()) == [("a.csv", 4, "Flat"), ("b c.csv", 15, "Flat")]
    kept = files.backup_files(spark, str(target), str(tmp_path / "backup"))
    assert sorted(values(kept)) == sorted(values(files.backup_manifest(spark, str(target))))
    assert {r.file_name for r in kept.collect()} == {"bundle.zip/a.csv", "bundle.zip/deep/b c.csv"}
    assert (tmp_path / "backup/files/bundle.zip/deep/b c.csv").read_bytes() == b"\xff\x00\x01" * 5


def test_equal_entry_names_stay_apart(spark, tmp_path):
    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as bundle:
            bundle.writestr("data.csv", f"x\n{name}\n")
    written = archives.expand_archives(files.list_files(spark, str(tmp_path), "*.zip"), str(tmp_path / "out"))
    assert len({r.file for r in written.collect()}) == 2
    assert sorted(r.X for r in flat.read_flat(spark, str(tmp_path / "out/*/data.csv")).collect()) == ["a", "b"]


def test_archive_entry_outside_the_target_is_refused(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "evil.zip", "w") as bundle:
        bundle.writestr("../evil.csv", "x")
    with pytest.raises(Exception, match="outside the target"):
        archives.expand_archives(files.list_files(spark, str(tmp_path), "*.zip"), str(tmp_path / "out")).collect()


def test_text_table_sink_replaces(spark):
    tables.write_text_table(spark.range(3), "SinkTest")
    tables.write_text_table(spark.sql("select true as ok, null as note"), "SinkTest")
    assert tables.table_exists(spark, "SINKTEST") and tables.column_list(spark, "SinkTest") == ["ok", "note"]
    assert values(spark.table("sinktest")) == [("TRUE", "")]
    with pytest.raises(ValueError):
        tables.column_list(spark, "no_such_table")


def test_seed_ids_go_on(spark, tmp_path):
    seed = tables.read_seed(spark, write(tmp_path / "actions.csv", '"state","role","name","description","href"\n"*","qa","B","say ""x""","/b"\n"*","qa","A","d","/a"\n'))
    target = spark.createDataFrame([(4, "*", "qa", "old", "d", "/o")], catalog_schema("actions"))
    got = tables.append_seed(target, seed, "action_id", ["name"])
    assert sorted((r.action_id, r.name, r.description) for r in got.collect()) == [(4, "old", "d"), (5, "A", "d"), (6, "B", 'say "x"')]


def test_query_parameters_stay_values(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    got = tables.run_query(spark, "select id from numbers where id in (:ids) and :t <> ''", {"ids": [1, 3, 9], "t": "x' or 1=1"})
    assert sorted(r.id for r in got.collect()) == [1, 3]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan
    assert tables.run_query(spark, "select id from numbers where id in (:ids)", {"ids": []}).count() == 0
    quoted = tables.run_query(spark, "select ':ids' as t, id from numbers where id in (:ids)", {"ids": [2]}).first()
    assert (quoted.t, quoted.id) == (":ids", 2)


@pytest.mark.parametrize("name, sub, why", [("a.pdf", None, "not supported"), ("a.xlsx", " ", "null sub table"), ("a.xls", "S", "legacy"), ("a.mdb", "S", "JDBC")])
def test_dispatch_refusals(spark, name, sub, why):
    entry = SimpleNamespace(file_name=name, sub_table=sub, delimiter=None, qualified=True, encoding="utf8")
    with pytest.raises(ValueError, match=why):
        dispatch.read_source(spark, "/nowhere", entry)


def test_whole_run(spark, tmp_path):
    """Scan, profile and load a run with a flat file and a DBF file."""
    folder, target = tmp_path / "files", tmp_path / "warehouse"
    folder.mkdir()
    write(folder / "sites.csv", "Id;Name;Name\n1;a;b\n22;;ccc\n")
    (folder / "points.dbf").write_bytes(dbf_bytes([("CODE", "C", 4)], [" ab  ", " abcd"]))
    write(folder / "extra.txt", "x\n")
    schema = catalog_schema("source_tables")

    def entry(st_oid, table, name, delimiter):
        return (st_oid, 7, table, name, True, True, True, "utf8", None, 0, f"F{st_oid}", None, None, "Download", "Flat", delimiter)

    manifest = spark.createDataFrame([entry(1, "SITES", "sites.csv", ";"), entry(2, "POINTS", "points.dbf", None), entry(3, "LOST", "lost.csv", None)], schema)
    compared = intake.scan_folder(spark, manifest, 7, str(folder))
    assert sorted((r.file_name, r.status) for r in compared.collect()) == [
        ("extra.txt", "extra"), ("lost.csv", "missing"), ("points.dbf", "present"), ("sites.csv", "present"),
    ]
    there = manifest.where("st_oid < 3")
    (profiles,) = intake.profile_run(spark, there, 7, str(folder))
    stored = spark.createDataFrame([], catalog_schema("source_table_columns"))
    done, columns = intake.finish_analysis(there, stored, profiles)
    assert sorted((r.st_oid, r.analyze_table, r.record_count) for r in done.collect()) == [(1, False, 2), (2, False, 2)]
    assert sorted((r.st_oid, r.column_index, r.name, r.type, r.min_length, r.max_length) for r in columns.collect()) == [
        (1, 0, "ID", "VARCHAR", 1, 2), (1, 1, "NAME_2", "VARCHAR", 0, 1), (1, 2, "NAME_1", "VARCHAR", 1, 3),
        (2, 0, "CODE", "CHARACTER", 2, 4),
    ]
    loaded = intake.load_run(spark, done, 7, str(folder), str(target))
    assert [r.load for r in loaded.collect()] == [False, False]
    assert sorted(values(spark.table("sites"))) == [("1", "a", "b"), ("22", "", "ccc")]
    assert sorted(values(spark.table("points"))) == [("ab",), ("abcd",)]


def test_in_memory_zip_reader_is_streamed():
    """Chunks are copied one by one, so an entry never has to fit in memory."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as bundle:
        bundle.writestr("a", b"x" * 10)
    with zipfile.ZipFile(out) as bundle, bundle.open("a") as source:
        assert [len(c) for c in iter(lambda: source.read(4), b"")] == [4, 4, 2]


def test_metadata_survives_text_rendering(spark):
    df = database.typed_as_source(spark.range(1))
    assert df.select(F.col("ID")).schema[0].metadata == {SOURCE_TYPE: "BIGINT"}


def test_predicates_cover_every_row_once(spark):
    conditions = database.covering_predicates("id", 3, 17, 5)
    assert len(conditions) == 4 and database.covering_predicates("id", 5, 4, 5) == []
    df = spark.createDataFrame([(i,) for i in [*range(-2, 25), None]], "id int")
    met = [sorted(str(r.id) for r in df.where(c).collect()) for c in conditions]
    assert sorted(i for some in met for i in some) == sorted(str(r.id) for r in df.collect())


def test_database_tables_are_read_by_ranges_of_their_key(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(dispatch, "read_sub_table", lambda *given: asked.append(given))
    entry = SimpleNamespace(file_name="a.mdb", sub_table="Wells", delimiter=None, qualified=True, encoding="utf8")
    dispatch.read_source(spark, "/in", entry, "jdbc:{}".format, lambda url, table: ("ID", 1, 10, 5))
    dispatch.read_source(spark, "/in", entry, "jdbc:{}".format, lambda url, table: None)
    assert asked[0][1:3] == ("jdbc:/in/a.mdb", "Wells") and len(asked[0][3]) == 3 and asked[1][3] is None


def test_dbf_objects_are_marked(spark, tmp_path):
    fields = b"".join(n.ljust(11, b"\0") + t + bytes(4) + bytes([10]) + bytes(15) for n, t in ((b"NOTE", b"M"), (b"PHOTO", b"P"))) + b"\r"
    head = struct.pack("<4BIHH20x", 0x83, 121, 1, 1, 2, 32 + len(fields), 21)
    (tmp_path / "m.dbf").write_bytes(head + fields + b" " + b"         1" + b" " * 10 + b" " + b" " * 20)
    with pytest.raises(Exception, match="no memo file"):
        dbf.read_dbf(spark, str(tmp_path / "m.dbf")).collect()
    (tmp_path / "m.dbt").write_bytes(bytes(512) + b"a text" + b"x" * 600 + b"\x1a\x1a")
    df = dbf.read_dbf(spark, str(tmp_path / "m.dbf"))
    assert values(df) == [("a text" + "x" * 600, ""), ("", "")]
    assert df.schema["PHOTO"].metadata == {SOURCE_TYPE: "PICTURE", dbf.UNSUPPORTED: True}
    assert dbf.UNSUPPORTED not in df.schema["NOTE"].metadata


@pytest.mark.parametrize("block", [9, 1_000_000])
def test_files_of_many_tables_in_one_plan(spark, tmp_path, blocks, block):
    """Own delimiters, quoting and encodings; a folder of parts; short and long records; a table without records."""
    blocks(block)
    write(tmp_path / "a.csv", 'x;y\n1;"a;\nb"\n2\n3;4;5\n')
    write(tmp_path / "b.txt", 'p|q\n"1|é\n', "latin-1")
    write(tmp_path / "c.csv", "only\n")
    write(tmp_path / "u.csv", 'h,i\n"1\n2",é\n', "utf-16")
    (tmp_path / "d.csv").mkdir()
    write(tmp_path / "d.csv" / "part-0.csv", "k,l\n1,2\n")
    write(tmp_path / "d.csv" / "part-1.csv", "k,l\n3,\n")
    (tmp_path / "e.dbf").write_bytes(dbf_bytes([("CODE", "C", 4), ("N", "N", 3)], ["*gone  1", " abcd -2"]))
    rows_ = [(1, "a.csv", ";", True, None), (2, "b.txt", "|", False, "latin1"), (3, "c.csv", None, True, None),
             (4, "d.csv", ",", True, None), (5, "e.dbf", None, False, None), (6, "u.csv", ",", True, "utf-16"), (7, "none.csv", None, True, None)]
    manifest = spark.createDataFrame(
        [(i, f"T{i}", n, None, d, q, e) for i, n, d, q, e in rows_],
        "st_oid bigint, table_name string, file_name string, sub_table string, delimiter string, qualified boolean, encoding string",
    )
    found = records.files_of_tables(spark, manifest, str(tmp_path))
    assert sorted((r.st_oid, r.loader) for r in found.collect()) == [(1, "Flat"), (2, "Flat"), (3, "Flat"), (4, "Flat"), (4, "Flat"), (5, "DBF"), (6, "Flat")]
    read = records.source_records(found, ["Flat", "DBF"])
    cells = sorted((r.st_oid, not r.header, r.cells) for r in read.collect())
    assert [(i, c) for i, data, c in cells if not data] == [(1, ["X", "Y"]), (2, ["P", "Q"]), (3, ["ONLY"]), (4, ["K", "L"]), (5, ["CODE", "N"]), (6, ["H", "I"])]
    assert sorted(((i, c) for i, data, c in cells if data), key=str) == sorted(
        [(1, ["1", "a;\nb"]), (1, ["2"]), (1, ["3", "4", "5"]), (2, ['"1', "é"]), (4, ["1", "2"]), (4, ["3", None]), (5, ["abcd", "-2"]), (6, ["1\n2", "é"])], key=str
    )
    measured = records.profile_records(read, manifest).collect()
    assert sorted((r.st_oid, r.name, r.type, r.min_length, r.max_length, r.record_count) for r in measured if r.st_oid in (1, 3, 5)) == [
        (1, "X", "VARCHAR", 1, 1, 3), (1, "Y", "VARCHAR", 0, 4, 3), (3, "ONLY", "VARCHAR", None, None, 0), (5, "CODE", "CHARACTER", 4, 4, 1), (5, "N", "NUMERIC", 2, 2, 1),
    ]


@settings(max_examples=40, deadline=None)
@given(st.text('ab",\n\r ;', max_size=40))
def test_blocks_are_shaped_as_the_rule_says(text):
    """Counting quotes gives what following the rule gives, wherever no quote is out of place."""
    rule, data = spanning.RecordRule(",", True), text.encode()
    for inside, shape in zip((False, True), spanning.block_shapes(rule, data)[0], strict=True):
        found, end = rule.records(data, inside)
        if not shape.odd:
            assert (shape.end, shape.first) == (end, found[0][0] if found else None)
            if not (shape.spans or inside or end):
                lines = [line for line in re.split(rb"\r\n|\n|\r", data) if line]
                assert [data[a:b] for a, b, _ in found] == lines
