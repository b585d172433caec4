"""Queries that write files from the given tables and read them back with the readers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceworks.operators.ordering import number_by_sort
from sourceworks.plans.increment import PARTIAL, profile_versions
from sourceworks.plans.intake import load_run, profile_run
from sourceworks.session import cut_lineage, scratch_path
from sourceworks.sources.archives import archive_entries, expand_archives
from sourceworks.sources.decoders import register as register_decoders
from sourceworks.sources.files import backup_files, backup_manifest, list_files
from sourceworks.sources.flat import read_flat, split_unreadable, write_flat
from sourceworks.sources.records import dbf_source_records, table_of_records
from sourceworks.sources.sheets import read_sheets, sheet_rows
from sourceworks.sources.tables import column_list, table_exists, write_text_table
from sourcechecks.files import write_archives, write_dbf_files, write_dbf_memos, write_small_files, write_workbooks
from sourcechecks.inputs import given
from sourcechecks.registry import query

_TEXT_ORDERS = """select cast(o_orderkey as varchar) as ORDER_KEY_NUM, o_orderstatus as STATUS,
    cast(cast(o_totalprice as decimal(18,2)) as varchar) as PRICE, strftime(o_orderdate, '%Y-%m-%d') as _1ST_DATE,
    {note} as NOTE from orders"""


def _order_file(spark, sf):
    """Orders as a CSV file with headers that need repair."""
    rows = given(spark, sf, "orders").select(
        F.col("o_orderkey").alias(" Order  Key #"),
        F.col("o_orderstatus").alias("Status."),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("1st date"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('5" pipe, '), "o_orderpriority")).alias("note"),
    )
    path = scratch_path(spark, "flat")
    write_flat(rows, path)
    return path


@query(
    "flat_rows",
    _TEXT_ORDERS.format(note="""if(o_orderkey % 2 = 0, '5" pipe, ' || o_orderpriority, '')"""),
)
def flat_rows(spark, sf):
    return read_flat(spark, _order_file(spark, sf))


@query(
    "flat_load",
    _TEXT_ORDERS.format(note="""if(o_orderkey % 2 = 0, '5" pipe, ' || o_orderpriority, '')"""),
)
def flat_load(spark, sf):
    """The CSV file loaded as a text table."""
    target = scratch_path(spark, "table")
    write_text_table(read_flat(spark, _order_file(spark, sf)), "sourceworks_flat_load", target)
    return spark.table("sourceworks_flat_load")


@query(
    "loaded_columns",
    """select position, name from (values (1, 'o_orderkey'), (2, 'o_custkey'), (3, 'o_orderstatus'), (4, 'o_totalprice'),
              (5, 'o_orderdate'), (6, 'o_orderpriority')) t(position, name) where exists (select 1 from orders)""",
)
def loaded_columns(spark, sf):
    """The column list of a table that was loaded, if it exists."""
    write_text_table(given(spark, sf, "orders"), "sourceworks_columns", scratch_path(spark, "table"))
    names = column_list(spark, "sourceworks_columns") if table_exists(spark, "sourceworks_columns") else []
    return spark.createDataFrame(list(enumerate(names, 1)), "position int, name string")


@query(
    "flat_documents",
    """select cast(doc_id as varchar) as DOC_ID, lang as LANG, length(text) as chars, md5(text) as digest from documents""",
)
def flat_documents(spark, sf):
    """Whole documents, line ends and quotes included, through a qualified file."""
    path = scratch_path(spark, "documents")
    write_flat(given(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    loaded = read_flat(spark, path)
    return loaded.select("DOC_ID", "LANG", F.length("TEXT").cast("bigint").alias("chars"), F.md5("TEXT").alias("digest"))


@query(
    "flat_documents_split",
    """select cast(doc_id as varchar) as DOC_ID, lang as LANG, length(text) as chars, md5(text) as digest from documents""",
)
def flat_documents_split(spark, sf):
    """The same with blocks so small that documents go over many of them."""
    path = scratch_path(spark, "documents")
    write_flat(given(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    spark.conf.set("spark.sourceworks.flatBlockBytes", 100_000)
    try:
        loaded = read_flat(spark, path)
    finally:
        spark.conf.unset("spark.sourceworks.flatBlockBytes")
    return loaded.select("DOC_ID", "LANG", F.length("TEXT").cast("bigint").alias("chars"), F.md5("TEXT").alias("digest"))


@query(
    "flat_unqualified",
    """select cast(p_partkey as varchar) as P_PARTKEY, if(p_size % 2 = 0, p_size || '" ' || p_name, null) as NAME,
              '"' || p_brand as BRAND from part""",
)
def flat_unqualified(spark, sf):
    """A file in which quotes are ordinary characters; a bare empty field is null."""
    name = F.when(F.col("p_size") % 2 == 0, F.concat("p_size", F.lit('" '), "p_name")).otherwise("")
    line = F.concat_ws("|", "p_partkey", name, F.concat(F.lit('"'), "p_brand"))
    path = scratch_path(spark, "unqualified")
    given(spark, sf, "part").select(line.alias("p_partkey|name|brand")).write.csv(
        path, header=True, sep="\u0001", quote="", escape=""
    )
    return read_flat(spark, path, delimiter="|", qualified=False)


_WIDTHS = """case when o_orderkey % 10 = 0 then o_orderkey || ',' || o_orderstatus
                  when o_orderkey % 10 = 1 then o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority || ',more'
                  else o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority end"""


@query(
    "record_width",
    f"""select if(o_orderkey % 10 > 1, cast(o_orderkey as varchar), null) as K, if(o_orderkey % 10 > 1, o_orderstatus, null) as S,
               if(o_orderkey % 10 > 1, o_orderpriority, null) as P, if(o_orderkey % 10 > 1, null, {_WIDTHS}) as record
        from orders""",
)
def record_width(spark, sf):
    """Good records, and the text of records that are too short or too long."""
    path = scratch_path(spark, "ragged")
    lines = given(spark, sf, "orders").select(F.expr(_WIDTHS).alias("k,s,p"))
    lines.write.csv(path, header=True, sep="\u0001", quote="", escape="")
    good, bad = split_unreadable(read_flat(spark, path, keep_unreadable=True))
    return good.unionByName(bad, allowMissingColumns=True)


_SHEET = """select cast(o_orderkey as varchar) as ORDER_NUM, o_orderstatus as STATUS,
    cast(if(o_totalprice = floor(o_totalprice), cast(cast(o_totalprice as bigint) as varchar),
            rtrim(cast(cast(o_totalprice as decimal(18,2)) as varchar), '0')) as varchar) as PRICE,
    strftime(o_orderdate, '%Y-%m-%d') as ORDER_DATE, if(o_orderpriority = '1-URGENT', 'TRUE', 'FALSE') as URGENT,
    if(o_orderkey % 3 > 0, o_orderpriority || ' & more', '') as NOTE from orders"""


_SHEET_CELLS = f"select cells from (select [ORDER_NUM, STATUS, PRICE, ORDER_DATE, URGENT, NOTE] as c, array_to_string(c, '|') as cells from ({_SHEET}))"


@query("sheet_rows", _SHEET_CELLS)
def sheet_rows_query(spark, sf):
    """All workbooks at once: one task per sheet."""
    folder = write_workbooks(given(spark, sf, "orders"), scratch_path(spark, "books"))
    books = list_files(spark, folder, "*.xlsx").select("path", F.lit("Orders").alias("sheet"))
    rows = sheet_rows(books).where("row_no > 1")
    return rows.select(F.array_join("cells", "|").alias("cells"))


@query("sheet_tables", "select cast(o_orderkey as varchar) as KEY, cast(o_orderkey // 5000 as bigint) as book from orders")
def sheet_tables(spark, sf):
    """Each workbook read as a table of its own; the table has one entry per file."""
    folder = write_workbooks(given(spark, sf, "orders"), scratch_path(spark, "books"))
    books = list_files(spark, folder, "*.xlsx").select("path", F.lit("Keys").alias("sheet"))
    table = read_sheets(books, with_path=True)
    return table.select("KEY", F.regexp_extract("path", r"book(\d+)\.", 1).cast("bigint").alias("book"))


@query("sql_sheet_rows", _SHEET_CELLS)
def sql_sheet_rows(spark, sf):
    """The same by the SQL table function over a table of files."""
    folder = write_workbooks(given(spark, sf, "orders"), scratch_path(spark, "books"))
    list_files(spark, folder, "*.xlsx").select("path", F.lit("Orders").alias("sheet")).createOrReplaceTempView("workbooks")
    register_decoders(spark)
    return spark.sql(
        """select array_join(transform(array_sort(collect_list(struct(at, sheet_text(cell.kinds, cell.raws) as text))), c -> c.text), '|') as cells
           from sheet_records(table(select path, sheet from workbooks)) lateral view posexplode(arrays_zip(kinds, raws)) c as at, cell
           where not header group by path, row_no"""
    )


_DBF_ROWS = """select cast(o_orderkey as varchar) as ORDER_KEY, o_orderstatus as STATUS, cast(cast(o_totalprice as decimal(18,2)) as varchar) as PRICE,
              if(o_orderstatus = 'P', '', strftime(o_orderdate, '%Y-%m-%dT00:00:00Z')) as PLACED,
              if(o_orderpriority = '1-URGENT', 'TRUE', '') as URGENT
       from orders where o_orderkey % 10 <> 3"""
_DBF_KEYS = 20_000


@query("dbf_rows", _DBF_ROWS)
def dbf_rows(spark, sf):
    """DBF files, all by one plan; deleted records are left out."""
    folder = write_dbf_files(given(spark, sf, "orders"), scratch_path(spark, "dbf"), _DBF_KEYS)
    files = list_files(spark, folder, "*.dbf").select(F.lit(0).cast("bigint").alias("st_oid"), "path")
    return table_of_records(dbf_source_records(files))


@query("sql_dbf_rows", _DBF_ROWS)
def sql_dbf_rows(spark, sf):
    """The same by the SQL table function over a table of files."""
    folder = write_dbf_files(given(spark, sf, "orders"), scratch_path(spark, "dbf"), _DBF_KEYS)
    list_files(spark, folder, "*.dbf").select("path").createOrReplaceTempView("dbf_files")
    register_decoders(spark)
    return spark.sql(
        """select cells[0] as ORDER_KEY, cells[1] as STATUS, cells[2] as PRICE, cells[3] as PLACED, cells[4] as URGENT
           from dbf_records(table(dbf_files)) where not header"""
    )


@query("dbf_memos", "select cast(doc_id as varchar) as DOC_ID, lang as LANG, length(text) as chars, md5(text) as digest from documents")
def dbf_memos(spark, sf):
    """Whole documents as memo texts, in files of all three kinds."""
    folder = write_dbf_memos(given(spark, sf, "documents"), scratch_path(spark, "memos"))
    files = list_files(spark, folder, "*.dbf").select(F.lit(0).cast("bigint").alias("st_oid"), "path")
    loaded = table_of_records(dbf_source_records(files, "utf-8"))
    return loaded.select("DOC_ID", "LANG", F.length("TEXT").cast("bigint").alias("chars"), F.md5("TEXT").alias("digest"))


def _lengths(table: str, name: str, kind: str, index: int, expression: str, source: str) -> str:
    return f"""select {table} as table_name, {index} as column_index, '{name}' as name, '{kind}' as type,
        cast(min(length({expression})) as int) as min_length, cast(max(length({expression})) as int) as max_length,
        count(*) as record_count from {source} group by 1"""


@query(
    "run_profile",
    " union all ".join(
        _lengths(*column)
        for column in [
            ("'T_PART'", "P_PARTKEY", "VARCHAR", 0, "cast(p_partkey as varchar)", "part"),
            ("'T_PART'", "P_NAME", "VARCHAR", 1, "p_name", "part"),
            ("'T_BOOK' || (o_orderkey // 5000)", "KEY", "VARCHAR", 0, "cast(o_orderkey as varchar)", "orders"),
            ("'T_ORDERS' || (o_orderkey // 1000000)", "ORDER_KEY", "NUMERIC", 0, "cast(o_orderkey as varchar)", "live"),
            ("'T_ORDERS' || (o_orderkey // 1000000)", "STATUS", "CHARACTER", 1, "o_orderstatus", "live"),
            ("'T_ORDERS' || (o_orderkey // 1000000)", "PRICE", "NUMERIC", 2, "cast(cast(o_totalprice as decimal(18,2)) as varchar)", "live"),
            ("'T_ORDERS' || (o_orderkey // 1000000)", "PLACED", "DATE", 3, "if(o_orderstatus = 'P', '', repeat('x', 20))", "live"),
            ("'T_ORDERS' || (o_orderkey // 1000000)", "URGENT", "LOGICAL", 4, "if(o_orderpriority = '1-URGENT', 'TRUE', '')", "live"),
        ]
    ).replace("from live", "from (select * from orders where o_orderkey % 10 <> 3)"),
)
def run_profile(spark, sf):
    """A run with a flat file, DBF files and workbooks: the manifest comes from the folder, readers from the manifest."""
    folder = scratch_path(spark, "run")
    orders = given(spark, sf, "orders")
    write_flat(given(spark, sf, "part").select("p_partkey", "p_name"), f"{folder}/part.csv")
    write_dbf_files(orders, folder)
    write_workbooks(orders, folder)
    name = F.substring_index("file_name", ".", 1)
    found = list_files(spark, folder).where("file_name rlike 'xlsx|dbf'").select("file_name", "loader_type")
    flat = spark.createDataFrame([("part.csv", "Flat")], "file_name string, loader_type string")
    named = number_by_sort(found.unionByName(flat), [], ["file_name"], "st_oid").select(
        "st_oid",
        F.lit(1).cast("bigint").alias("run_id"),
        F.upper(F.concat(F.lit("t_"), name)).alias("table_name"),
        "file_name",
        F.lit(True).alias("analyze_table"),
        F.lit(True).alias("qualified"),
        F.lit("utf8").alias("encoding"),
        F.when(F.col("loader_type") == "Excel", "Keys").alias("sub_table"),
        F.lit(None).cast("string").alias("delimiter"),
    )
    profiles = reduce(DataFrame.unionByName, profile_run(spark, named, 1, folder))
    return profiles.select("table_name", "column_index", "name", "type", "min_length", "max_length", "record_count")


# A thousand tables, however many orders there are.
_TABLES = 1000


def _table_files(spark, sf):
    """A flat file for every remainder of the order number, and the manifest of a run that wants them all."""
    folder = scratch_path(spark, "tables")
    write_small_files(given(spark, sf, "orders"), folder, _TABLES)
    manifest = spark.range(_TABLES).select(
        F.col("id").alias("st_oid"),
        F.lit(1).cast("bigint").alias("run_id"),
        F.concat(F.lit("PART_"), "id").alias("table_name"),
        F.concat(F.lit("part"), "id", F.lit(".txt")).alias("file_name"),
        F.lit(True).alias("analyze_table"),
        F.lit(True).alias("load"),
        F.lit(True).alias("qualified"),
        F.lit("utf8").alias("encoding"),
        F.lit(None).cast("string").alias("sub_table"),
        F.lit(";").alias("delimiter"),
    )
    kept = given(spark, sf, "orders").select((F.col("o_orderkey") % _TABLES).alias("st_oid")).distinct()
    return folder, cut_lineage(manifest.join(kept, "st_oid", "left_semi"))


@query(
    "run_tables",
    " union all ".join(
        _lengths(f"'PART_' || (o_orderkey % {_TABLES})", name, "VARCHAR", index, text, "orders")
        for index, (name, text) in enumerate(
            [("ORDER_KEY", "cast(o_orderkey as varchar)"), ("STATUS", "o_orderstatus"), ("NOTE", "if(o_orderkey % 3 = 0, '', o_orderpriority || ';' || chr(10))")]
        )
    ),
)
def run_tables(spark, sf):
    """The profile of a run of a thousand tables, by as many jobs as that of one."""
    folder, manifest = _table_files(spark, sf)
    (profiles,) = profile_run(spark, manifest, 1, folder)
    return profiles.select("table_name", "column_index", "name", "type", "min_length", "max_length", "record_count")


@query(
    "run_load",
    f"""select o_orderkey % {_TABLES} as st_oid, cast(o_orderkey as varchar) as ORDER_KEY, o_orderstatus as STATUS,
               if(o_orderkey % 3 = 0, '', o_orderpriority || ';' || chr(10)) as NOTE from orders""",
)
def run_load(spark, sf):
    """The same run loaded into a thousand tables, which are read back by their files."""
    folder, manifest = _table_files(spark, sf)
    target = scratch_path(spark, "loaded")
    left = load_run(spark, manifest, 1, folder, target).where("load")
    loaded = spark.read.schema("ORDER_KEY string, STATUS string, NOTE string").parquet(f"{target}/*/*")
    table = F.regexp_extract(F.col("_metadata.file_path"), r"part_(\d+)/", 1).cast("bigint")
    return loaded.select(table.alias("st_oid"), "ORDER_KEY", "STATUS", "NOTE").join(left.select("st_oid"), "st_oid", "left_anti")


_PARTS = 8


@query(
    "incremental_profile",
    f"""with changed as (select o_orderkey, if(o_orderkey % {_PARTS} = 3, 'Z' || o_orderstatus, o_orderstatus) as status,
                                if(o_orderkey % 3 = 0, '', o_orderpriority || ';' || chr(10)) as note from orders)
        select *, cast(least({_PARTS}, (select count(*) from orders)) as int) as read_first, cast(1 as int) as read_again from ("""
    + " union all ".join(
        _lengths("'PART'", name, "VARCHAR", index, text, "changed")
        for index, (name, text) in enumerate([("ORDER_KEY", "cast(o_orderkey as varchar)"), ("STATUS", "status"), ("NOTE", "note")])
    )
    + ")",
)
def incremental_profile(spark, sf):
    """A folder is profiled, one of its files changes, and it is profiled again: only that file is read."""
    folder = scratch_path(spark, "grown")
    orders = given(spark, sf, "orders")
    write_small_files(orders, folder, _PARTS)
    nothing = spark.createDataFrame([], PARTIAL)
    options = {"table_name": "PART", "delimiter": ";"}
    _, stored, first = profile_versions(spark, folder, backup_manifest(spark, folder), nothing, **options)
    third = orders.where(f"o_orderkey % {_PARTS} = 3").withColumn("o_orderstatus", F.concat(F.lit("Z"), "o_orderstatus"))
    write_small_files(third, folder, _PARTS)
    profile, _, again = profile_versions(spark, folder, backup_manifest(spark, folder), stored, **options)
    read = {"read_first": F.lit(first.count()), "read_again": F.lit(again.count())}
    return profile.withColumns({k: v.cast("int") for k, v in read.items()})


_ENTRIES = """select * from (
    select c_custkey // 200 as n, 'names_' || n || '.csv' as entry,
           'c_custkey,c_name' || chr(10) || string_agg(c_custkey || ',' || c_name || chr(10), '' order by c_custkey) as content
    from customer group by n
    union all select c_custkey // 200 as n, 'sub/segments_' || n || '.csv',
           'c_custkey,c_mktsegment' || chr(10) || string_agg(c_custkey || ',' || c_mktsegment || chr(10), '' order by c_custkey)
    from customer group by n)"""


def _archives(spark, sf):
    folder = write_archives(given(spark, sf, "customer"), scratch_path(spark, "zip"))
    return list_files(spark, folder, "*.zip")


def _expanded(spark, sf):
    target = scratch_path(spark, "expanded")
    written = expand_archives(_archives(spark, sf), target)
    written.write.parquet(f"{target}_written")
    return target


_LISTED = f"select 'bundle' || n || '.zip' as archive, entry, length(content) as length from ({_ENTRIES})"


@query("sql_archive_entries", _LISTED)
def sql_archive_entries(spark, sf):
    """Entries of archives by the SQL table function over a table of files."""
    _archives(spark, sf).select("path").createOrReplaceTempView("archives")
    register_decoders(spark)
    return spark.sql("select substring_index(path, '/', -1) as archive, entry, length from archive_entries(table(archives))")


@query("archive_entries", f"select 'bundle' || n || '.zip' as archive, entry, length(content) as length from ({_ENTRIES})")
def archive_entries_query(spark, sf):
    listed = archive_entries(_archives(spark, sf))
    return listed.select(F.substring_index("path", "/", -1).alias("archive"), "entry", "length")


@query(
    "archive_rows",
    """select 'name' as kind, cast(c_custkey as varchar) as key, c_name as value from customer
       union all select 'segment', cast(c_custkey as varchar), c_mktsegment from customer""",
)
def archive_rows(spark, sf):
    """Entries of both kinds expanded to files, then read as flat files."""
    folder = _expanded(spark, sf)
    names, segments = (read_flat(spark, f"{folder}/*/{kind}_*.csv") for kind in ("names", "sub/segments"))
    return names.select(F.lit("name").alias("kind"), F.col("C_CUSTKEY").alias("key"), F.col("C_NAME").alias("value")).unionByName(
        segments.select(F.lit("segment").alias("kind"), F.col("C_CUSTKEY").alias("key"), F.col("C_MKTSEGMENT").alias("value"))
    )


@query("folder_listing", f"select string_split(entry, '/')[-1] as file_name, 'Flat' as loader_type, length(content) as length from ({_ENTRIES})")
def folder_listing(spark, sf):
    return list_files(spark, _expanded(spark, sf)).select("file_name", "loader_type", "length")


@query(
    "backup_manifest",
    f"select 'bundle' || n || '.zip/' || entry as file_name, length(content) as length, sha256(content) as checksum from ({_ENTRIES})",
)
def backup_manifest_query(spark, sf):
    return backup_manifest(spark, _expanded(spark, sf))


@query(
    "backup_files",
    f"select 'bundle' || n || '.zip/' || entry as file_name, length(content) as length, sha256(content) as checksum from ({_ENTRIES})",
)
def backup_files_query(spark, sf):
    return backup_files(spark, _expanded(spark, sf), scratch_path(spark, "backup"))
