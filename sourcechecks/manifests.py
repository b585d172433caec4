"""Queries over manifests: lists per file, comparison, repair, carry forward, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceworks.functions import sqlfuncs
from sourceworks.functions.names import url_file_name
from sourceworks.operators import changes as C
from sourceworks.operators import manifest as M
from sourceworks.operators.profile import repeated_names
from sourceworks.operators.runs import previous_runs, user_has_run
from sourceworks.schemas import file_types
from sourceworks.session import scratch_path
from sourcechecks.inputs import derived, given, sql, with_tables
from sourcechecks.registry import query

_OPTIONS = "st_oid, table_name, sub_table, coalesce(left(delimiter, 1), ',') as delimiter, qualified"
_PLACE = "row_number() over (partition by run_id, file_name order by st_oid) as position"


@query(
    "run_manifest",
    with_tables("manifest", f"select {', '.join(M.MANIFEST_VIEW)} from manifest where run_id = 42"),
)
def run_manifest(spark, sf):
    return M.run_manifest(derived(spark, sf, "manifest"), 42)


@query(
    "manifest_by_file",
    with_tables("manifest", f"select run_id, file_name, {_PLACE}, {_OPTIONS} from manifest where analyze_table"),
)
def manifest_by_file(spark, sf):
    return M.files_with_tables(derived(spark, sf, "manifest"), "analyze_table")


@query(
    "manifest_by_file_parts",
    """with m as (select o_orderkey as st_oid, o_custkey % 3 as run_id, 'one.mdb' as file_name, o_orderpriority as table_name from orders)
       select run_id, file_name, row_number() over (partition by run_id order by st_oid) as position, st_oid, table_name from m""",
)
def manifest_by_file_parts(spark, sf):
    """Three files that hold all tables, however many there are."""
    rows = given(spark, sf, "orders").selectExpr(
        "o_orderkey as st_oid", "o_custkey % 3 as run_id", "'one.mdb' as file_name", "o_orderpriority as table_name",
        "cast(null as string) as sub_table", "cast(null as string) as delimiter", "true as qualified",
    )
    return M.files_with_tables(rows).select("run_id", "file_name", "position", "st_oid", "table_name")


_DDL = """select m.st_oid, m.table_name,
                 'CREATE table ' || m.table_name || ' (' || string_agg(c.name, ' text,' order by c.column_index)
                 || ' text)' as definition
          from manifest m join {columns} c on m.st_oid = c.st_oid group by m.st_oid, m.table_name"""


@query("ddl_text", with_tables("manifest columns", _DDL.format(columns="columns")))
def ddl_text(spark, sf):
    return M.table_definitions(derived(spark, sf, "manifest"), derived(spark, sf, "columns"))


@query(
    "ddl_text_parts",
    with_tables("manifest columns", _DDL.format(
        columns="(select st_oid, name || '_' || k as name, column_index * 3 + k as column_index from columns, range(0, 3) r(k))")),
)
def ddl_text_parts(spark, sf):
    """Definitions of tables three times as wide."""
    columns = derived(spark, sf, "columns").withColumn("_k", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    wide = columns.withColumns(
        {"name": F.concat_ws("_", "name", F.col("_k").cast("string")), "column_index": F.col("column_index") * 3 + F.col("_k")}
    )
    return M.table_definitions(derived(spark, sf, "manifest"), wide.drop("_k"))


@query(
    "files_to_load",
    with_tables(
        "manifest columns",
        f"select run_id, file_name, {_PLACE}, {_OPTIONS} from manifest where load and st_oid in (select st_oid from columns)",
    ),
)
def files_to_load(spark, sf):
    return M.files_to_load(derived(spark, sf, "manifest"), derived(spark, sf, "columns"))


@query(
    "manifest_counts",
    with_tables(
        "manifest",
        """select c_custkey as run_id, count(m.st_oid) as tables
           from customer left join manifest m on m.run_id = c_custkey and m.load group by c_custkey""",
    ),
)
def manifest_counts(spark, sf):
    runs = given(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"))
    return M.manifest_counts(runs, derived(spark, sf, "manifest").where("load"))


_FOUND = """select l_suppkey * 15 + l_linenumber as run_id, concat('f', l_partkey % 3, '.', case l_orderkey % 4
                when 0 then 'csv' when 1 then 'XLSX' when 2 then 'mdb' else 'dbf' end) as file_name
            from {lineitem}"""
_COMPARED = f"""found as ({_FOUND.format(lineitem="lineitem")}),
    e as (select run_id, file_name, max_by(collect_type, st_oid) as collect_type, count(*) as n from manifest group by all),
    f as (select run_id, file_name, count(*) as n from found group by all),
    compared as (select coalesce(e.run_id, f.run_id) as run_id, coalesce(e.file_name, f.file_name) as file_name,
                        e.collect_type, coalesce(e.n, 0) as expected_rows, coalesce(f.n, 0) as found_rows,
                        case when f.n is null then 'missing' when e.n is null then 'extra' else 'present' end as status
                 from e full join f on e.run_id = f.run_id and e.file_name = f.file_name)"""


def _compared(spark, sf):
    return M.compare_files(derived(spark, sf, "manifest"), sql(spark, sf, _FOUND))


@query("file_diff", with_tables("manifest", f"{_COMPARED} select * from compared"))
def file_diff(spark, sf):
    return _compared(spark, sf)


@query(
    "file_followups",
    with_tables(
        "manifest",
        f"""{_COMPARED}, per_run as (
                select run_id, count(*) filter (where collect_type in ('Download', 'REST')) as d,
                       count(*) filter (where collect_type not in ('Download', 'REST')) as c,
                       run_id in (select run_id from found where file_name like '%.mdb') as again
                from compared where status = 'missing' group by run_id),
            steps as (
                select run_id, 1 as k, cast(null as bigint) as task_id, 'rescan_failed' as outcome, d + c as files from per_run where again
                union all select run_id, 1, 4, 'added', d from per_run where not again and d > 0
                union all select run_id, 2, 5, 'added', c from per_run where not again and c > 0
                union all select run_id, 3, 3, 'added', d + c from per_run where not again)
            select run_id, cast(row_number() over (partition by run_id order by k) as int) as step, task_id, outcome, files
            from steps""",
    ),
)
def file_followups(spark, sf):
    scanned = sql(spark, sf, _FOUND).where("file_name like '%.mdb'").select("run_id")
    return M.follow_up_tasks(_compared(spark, sf), scanned)


@query(
    "extra_files",
    with_tables(
        "manifest",
        f"""{_COMPARED} select run_id, row_number() over (partition by run_id order by file_name) as position, file_name,
               file_name || ' arrived but no source table asks for it' as message
            from compared where status = 'extra'""",
    ),
)
def extra_files(spark, sf):
    return M.extra_file_messages(_compared(spark, sf))


_ROUTE = """case when lower(url) like '%/arcgis/rest/%' then 'service' when url like '%.zip' then 'archive' else 'file' end"""


@query(
    "fetch_list",
    with_tables(
        "manifest",
        f"""{_COMPARED} select distinct m.run_id, m.url, {_ROUTE} as route, string_split(m.url, '/')[-1] as target
            from manifest m join compared c on m.run_id = c.run_id and m.file_name = c.file_name and c.status = 'missing'
            where m.url is not null and m.collect_type in ('Download', 'REST')""",
    ),
)
def fetch_list(spark, sf):
    return M.fetch_list(derived(spark, sf, "manifest"), _compared(spark, sf))


@query(
    "fetch_routes",
    f"select page_id, url, {_ROUTE} as route, string_split(url, '/')[-1] as target from pages",
)
def fetch_routes(spark, sf):
    return given(spark, sf, "pages").select(
        "page_id", "url", M.fetch_route(F.col("url")).alias("route"), url_file_name(F.col("url")).alias("target")
    )


_EXTENSION = "lower(regexp_extract(file_name, '\\.([^.]+)$', 1))"
_REPAIRED = f"""typed as (
        select *, coalesce(case {_EXTENSION} when 'csv' then 'Flat' when 'xlsx' then 'Excel' when 'mdb' then 'MDB' end, loader_type) as lt,
               coalesce(max(cast(regexp_extract(file_id, '\\d+') as bigint)) over (partition by run_id), 0) as used,
               row_number() over (partition by run_id, file_id is null order by st_oid) as nth
        from manifest)"""


_REPAIR = with_tables(
        "manifest",
        f"""{_REPAIRED} select st_oid, run_id, lt as loader_type,
                   if(file_id is null, 'F' || (used + nth), file_id) as file_id,
                   qualified and lt = 'Flat' as qualified, if(lt in ('Excel', 'MDB'), sub_table, null) as sub_table
            from typed""",
    )


@query("manifest_repair", _REPAIR)
def manifest_repair(spark, sf):
    repaired = M.repair_manifest(derived(spark, sf, "manifest"), file_types(spark))
    return repaired.select("st_oid", "run_id", "loader_type", "file_id", "qualified", "sub_table")


@query("sql_update_files", _REPAIR)
def sql_update_files(spark, sf):
    """The repair of every run by the SQL table function."""
    manifest = derived(spark, sf, "manifest")
    sqlfuncs.register_repair(manifest, file_types(spark))
    manifest.select("run_id").distinct().createOrReplaceTempView("manifest_runs")
    return spark.sql(
        """select m.st_oid, m.run_id, m.loader_type, m.file_id, m.qualified, m.sub_table
           from manifest_runs r, lateral update_files(r.run_id) m"""
    )


@query(
    "hot_run_file_ids",
    """with m as (select o_orderkey as st_oid, if(o_orderkey % 10 < 4, 1, o_custkey + 2) as run_id,
                         if(o_orderkey % 3 = 0, null, 'F' || o_orderkey) as file_id from orders)
       select st_oid, run_id, if(file_id is null,
              'F' || (coalesce(max(cast(file_id[2:] as bigint)) over (partition by run_id), 0)
                      + row_number() over (partition by run_id, file_id is null order by st_oid)), file_id) as file_id
       from m""",
)
def hot_run_file_ids(spark, sf):
    """New file ids when one run holds two fifths of the manifest."""
    manifest = derived(spark, sf, "manifest").withColumns(
        {
            "st_oid": F.col("st_oid") - 1,
            "run_id": F.expr("if((st_oid - 1) % 10 < 4, 1, run_id + 2)"),
            "file_id": F.expr("if((st_oid - 1) % 3 = 0, null, concat('F', st_oid - 1))"),
        }
    )
    return M.repair_manifest(manifest, file_types(spark)).select("st_oid", "run_id", "file_id")


_CARRIED = ", ".join(M.CARRIED)


@query(
    "carry_forward",
    with_tables(
        "manifest",
        f"""prev as (select run_id, lag(run_id) over (partition by run_id % 25 order by run_id) as previous_run_id
                     from (select distinct run_id from manifest))
            select st_oid, run_id, analyze_table, load, record_count, {_CARRIED} from manifest
            where run_id not in (select run_id from prev where previous_run_id is not null)
            union all
            select null, p.run_id, true, true, 0, {", ".join("m." + c for c in M.CARRIED)}
            from prev p join manifest m on m.run_id = p.previous_run_id""",
    ),
)
def carry_forward(spark, sf):
    manifest = derived(spark, sf, "manifest")
    runs = manifest.select("run_id").distinct().withColumn("ds_id", F.col("run_id") % 25)
    carried = M.carry_forward(manifest, previous_runs(runs).select("run_id", "previous_run_id"))
    return carried.select("st_oid", "run_id", "analyze_table", "load", "record_count", *M.CARRIED)


@query(
    "flag_update",
    with_tables(
        "manifest",
        """select st_oid, if(st_oid in (select l_orderkey from lineitem where l_returnflag = 'R'), false, load) as load
           from manifest""",
    ),
)
def flag_update(spark, sf):
    keys = given(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("st_oid"))
    return M.set_flags(derived(spark, sf, "manifest"), keys, "st_oid", {"load": False}).select("st_oid", "load")


# Changes: up to four events change one manifest row, each asked for by its user.
_CHANGES = """select event_id as change_id, case when event_id % 5 = 0 then 'insert' when event_id % 3 = 0 then 'delete' else 'update' end as op,
        user_id as user_oid, if(event_id % 5 = 0, null, (event_id - event_id % 4) * 2) as st_oid, event_id % 1500 as run_id,
        concat('NEW_', event_id) as table_name, concat('F', event_id) as file_id, 'n.csv' as file_name, '  ' as sub_table,
        'Flat' as loader_type, '|' as delimiter, true as qualified, 'utf8' as encoding, cast(null as {text}) as url,
        event_type as comments, 'FOI' as collect_type, false as analyze_table, true as load from {events}"""
_ALLOWED = """select u as user_oid, run_id from (
        select c_custkey % 150 as u, c_custkey as run_id from {customer}
        union select 7, c_custkey from {customer})"""
_JUDGED = f"""changes as ({_CHANGES.format(events="events", text="varchar")}), allowed as ({_ALLOWED.format(customer="customer")}),
    judged as (select c.*, if(c.op = 'insert', c.run_id, m.run_id) as at, a.user_oid is not null as may
               from changes c left join manifest m on m.st_oid = c.st_oid
               left join allowed a on a.user_oid = c.user_oid and a.run_id = if(c.op = 'insert', c.run_id, m.run_id))"""


def _guarded(spark, sf):
    changes = sql(spark, sf, _CHANGES.replace("{text}", "string"))
    return M.apply_guarded(derived(spark, sf, "manifest"), changes, sql(spark, sf, _ALLOWED))


@query(
    "guarded_changes",
    with_tables(
        "manifest",
        f"""{_JUDGED}, last as (select * from judged where may and op <> 'insert'
                  qualify row_number() over (partition by st_oid order by op = 'delete' desc, change_id desc) = 1)
           select m.st_oid, m.run_id, if(j.op is null, m.table_name, j.table_name) as table_name,
                  if(j.op is null, m.file_name, j.file_name) as file_name,
                  if(j.op is null, m.sub_table, null) as sub_table, if(j.op is null, m.delimiter, j.delimiter) as delimiter,
                  if(j.op is null, m.comments, j.comments) as comments, if(j.op is null, m.load, j.load) as load
           from manifest m left join last j on j.st_oid = m.st_oid
           where coalesce(j.op, '') <> 'delete'
           union all select null, run_id, table_name, file_name, null, delimiter, comments, load from judged where may and op = 'insert'""",
    ),
)
def guarded_changes(spark, sf):
    current, _ = _guarded(spark, sf)
    return current.select("st_oid", "run_id", "table_name", "file_name", "sub_table", "delimiter", "comments", "load")


@query(
    "guarded_rejects",
    with_tables(
        "manifest",
        f"{_JUDGED} select change_id, if(judged.at is null, 'no record', 'not owner') as reason from judged where not may",
    ),
)
def guarded_rejects(spark, sf):
    return _guarded(spark, sf)[1]


@query(
    "owned_manifest_rows",
    with_tables(
        "users task_runs manifest",
        """asked as (select distinct st_oid, run_id // 5 as run_id, run_id as user_oid from manifest)
           select a.st_oid, a.user_oid, a.run_id,
                  coalesce(list_contains(u.roles, 'admin'), false)
                  or coalesce(a.user_oid in (r.collection_user_oid, r.load_user_oid, r.check_user_oid, r.qa_user_oid), false) as has_run
           from asked a left join users u on u.user_oid = a.user_oid left join task_runs r on r.run_id = a.run_id""",
    ),
)
def owned_manifest_rows(spark, sf):
    asked = derived(spark, sf, "manifest").selectExpr("st_oid", "run_id as user_oid", "run_id div 5 as run_id")
    return user_has_run(asked, derived(spark, sf, "users"), derived(spark, sf, "task_runs"))


@query(
    "repeated_tables",
    with_tables(
        "manifest",
        "select run_id, file_name, count(*) as frequency from manifest group by all having count(*) > 1",
    ),
)
def repeated_tables(spark, sf):
    return repeated_names(derived(spark, sf, "manifest"), ["run_id"], "file_name")


@query(
    "targeted_update",
    with_tables("manifest", """select st_oid, if(st_oid <= 10, false, load) as load, table_name from manifest"""),
)
def targeted_update(spark, sf):
    """Ten keys of a stored manifest changed by rewriting the parts that hold them."""
    path = scratch_path(spark, "manifest")
    C.write_parted(derived(spark, sf, "manifest").select("st_oid", "load", "table_name"), path, "st_oid")
    keys = spark.range(1, 11).withColumnRenamed("id", "st_oid")
    C.rewrite_keys(spark, path, keys, "st_oid", lambda rows: M.set_flags(rows, keys, "st_oid", {"load": False}))
    return spark.read.parquet(path).select("st_oid", "load", "table_name")
