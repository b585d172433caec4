"""Queries over data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceworks.operators import checks as Q
from sourcechecks.inputs import derived, given, sql, with_tables
from sourcechecks.registry import query


def _violations(table: str, rules: dict[str, tuple[str, str]], key: str, source: str) -> str:
    return " union all ".join(
        f"select '{table}' as table_name, '{rule}' as rule, cast({key} as varchar) as key, cast({value} as varchar) as value from {source} where {broken}"
        for rule, (broken, value) in rules.items()
    )


_NEEDS = "lower(regexp_extract(file_name, '\\.([^.]+)$', 1)) in ('xlsx', 'xls', 'mdb', 'accdb')"
_MANIFEST_RULES = _violations(
    "source_tables",
    {
        "file_id_required": ("file_id is null", "null"),
        "comments_filled": ("regexp_matches(comments, '^\\s*$')", "comments"),
        "sub_table_fits_loader": (f"({_NEEDS}) <> (sub_table is not null and not regexp_matches(sub_table, '^\\s*$'))", "sub_table"),
        "table_name_pattern": ("not regexp_matches(table_name, '^[0-9A-Z_]+$')", "table_name"),
        "file_name_pattern": ("not regexp_matches(file_name, '^.+\\..+$')", "file_name"),
        "file_id_pattern": ("not regexp_matches(file_id, '^F\\d+$')", "file_id"),
        "delimiter_one_char": ("length(delimiter) > 1", "delimiter"),
        "loader_type_known": ("loader_type not in ('Excel', 'Flat', 'DBF', 'MDB')", "loader_type"),
        "collect_type_known": ("collect_type not in ('Download', 'FOI', 'Email', 'Scrape', 'Collect', 'REST')", "collect_type"),
        "url_filled": ("regexp_matches(url, '^\\s*$')", "url"),
    },
    "st_oid",
    "bad",
)
_SPOILED = """select {keep}, case when st_oid % 17 = 0 then lower(table_name) when st_oid % 19 = 0 then 'SAME' else table_name end as table_name,
    if(st_oid % 23 = 0, 'noextension', file_name) as file_name, if(st_oid % 29 = 0, 'F1', if(st_oid % 31 = 0, 'X' || st_oid, file_id)) as file_id,
    if(st_oid % 37 = 0, ';;', delimiter) as delimiter, if(st_oid % 41 = 0, 'Word', loader_type) as loader_type,
    if(st_oid % 43 = 0, 'Post', collect_type) as collect_type, if(st_oid % 47 = 0, '', url) as url,
    if(st_oid % 53 = 0, -st_oid, run_id) as run_id from {manifest}"""
_KEEP = "st_oid, encoding, sub_table, comments"
_SPOILED_SQL = _SPOILED.format(keep=_KEEP, manifest="manifest")


@query(
    "quality_rules",
    with_tables(
        "manifest",
        f"""bad as ({_SPOILED_SQL}) {_MANIFEST_RULES}
            union all select 'source_tables', 'file_id_unique', run_id || '|' || file_id, cast(count(*) as varchar) from bad
                where file_id is not null group by run_id, file_id having count(*) > 1
            union all select 'source_tables', 'table_name_unique', run_id || '|' || table_name, cast(count(*) as varchar) from bad
                group by run_id, table_name having count(*) > 1
            union all select 'source_tables', 'run_exists', cast(st_oid as varchar), cast(run_id as varchar) from bad
                where run_id not in (select c_custkey from customer)
            union all select 'pipeline_runs', 'has_source_table', cast(c_custkey as varchar), null from customer
                where c_custkey not in (select run_id from bad)""",
    ),
)
def quality_rules(spark, sf):
    """Every manifest rule over a manifest with spoiled values."""
    bad = spark.sql(_SPOILED.replace("{keep}", _KEEP), manifest=derived(spark, sf, "manifest"))
    runs = given(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"))
    return Q.manifest_violations(bad, runs)


_COLUMN_BAD = "select st_oid, if(st_oid % 13 = 0, ' ', name) as name, if(st_oid % 11 = 0, '', if(st_oid % 7 = 0, null, 'x')) as label from {columns}"


@query(
    "column_rules",
    with_tables(
        "manifest columns",
        f"""bad as ({_COLUMN_BAD.format(columns="columns")})
            select 'source_table_columns' as table_name, 'label_filled' as rule, name as key, label as value from bad where label = ''
            union all select 'source_table_columns', 'name_filled', name, name from bad where name = ' '
            union all select 'source_table_columns', 'name_unique', st_oid || '|' || name, cast(count(*) as varchar) from bad group by st_oid, name having count(*) > 1
            union all select 'source_table_columns', 'table_exists', name, cast(st_oid as varchar) from bad
                where st_oid not in (select st_oid from manifest where load)""",
    ),
)
def column_rules(spark, sf):
    bad = spark.sql(_COLUMN_BAD, columns=derived(spark, sf, "columns"))
    return Q.column_violations(bad, derived(spark, sf, "manifest").where("load"))


@query(
    "value_rules",
    _violations(
        "documents",
        {
            "lang_known": ("lang not in ('en', 'de')", "lang"),
            "text_no_mail": ("not regexp_matches(text, '^[^@]*$')", "length(text)"),
            "source_filled": ("regexp_matches(source, '^\\s*$')", "source"),
        },
        "doc_id",
        "documents",
    ),
)
def value_rules(spark, sf):
    broken, _ = Q.matches("text", r"^[^@]*$")
    rules = {
        "lang_known": Q.one_of("lang", ["en", "de"]),
        "text_no_mail": (broken, F.length("text")),
        "source_filled": Q.filled("source"),
    }
    return Q.row_violations(given(spark, sf, "documents"), "documents", F.col("doc_id"), rules)


@query(
    "json_rules",
    """select 'events' as table_name, 'props_counts' as rule, cast(event_id as varchar) as key, '[1]' as value from events where event_type = 'error'
       union all select 'events', 'kinds_filled', cast(event_id as varchar), '["' || event_type || '"," "]' from events where event_type = 'view'""",
)
def json_rules(spark, sf):
    events = sql(spark, sf, """select event_id, if(event_type = 'error', '[1]', props) as props,
                               if(event_type = 'view', array(event_type, ' '), array(event_type)) as kinds from {events}""")
    rules = {"props_counts": Q.counts_decode("props"), "kinds_filled": Q.items_filled("kinds")}
    return Q.row_violations(events, "events", F.col("event_id"), rules)


@query(
    "template_rules",
    """select 'pipeline_tasks' as table_name, 'place_unique' as rule, concat(l_orderkey, '|0|', l_linenumber) as key, cast(count(*) as varchar) as value
       from lineitem group by l_orderkey, l_linenumber having count(*) > 1""",
)
def template_rules(spark, sf):
    steps = given(spark, sf, "lineitem").selectExpr("l_orderkey as pipeline_id", "0 as parent_task", "l_linenumber as parent_task_order")
    return Q.template_violations(steps)


_DELETED = "select c_custkey as ds_id from customer where c_acctbal < 0"


@query("cascade_delete", f"select o_orderkey, o_custkey from orders where o_custkey not in ({_DELETED.replace('< 0', '< 1000')})")
def cascade_delete(spark, sf):
    deleted = given(spark, sf, "customer").where("c_acctbal < 1000").select("c_custkey")
    return Q.cascade_delete(given(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", deleted, "c_custkey")


@query("set_null_delete", "select o_orderkey, if(o_custkey in (select c_custkey from customer where c_acctbal < 1000), null, o_custkey) as o_custkey from orders")
def set_null_delete(spark, sf):
    deleted = given(spark, sf, "customer").where("c_acctbal < 1000").select("c_custkey")
    return Q.set_null_on_delete(given(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", deleted, "c_custkey")


@query("restricted_deletes", "select s_suppkey from supplier where s_acctbal < 5000 and s_suppkey in (select l_suppkey from lineitem)")
def restricted_deletes(spark, sf):
    deleted = given(spark, sf, "supplier").where("s_acctbal < 5000").select("s_suppkey")
    return Q.restricted_deletes(given(spark, sf, "lineitem"), "l_suppkey", deleted, "s_suppkey")


@query("empty_runs", "select 'pipeline_runs' as table_name, 'has_source_table' as rule, cast(c_custkey as varchar) as key, cast(null as varchar) as value from customer where c_custkey not in (select user_id from events)")
def empty_runs(spark, sf):
    runs = given(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"))
    return Q.runs_without_tables(runs, given(spark, sf, "events").select(F.col("user_id").alias("run_id")))
