"""Queries over column profiles and key ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceworks.functions.values import table_as_text
from sourceworks.operators import profile as P
from sourceworks.sources.database import typed_as_source
from sourcechecks.inputs import derived, given, with_tables
from sourcechecks.registry import query

# Doubles are rendered with two decimals on both sides; date-times as the engine writes them (F2).
_MONEY = "cast(cast({c} as decimal(18,2)) as varchar)"
_STAMP = """strftime({c}, '%Y-%m-%dT%H:%M:%S') || if(epoch_us({c}) % 1000000 = 0, '',
            '.' || rtrim(lpad(cast(epoch_us({c}) % 1000000 as varchar), 6, '0'), '0'))"""
_ORDER_COLUMNS = {"o_orderkey": "{c}", "o_custkey": "{c}", "o_orderstatus": "{c}", "o_totalprice": _MONEY, "o_orderdate": _STAMP,
                  "o_orderpriority": "{c}"}
_EVENT_COLUMNS = {"event_id": "{c}", "ts": _STAMP, "user_id": "{c}", "event_type": "{c}", "value": _MONEY, "props": "{c}"}
_LINE_COLUMNS = {"l_orderkey": "{c}", "l_partkey": "{c}", "l_suppkey": "{c}", "l_linenumber": "{c}", "l_quantity": _MONEY,
                 "l_extendedprice": _MONEY, "l_discount": _MONEY, "l_tax": _MONEY, "l_returnflag": "{c}", "l_linestatus": "{c}",
                 "l_shipdate": _STAMP}


def _profile_sql(table: str, columns, types: dict[str, str] | None = None, where: str = "true", label: str | None = None) -> str:
    rendered = columns if isinstance(columns, dict) else dict.fromkeys(columns, "{c}")
    parts = [
        f"""select '{label or table}' as table_name, {i} as column_index, '{c}' as name, '{(types or {}).get(c, "VARCHAR")}' as type,
            cast(min(length(coalesce(cast({text.format(c=c)} as varchar), ''))) as int) as min_length,
            cast(max(length(coalesce(cast({text.format(c=c)} as varchar), ''))) as int) as max_length,
            count(*) as record_count from {table} where {where}"""
        for i, (c, text) in enumerate(rendered.items())
    ]
    return " union all ".join(parts)


def _whole(spark, sf, table):
    """A given table with doubles as decimals, for one rendering on both sides."""
    rows = given(spark, sf, table)
    doubles = [f.name for f in rows.schema.fields if f.dataType.typeName() == "double"]
    return rows.withColumns({c: F.col(c).cast("decimal(18,2)") for c in doubles})


@query("profile_orders", _profile_sql("orders", _ORDER_COLUMNS))
def profile_orders(spark, sf):
    return P.profile(_whole(spark, sf, "orders"), "orders")


@query("profile_events", _profile_sql("events", _EVENT_COLUMNS))
def profile_events(spark, sf):
    return P.profile(_whole(spark, sf, "events"), "events")


@query("profile_documents", _profile_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def profile_documents(spark, sf):
    return P.profile(given(spark, sf, "documents"), "documents")


@query(
    "profile_typed",
    _profile_sql(
        "customer",
        {"c_custkey": "{c}", "c_name": "{c}", "c_nationkey": "{c}", "c_acctbal": _MONEY, "c_mktsegment": "{c}"},
        {"c_custkey": "BIGINT", "c_nationkey": "INTEGER", "c_acctbal": "DECIMAL"},
    ).replace(" as name", " as lower_name").replace("select 'customer'", "select upper(lower_name) as name, * exclude (lower_name) from (select 'customer'").replace("from customer where true", "from customer)"),
)
def profile_typed(spark, sf):
    return P.profile(typed_as_source(_whole(spark, sf, "customer")), "customer", typed=True)


@query("profile_merge", _profile_sql("orders", {c: t for c, t in _ORDER_COLUMNS.items() if c != "o_orderpriority"}))
def profile_merge(spark, sf):
    """The profile of orders from those of each priority."""
    return P.merge_profiles(P.profile(_whole(spark, sf, "orders"), "orders", by=["o_orderpriority"]))


_LINES_A = _profile_sql("lineitem", {c: t for c, t in _LINE_COLUMNS.items() if c != "l_partkey"}, where="l_returnflag = 'A'")
_LINES_R = _profile_sql("lineitem", {c: t for c, t in _LINE_COLUMNS.items() if c != "l_linestatus"}, where="l_returnflag <> 'A'")


@query(
    "profile_upsert",
    f"""with old as ({_LINES_A}), new as ({_LINES_R})
        select cast(7 as bigint) as st_oid, coalesce(n.name, o.name) as name, 'VARCHAR' as type,
               if(n.name is not null, n.max_length, o.max_length) as max_length,
               if(n.name is not null, n.min_length, o.min_length) as min_length,
               if(o.name is null, null, 'kept') as label,
               cast(if(n.name is not null, n.column_index, o.column_index) as int) as column_index
        from old o full join new n on o.name = n.name""",
)
def profile_upsert(spark, sf):
    """Stored: all columns but one, of returned lines; fresh: all columns but another, of the other lines."""
    lines = _whole(spark, sf, "lineitem")
    shape = ["st_oid", "name", "type", "max_length", "min_length", "column_index"]
    old = P.profile(lines.where("l_returnflag = 'A'").drop("l_partkey"), "lineitem").withColumn("st_oid", F.lit(7).cast("bigint"))
    new = P.profile(lines.where("l_returnflag <> 'A'").drop("l_linestatus"), "lineitem").withColumn("st_oid", F.lit(7).cast("bigint"))
    stored = old.select(*shape[:5], F.lit("kept").alias("label"), "column_index")
    return P.upsert_profile(stored, new.select(*shape))


_DONE = _profile_sql("orders", {c: t for c, t in _ORDER_COLUMNS.items() if c != "o_custkey"})
_OPEN = _profile_sql("orders", {c: "o_orderpriority[3:]" if c == "o_orderpriority" else t for c, t in _ORDER_COLUMNS.items() if c != "o_orderkey"})


@query(
    "profile_drift",
    f"""with old as ({_DONE}), new as ({_OPEN})
       select 'orders' as table_name, coalesce(old.name, new.name) as name,
              case when old.name is null then 'added' when new.name is null then 'removed' else 'length' end as drift,
              old.min_length as old_min_length, old.max_length as old_max_length,
              new.min_length as new_min_length, new.max_length as new_max_length
       from old full join new on old.name = new.name
       where old.name is null or new.name is null or old.min_length <> new.min_length or old.max_length <> new.max_length""",
)
def profile_drift(spark, sf):
    """All orders before and after: one column is gone, one is new, and priorities lost their number."""
    orders = _whole(spark, sf, "orders")
    before = P.profile(orders.drop("o_custkey"), "orders")
    after = P.profile(orders.withColumn("o_orderpriority", F.expr("substring(o_orderpriority, 3)")).drop("o_orderkey"), "orders")
    return P.profile_drift(before, after)


@query(
    "profile_finish",
    with_tables(
        "manifest",
        """counts as (select st_oid, max(n) as n from (
                   select l_orderkey + 1 as st_oid, l_returnflag, count(*) as n from lineitem group by all) group by st_oid)
           select m.st_oid, if(c.n is null, m.analyze_table, false) as analyze_table,
                  cast(coalesce(c.n, m.record_count) as int) as record_count
           from manifest m left join counts c on m.st_oid = c.st_oid""",
    ),
)
def profile_finish(spark, sf):
    counts = given(spark, sf, "lineitem").groupBy((F.col("l_orderkey") + 1).alias("st_oid"), "l_returnflag").agg(
        F.count(F.lit(1)).alias("record_count")
    )
    return P.finish_profile(derived(spark, sf, "manifest"), counts).select("st_oid", "analyze_table", "record_count")


@query(
    "profile_ids",
    with_tables(
        "manifest columns",
        """both_runs as (select run_id, st_oid, file_name, table_name from manifest
                         union all select run_id + 1000000, st_oid + 1000000000, file_name, table_name from manifest)
           select b.run_id, b.file_name, b.table_name, b.st_oid, c.name, c.max_length
           from both_runs b join columns c on b.st_oid % 1000000000 = c.st_oid""",
    ),
)
def profile_ids(spark, sf):
    """Profiles of a manifest and of its copy in later runs, which has the same files and tables."""
    first = derived(spark, sf, "manifest").select("run_id", "st_oid", "file_name", "table_name")
    manifest = first.unionByName(first.withColumns({"run_id": F.col("run_id") + 1_000_000, "st_oid": F.col("st_oid") + 1_000_000_000}))
    columns = derived(spark, sf, "columns").select(F.col("st_oid").alias("_id"), "name", "max_length")
    found = manifest.join(columns, F.col("st_oid") % 1_000_000_000 == F.col("_id")).drop("st_oid", "_id")
    return P.attach_table_ids(found, manifest).select("run_id", "file_name", "table_name", "st_oid", "name", "max_length")


@query(
    "repeated_names",
    """select p_brand as table_name, p_name as name, count(*) as frequency from part group by all having count(*) > 1""",
)
def repeated_names(spark, sf):
    columns = given(spark, sf, "part").select(F.col("p_brand").alias("table_name"), F.col("p_name").alias("name"))
    return P.repeated_names(columns)


@query(
    "suffix_repeats",
    """select p_partkey as column_index, p_brand as table_name,
              case when count(*) over (partition by p_brand, p_name) > 1
                   then p_name || '_' || row_number() over (partition by p_brand, p_name order by p_partkey desc)
                   else p_name end as name
       from part""",
)
def suffix_repeats(spark, sf):
    columns = given(spark, sf, "part").select(
        F.col("p_brand").alias("table_name"), F.col("p_name").alias("name"), F.col("p_partkey").alias("column_index")
    )
    return P.suffix_repeats(columns, "column_index")


@query(
    "key_density",
    " union all ".join(
        f"""select '{t}' as table_name, cast(coalesce(max({k}), -1) as bigint) as max_key,
            cast(coalesce(min({k}), -1) as bigint) as min_key, count(*) as source_count,
            coalesce(max({k}), -1) <> -1 and coalesce(max({k}), -1) - coalesce(min({k}), -1) + 1 = count(*) as dense
            from {t}"""
        for t, k in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("labels", "doc_id"), ("events", "event_id"))
    ),
)
def key_density(spark, sf):
    keys = {"orders": "o_orderkey", "lineitem": "l_orderkey", "labels": "doc_id", "events": "event_id"}
    return P.union_profiles(
        [P.key_range(given(spark, sf, t), k).withColumn("table_name", F.lit(t)) for t, k in keys.items()]
    )


@query(
    "typed_rows",
    """select cast(o_orderkey as varchar) as O_ORDERKEY, cast(o_custkey as varchar) as O_CUSTKEY,
              o_orderstatus as O_ORDERSTATUS, cast(cast(o_totalprice as decimal(18,2)) as varchar) as O_TOTALPRICE,
              strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as O_ORDERDATE, o_orderpriority as O_ORDERPRIORITY
       from orders""",
)
def typed_rows(spark, sf):
    orders = given(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    return typed_as_source(orders)


@query(
    "format_values",
    """select cast(event_id as varchar) as event_id,
              regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') as ts,
              if(user_id % 3 = 0, '', if(user_id % 2 = 0, 'TRUE', 'FALSE')) as flag,
              coalesce(cast(if(user_id % 5 = 0, null, cast(value as decimal(12,2))) as varchar), '') as amount,
              strftime(ts, '%Y-%m-%d') as day, props as payload,
              regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z' as instant
       from events""",
)
def format_values(spark, sf):
    typed = given(spark, sf, "events").select(
        "event_id",
        "ts",
        F.expr("if(user_id % 3 = 0, null, user_id % 2 = 0)").alias("flag"),
        F.expr("if(user_id % 5 = 0, null, cast(value as decimal(12,2)))").alias("amount"),
        F.to_date("ts").alias("day"),
        F.encode("props", "UTF-8").alias("payload"),
        F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp").alias("instant"),
    )
    return table_as_text(typed)
