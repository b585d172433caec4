"""Catalog-shaped tables derived from the given tables, for Spark and for DuckDB.

Each entry holds the same table twice: as Spark SQL and as DuckDB SQL. They cover
the whole given table, so the work of a query grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_TABLES: dict[str, tuple[str, str]] = {}


def _table(name: str, spark: str, duck: str) -> None:
    _TABLES[name] = (spark, duck)


# People: every customer.
_table(
    "users",
    """select c_custkey as user_oid, c_name as name, lower(replace(c_name, '#', '_')) as username,
              case when c_custkey % 50 = 0 then array('admin', lower(c_mktsegment))
                   else array(lower(c_mktsegment), 'load') end as roles
       from {customer}""",
    """select c_custkey as user_oid, c_name as name, lower(replace(c_name, '#', '_')) as username,
              case when c_custkey % 50 = 0 then ['admin', lower(c_mktsegment)]
                   else [lower(c_mktsegment), 'load'] end as roles
       from customer""",
)

# Data sources: every customer.
_table(
    "sources",
    """select c_custkey as ds_id, concat('DS', c_custkey) as code,
              concat('/data/', lower(c_mktsegment)) as files_location,
              cast(c_nationkey + 1 as bigint) as collection_pipeline,
              cast(c_nationkey + 101 as bigint) as load_pipeline,
              cast(if(c_custkey % 2 = 0, null, c_nationkey + 201) as bigint) as check_pipeline,
              cast(c_nationkey + 301 as bigint) as qa_pipeline
       from {customer}""",
    """select c_custkey as ds_id, concat('DS', c_custkey) as code,
              concat('/data/', lower(c_mktsegment)) as files_location,
              cast(c_nationkey + 1 as bigint) as collection_pipeline,
              cast(c_nationkey + 101 as bigint) as load_pipeline,
              cast(if(c_custkey % 2 = 0, null, c_nationkey + 201) as bigint) as check_pipeline,
              cast(c_nationkey + 301 as bigint) as qa_pipeline
       from customer""",
)

# Runs: every order, its customer as the data source.
_table(
    "runs",
    """select o_orderkey as run_id, o_custkey as ds_id, cast(o_orderdate as date) as record_date,
              if(o_orderkey % 3 = 0, null, o_custkey) as collection_user_oid,
              if(o_orderkey % 5 = 0, null, o_custkey div 2) as load_user_oid,
              o_custkey div 3 as check_user_oid,
              if(o_orderkey % 2 = 0, null, o_custkey div 4) as qa_user_oid,
              array('collection', 'load', 'check', 'qa')[cast((o_orderkey div 2) % 4 as int)] as workflow_operation,
              if(o_orderstatus = 'O', 'Ready', 'Active') as operation_state,
              cast(o_orderkey % 1000 as int) as staging_count
       from {orders}""",
    """select o_orderkey as run_id, o_custkey as ds_id, cast(o_orderdate as date) as record_date,
              if(o_orderkey % 3 = 0, null, o_custkey) as collection_user_oid,
              if(o_orderkey % 5 = 0, null, o_custkey // 2) as load_user_oid,
              o_custkey // 3 as check_user_oid,
              if(o_orderkey % 2 = 0, null, o_custkey // 4) as qa_user_oid,
              ['collection', 'load', 'check', 'qa'][(o_orderkey // 2) % 4 + 1] as workflow_operation,
              if(o_orderstatus = 'O', 'Ready', 'Active') as operation_state,
              cast(o_orderkey % 1000 as int) as staging_count
       from orders""",
)

# Manifest: every order is a table of its customer's run.
_table(
    "manifest",
    """select o_orderkey + 1 as st_oid, o_custkey as run_id, concat('T_', o_orderkey) as table_name,
              concat('f', o_orderkey % 2, '.', array('csv', 'XLSX', 'mdb', 'dat')[cast(o_orderkey % 4 as int)]) as file_name,
              o_orderstatus <> 'F' as analyze_table, o_orderkey % 3 <> 0 as load, o_orderkey % 2 = 0 as qualified,
              'utf8' as encoding, if(o_orderkey % 3 = 0, null, concat('Sheet', o_orderkey % 7)) as sub_table,
              cast(0 as int) as record_count,
              if(o_orderpriority = '5-LOW', null, concat('F', o_orderkey)) as file_id,
              case o_orderkey % 4 when 0 then concat('https://host/ARCGIS/rest/services/', o_orderkey % 100)
                   when 1 then concat('https://host/a', o_orderkey % 100, '.zip')
                   when 2 then concat('https://host/b', o_orderkey % 100, '.txt') end as url,
              if(o_orderkey % 11 = 0, '  ', null) as comments,
              array('Download', 'FOI', 'Email', 'Scrape', 'Collect', 'REST')[cast((o_orderkey div 3) % 6 as int)] as collect_type,
              'Flat' as loader_type,
              array(null, ';', '|', ',')[cast(o_orderkey % 4 as int)] as delimiter
       from {orders}""",
    """select o_orderkey + 1 as st_oid, o_custkey as run_id, concat('T_', o_orderkey) as table_name,
              concat('f', o_orderkey % 2, '.', ['csv', 'XLSX', 'mdb', 'dat'][o_orderkey % 4 + 1]) as file_name,
              o_orderstatus <> 'F' as analyze_table, o_orderkey % 3 <> 0 as load, o_orderkey % 2 = 0 as qualified,
              'utf8' as encoding, if(o_orderkey % 3 = 0, null, concat('Sheet', o_orderkey % 7)) as sub_table,
              cast(0 as int) as record_count,
              if(o_orderpriority = '5-LOW', null, concat('F', o_orderkey)) as file_id,
              case o_orderkey % 4 when 0 then concat('https://host/ARCGIS/rest/services/', o_orderkey % 100)
                   when 1 then concat('https://host/a', o_orderkey % 100, '.zip')
                   when 2 then concat('https://host/b', o_orderkey % 100, '.txt') end as url,
              if(o_orderkey % 11 = 0, '  ', null) as comments,
              ['Download', 'FOI', 'Email', 'Scrape', 'Collect', 'REST'][(o_orderkey // 3) % 6 + 1] as collect_type,
              'Flat' as loader_type,
              [null, ';', '|', ','][o_orderkey % 4 + 1] as delimiter
       from orders""",
)

# Column profile: every line of an order is a column of its table.
_table(
    "columns",
    """select l_orderkey + 1 as st_oid, concat('COL_', l_linenumber) as name, 'VARCHAR' as type,
              cast(max(l_quantity) as int) as max_length, cast(min(l_quantity) as int) as min_length,
              l_linenumber as column_index
       from {lineitem} group by l_orderkey, l_linenumber""",
    """select l_orderkey + 1 as st_oid, concat('COL_', l_linenumber) as name, 'VARCHAR' as type,
              cast(max(l_quantity) as int) as max_length, cast(min(l_quantity) as int) as min_length,
              l_linenumber as column_index
       from lineitem group by l_orderkey, l_linenumber""",
)

# Six big trees over all orders: the parent of node n is n div 7.
_table(
    "big_tree",
    """select o_orderkey + 1 as pr_task_id, (o_orderkey + 1) div 7 as parent_task_id,
              cast((o_orderkey + 1) % 7 as int) as parent_task_order,
              cast(substring(conv(o_orderkey + 1, 10, 7), 1, 1) as bigint) as run_id
       from {orders}""",
    """with recursive up as (
           select o_orderkey + 1 as pr_task_id, o_orderkey + 1 as top from orders
           union all select pr_task_id, top // 7 from up where top >= 7)
       select pr_task_id, pr_task_id // 7 as parent_task_id, cast(pr_task_id % 7 as int) as parent_task_order,
              top as run_id
       from up where top < 7""",
)

# Many small trees: 50 orders each, the parent of the k-th one is the (k div 3)-th.
_TASKS = """select o_orderkey + 1 as pr_task_id, o_orderkey {div} 50 as run_id,
              if(o_orderkey % 50 < 2, 0, (o_orderkey {div} 50) * 50 + (o_orderkey % 50 + 1) {div} 3) as parent_task_id,
              cast((o_orderkey % 50 + 1) % 3 as int) as parent_task_order,
              o_orderkey % 13 + 1 as task_id,
              case when o_orderkey % 97 = 0 then 'Running' when o_orderstatus = 'F' then 'Complete'
                   else 'Waiting' end as task_status,
              o_orderdate as task_start, if(o_orderstatus = 'F', o_orderdate, null) as task_completed,
              if(o_orderkey % 7 = 0, concat('note ', o_orderkey), null) as task_message,
              cast(null as {text}) as task_stack_trace,
              if(o_orderkey % 4 = 0, 'load', 'collection') as workflow_operation
       from {orders}"""
_table(
    "tasks",
    _TASKS.replace("{div}", "div").replace("{text}", "string"),
    _TASKS.replace("{div}", "//").replace("{text}", "varchar").replace("{orders}", "orders"),
)
_TASK_RUNS = """select o_orderkey {div} 50 as run_id, min(o_custkey) as collection_user_oid,
              max(o_custkey) as load_user_oid, cast(null as bigint) as check_user_oid,
              min(o_custkey) + 1 as qa_user_oid,
              if((o_orderkey {div} 50) % 2 = 0, 'load', 'collection') as workflow_operation
       from {orders} group by o_orderkey {div} 50"""
_table(
    "task_runs",
    _TASK_RUNS.replace("{div}", "div"),
    _TASK_RUNS.replace("{div}", "//").replace("{orders}", "orders"),
)


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL in which ``{orders}`` and so on are the given tables."""
    used = {t: given(spark, sf_dir, t) for t in GIVEN if "{" + t + "}" in text}
    return spark.sql(text, **used)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table in Spark."""
    return sql(spark, sf_dir, _TABLES[name][0])


def with_tables(names: str, body: str, recursive: bool = False) -> str:
    """DuckDB SQL with derived tables in front of ``body``."""
    parts = ", ".join(f"{n} as ({_TABLES[n][1]})" for n in names.split())
    return f"with {'recursive ' if recursive else ''}{parts}{', ' if not body.lstrip().lower().startswith('select') else ' '}{body}"
