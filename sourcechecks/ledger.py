"""Queries over the run ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceworks.functions import sqlfuncs
from sourceworks.operators import changes as C
from sourceworks.operators import merge as G
from sourceworks.operators import runs as R
from sourceworks.schemas import catalog_schema, task_definitions
from sourceworks.session import cut_lineage
from sourceworks.sources.tables import append_seed, run_query
from sourcechecks.inputs import derived, given, sql, with_tables
from sourcechecks.registry import query
from sourcechecks.trees import _DEFINITIONS


@query(
    "run_enrichment",
    with_tables(
        "runs sources users",
        """select r.run_id, r.ds_id, s.code as ds_code, s.files_location, strftime(r.record_date, '%Y-%m-%d') as record_date,
                  r.workflow_operation, r.operation_state, u1.name as collection_user, u2.name as load_user,
                  u3.name as check_user, u4.name as qa_user, r.staging_count
           from runs r join sources s on r.ds_id = s.ds_id
           left join users u1 on r.collection_user_oid = u1.user_oid left join users u2 on r.load_user_oid = u2.user_oid
           left join users u3 on r.check_user_oid = u3.user_oid left join users u4 on r.qa_user_oid = u4.user_oid""",
    ),
)
def run_enrichment(spark, sf):
    return R.enrich_runs(derived(spark, sf, "runs"), derived(spark, sf, "sources"), derived(spark, sf, "users"))


@query(
    "my_runs",
    with_tables(
        "runs",
        """select run_id, 'load' as state from runs where coalesce(load_user_oid, 5) = 5 and workflow_operation = 'load'
           union all select run_id, 'qa' from runs where coalesce(qa_user_oid, 77) = 77 and workflow_operation = 'qa'""",
    ),
)
def my_runs(spark, sf):
    runs = derived(spark, sf, "runs")
    mine = [R.my_runs(runs, user, state).select("run_id", F.lit(state).alias("state")) for user, state in ((5, "load"), (77, "qa"))]
    return mine[0].unionByName(mine[1])


_ACTIONS = """select c_custkey as action_id, lower(c_mktsegment) as role, c_name as name,
                     concat('/do/', c_custkey) as href, concat('Do ', c_name) as description from {customer}"""


@query(
    "role_filter",
    f"""with a as ({_ACTIONS.format(customer="customer")})
        select 'some' as caller, name, description, href from a where role in ('machinery', 'furniture')
        union all select 'admin', name, description, href from a""",
)
def role_filter(spark, sf):
    actions = sql(spark, sf, _ACTIONS)
    some = R.user_actions(actions, ["machinery", "furniture"]).withColumn("caller", F.lit("some"))
    everything = R.user_actions(actions, ["admin", "qa"]).withColumn("caller", F.lit("admin"))
    nobody = R.user_actions(actions, []).withColumn("caller", F.lit("nobody"))
    return some.unionByName(everything).unionByName(nobody)


_OPERATIONS = """select concat('Operation ', c_custkey) as name, concat('/status/', c_custkey) as href,
        lower(c_mktsegment) as role, c_custkey as workflow_order from {customer}"""


@query(
    "user_operations",
    f"""with w as ({_OPERATIONS.format(customer="customer")})
        select name, href from w where role in ('building', 'household') order by workflow_order""",
)
def user_operations(spark, sf):
    return R.user_operations(sql(spark, sf, _OPERATIONS), ["building", "household"])


_HAS_RUN = with_tables(
        "users runs",
        """asked as (select distinct user_id as user_oid, event_id as run_id from events)
           select a.user_oid, a.run_id, coalesce(list_contains(u.roles, 'admin'), false)
                  or coalesce(a.user_oid in (r.collection_user_oid, r.load_user_oid, r.check_user_oid, r.qa_user_oid), false) as has_run
           from asked a left join users u on u.user_oid = a.user_oid left join runs r on r.run_id = a.run_id""",
    )


@query("owner_filter", _HAS_RUN)
def owner_filter(spark, sf):
    asked = given(spark, sf, "events").select(F.col("user_id").alias("user_oid"), F.col("event_id").alias("run_id")).distinct()
    return R.user_has_run(asked, derived(spark, sf, "users"), derived(spark, sf, "runs"))


@query("sql_user_has_run", _HAS_RUN)
def sql_user_has_run(spark, sf):
    """The same by the SQL function."""
    sqlfuncs.register_ownership(derived(spark, sf, "users"), derived(spark, sf, "runs"))
    given(spark, sf, "events").selectExpr("user_id as user_oid", "event_id as run_id").createOrReplaceTempView("asked_runs")
    return spark.sql("select user_oid, run_id, user_has_run(user_oid, run_id) as has_run from (select distinct * from asked_runs)")


@query(
    "user_list",
    with_tables(
        "users",
        """select user_oid, name, username, array_to_string(roles, ', ') as roles, not list_contains(roles, 'admin') as can_edit
           from users""",
    ),
)
def user_list(spark, sf):
    return R.list_users(derived(spark, sf, "users"))


@query("key_lookup", with_tables("users", "select user_oid, name from users where username = 'customer_000000042'"))
def key_lookup(spark, sf):
    return R.lookup(derived(spark, sf, "users"), "username", "customer_000000042").select("user_oid", "name")


@query("first_run", with_tables("runs", "select run_id, ds_id from runs order by record_date, run_id limit 1"))
def first_run(spark, sf):
    return R.first_row(derived(spark, sf, "runs"), "record_date", "run_id").select("run_id", "ds_id")


_JOBS = """select cast(event_id as string) as id, event_type as status,
        named_struct('id', cast(event_id as string), 'name', concat('job', event_id % 7), 'properties',
            named_struct('pipelineRunTaskId', event_id + 1, 'runId', user_id, 'runNext', event_id % 2 = 0)) as settings,
        named_struct('step', event_id % 3, 'max', cast(3 as bigint)) as progress from {events}"""


@query(
    "job_status",
    """select cast(event_id as varchar) as id, event_type as status, concat('job', event_id % 7) as job_name, user_id as run_id,
              event_id + 1 as pr_task_id, event_id % 2 = 0 as run_next, event_id % 3 as step
       from events where event_type = 'error'""",
)
def job_status(spark, sf):
    return R.jobs_with_status(sql(spark, sf, _JOBS), "error")


@query(
    "row_shape",
    """select cast(o_orderkey as varchar) as "key", cast(o_custkey as bigint) as owner, o_orderstatus as state,
              o_orderkey % 4 = 0 as null_item from orders""",
)
def row_shape(spark, sf):
    rows = sql(spark, sf, "select cast(o_orderkey as string), o_custkey, o_orderstatus, "
                          "array(o_orderstatus, if(o_orderkey % 4 = 0, null, 'x')) from {orders}")  # fmt: skip
    shape = T.StructType.fromDDL("key string, owner bigint, state string, items array<string>")
    shaped = R.check_row_shape(rows, shape)
    return shaped.select("key", "owner", "state", R.has_null_item(F.col("items")).alias("null_item"))


@query(
    "exists_check",
    """select o_orderstatus, bool_or(o_totalprice > 450000) as found from orders group by o_orderstatus""",
)
def exists_check(spark, sf):
    """For every status, whether any order of it is above a price."""
    orders = given(spark, sf, "orders")
    states = [r[0] for r in orders.select("o_orderstatus").distinct().collect()]
    found = [(s, R.has_rows(orders.where((F.col("o_orderstatus") == s) & (F.col("o_totalprice") > 450000)))) for s in states]
    return spark.createDataFrame(found, "o_orderstatus string, found boolean")


@query(
    "text_search",
    "select doc_id, lang, source from documents where contains(lower(text), 'ment') or contains(lower(source), 'ment')",
)
def text_search(spark, sf):
    return R.search_text(given(spark, sf, "documents"), "MENT", ["text", "source"]).select("doc_id", "lang", "source")


@query(
    "natural_sort",
    """select s_name, row_number() over (order by cast(regexp_replace(s_name, '[^0-9]', '', 'g') as bigint) desc, s_name) as place
       from supplier""",
)
def natural_sort(spark, sf):
    """Suppliers with their place: rows that the operator's own order leaves in earlier partitions, and before them in theirs."""
    ordered = R.natural_sort(given(spark, sf, "supplier").select("s_name"), "s_name", ascending=False)
    placed = cut_lineage(ordered.withColumn("_seq", F.monotonically_increasing_id()))
    part = F.shiftright("_seq", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    place = F.col("_before") + F.col("_seq").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("_part", part).join(before, "_part").select("s_name", place.alias("place"))


@query(
    "task_details",
    with_tables(
        "tasks",
        f"""{_DEFINITIONS} select t.pr_task_id, t.run_id, t.task_status, d.name, d.task_run_type
            from tasks t join defs d on t.task_id = d.task_id""",
    ),
)
def task_details(spark, sf):
    detailed = R.task_details(derived(spark, sf, "tasks"), task_definitions(spark))
    return detailed.select("pr_task_id", "run_id", "task_status", "name", "task_run_type")


@query(
    "previous_run",
    with_tables("runs", "select run_id, ds_id, lag(run_id) over (partition by ds_id order by run_id) as previous_run_id from runs"),
)
def previous_run(spark, sf):
    return R.previous_runs(derived(spark, sf, "runs"))


@query(
    "hot_previous_run",
    with_tables(
        "runs",
        """select run_id, if(run_id % 10 < 4, 0, ds_id) as ds_id,
                  lag(run_id) over (partition by if(run_id % 10 < 4, 0, ds_id) order by run_id) as previous_run_id from runs""",
    ),
)
def hot_previous_run(spark, sf):
    """Previous runs when one source holds two fifths of the runs."""
    runs = derived(spark, sf, "runs").withColumn("ds_id", F.expr("if(run_id % 10 < 4, 0, ds_id)"))
    return R.previous_runs(runs)


@query("last_run", with_tables("runs", "select run_id from runs where ds_id = 42 order by run_id desc limit 1 offset 1"))
def last_run(spark, sf):
    return R.last_run(derived(spark, sf, "runs"), 42)


# Claims: about three for each run that is claimed at all.
_CLAIMS = "select event_id as claim_id, cast(floor(event_id / 3) as bigint) as run_id, user_id as user_oid from {events}"
_FIRST = "first as (select run_id, min(claim_id) as claim_id, min_by(user_oid, claim_id) as user_oid from claims group by run_id)"


@query(
    "claimed_runs",
    with_tables(
        "runs",
        f"""claims as ({_CLAIMS.format(events="events")}), {_FIRST},
            j as (select r.*, c.user_oid as u, c.claim_id is not null and r.operation_state = 'Ready' as taken
                  from runs r left join first c on c.run_id = r.run_id)
            select run_id, workflow_operation, if(taken, 'Active', operation_state) as operation_state,
                   if(taken and workflow_operation = 'collection', u, collection_user_oid) as collection_user_oid,
                   if(taken and workflow_operation = 'load', u, load_user_oid) as load_user_oid,
                   if(taken and workflow_operation = 'check', u, check_user_oid) as check_user_oid,
                   if(taken and workflow_operation = 'qa', u, qa_user_oid) as qa_user_oid from j""",
    ),
)
def claimed_runs(spark, sf):
    updated, _ = R.claim_runs(derived(spark, sf, "runs"), sql(spark, sf, _CLAIMS))
    return updated.select("run_id", "workflow_operation", "operation_state", *R.OWNER_COLUMNS)


@query(
    "rejected_claims",
    with_tables(
        "runs",
        f"""claims as ({_CLAIMS.format(events="events")}), {_FIRST}
            select claim_id, run_id, user_oid from claims
            where claim_id not in (select claim_id from first where run_id in (select run_id from runs where operation_state = 'Ready'))""",
    ),
)
def rejected_claims(spark, sf):
    return R.claim_runs(derived(spark, sf, "runs"), sql(spark, sf, _CLAIMS))[1].select("claim_id", "run_id", "user_oid")


# Templates: four per nation, with one to five steps.
_TEMPLATE_TASKS = """select cast(n_nationkey + 100 * g + 1 as bigint) as pipeline_id, cast(s % 13 + 1 as bigint) as task_id,
        cast(0 as bigint) as parent_task, cast(s as int) as parent_task_order
        from {nation}, {g}, {s} where s <= n_nationkey % 5 + 1"""
_CHOSEN = """case workflow_operation when 'collection' then collection_pipeline when 'load' then load_pipeline
             when 'check' then check_pipeline when 'qa' then qa_pipeline end"""


@query(
    "run_template",
    with_tables(
        "runs sources",
        f"select r.run_id, r.workflow_operation, {_CHOSEN} as pipeline_id from runs r join sources s on r.ds_id = s.ds_id",
    ),
)
def run_template(spark, sf):
    return R.template_of_run(derived(spark, sf, "runs"), derived(spark, sf, "sources"))


_STEPS_SQL = _TEMPLATE_TASKS.format(nation="nation", g="range(0, 4) a(g)", s="range(1, 6) b(s)")


@query(
    "new_run_tasks",
    with_tables(
        "runs sources",
        f"""claims as ({_CLAIMS.format(events="events")}), {_FIRST}, steps as ({_STEPS_SQL})
            select r.run_id, t.task_id, 'Waiting' as task_status, t.parent_task as parent_task_id, t.parent_task_order, r.workflow_operation
            from runs r join first c on c.run_id = r.run_id join sources s on r.ds_id = s.ds_id
            join steps t on t.pipeline_id = {_CHOSEN} where r.operation_state = 'Ready'""",
    ),
)
def new_run_tasks(spark, sf):
    runs = derived(spark, sf, "runs")
    after, _ = R.claim_runs(runs, sql(spark, sf, _CLAIMS))
    steps = sql(spark, sf, _TEMPLATE_TASKS.replace("{g}", "explode(sequence(0, 3)) as a(g)").replace("{s}", "explode(sequence(1, 5)) as b(s)"))
    templates = steps.select("pipeline_id").distinct()
    return R.instantiate_templates(R.activated_runs(runs, after), derived(spark, sf, "sources"), templates, steps)


@query(
    "template_steps",
    f"""with {_DEFINITIONS}, lists as (select c_custkey as pipeline_id, k, case (c_custkey + k) % 4 when 0 then 'Load Files'
               when 1 then 'Scan Source Folder' when 2 then 'no such task' else 'Analyze Files' end as task_name
               from customer, range(0, 3) r(k))
        select pipeline_id, cast(task_id as bigint) as task_id, cast(0 as bigint) as parent_task, cast(k + 1 as int) as parent_task_order
        from lists join defs on defs.name = lists.task_name""",
)
def template_steps(spark, sf):
    names = sql(spark, sf, """select c_name as template, transform(sequence(0, 2), k -> element_at(array('Load Files',
        'Scan Source Folder', 'no such task', 'Analyze Files'), cast((c_custkey + k) % 4 + 1 as int))) as names from {customer}""")
    templates = given(spark, sf, "customer").selectExpr("c_custkey as pipeline_id", "c_name as name")
    return R.template_steps(templates, task_definitions(spark), names)


@query("label_rows", "select user_id, event_type, cast(count(*) as int) as label_rows from events group by all")
def label_rows(spark, sf):
    return R.label_counts(given(spark, sf, "events"), "user_id", "event_type")


_LABELS = ("click", "error", "purchase", "signup", "view")


@query(
    "label_stats",
    f"""select user_id, coalesce('{{' || string_agg('"' || event_type || '":' || n, ',' order by event_type) filter (where event_type in {_LABELS})
               || '}}', '{{}}') as plotting_stats_json
       from (select user_id, event_type, count(*) as n from events group by all) group by user_id""",
)
def label_stats(spark, sf):
    counts = R.label_counts(given(spark, sf, "events"), "user_id", "event_type")
    return R.label_maps(counts, "user_id", "event_type", _LABELS).select("user_id", "plotting_stats_json")


_SPARSE = """select event_id, user_id + 1 as pr_task_id, case event_id % 4
        when 0 then map('task_status', 'Failed', 'task_stack_trace', props) when 1 then map('task_message', cast(null as string))
        when 2 then map('task_message', event_type) else map('task_status', 'Running') end as changes from {events}"""


@query(
    "sparse_update",
    with_tables(
        "tasks",
        """last as (select user_id + 1 as id,
               arg_max_null(if(event_id % 4 = 0, 'Failed', 'Running'), event_id) filter (where event_id % 4 in (0, 3)) as status,
               arg_max_null(props, event_id) filter (where event_id % 4 = 0) as trace,
               arg_max_null(if(event_id % 4 = 1, null, event_type), event_id) filter (where event_id % 4 in (1, 2)) as message,
               bool_or(event_id % 4 in (1, 2)) as has_message from events group by all)
           select pr_task_id, coalesce(status, task_status) as task_status, if(has_message, message, task_message) as task_message,
                  coalesce(trace, task_stack_trace) as task_stack_trace, run_id
           from tasks left join last on id = pr_task_id""",
    ),
)
def sparse_update(spark, sf):
    folded = C.fold_changes(sql(spark, sf, _SPARSE), "pr_task_id", "event_id")
    updated = C.sparse_update(
        derived(spark, sf, "tasks"), folded, "pr_task_id", ["task_status", "task_start", "task_message", "task_stack_trace"]
    )
    return updated.select("pr_task_id", "task_status", "task_message", "task_stack_trace", "run_id")


@query(
    "status_update",
    with_tables(
        "tasks",
        """last as (select user_id + 1 as id, max_by(upper(event_type), event_id) as status from events group by all)
           select t.pr_task_id, coalesce(l.status, t.task_status) as task_status from tasks t left join last l on l.id = t.pr_task_id""",
    ),
)
def status_update(spark, sf):
    new = sql(spark, sf, "select user_id + 1 as pr_task_id, event_id as sequence, upper(event_type) as task_status from {events}")
    return C.set_status(derived(spark, sf, "tasks"), new, "pr_task_id").select("pr_task_id", "task_status")


@query(
    "role_difference",
    with_tables("users", "select user_oid, array_to_string(list_filter(roles, lambda r: r <> 'admin'), ',') as roles from users"),
)
def role_difference(spark, sf):
    return derived(spark, sf, "users").select("user_oid", F.array_join(C.without_item(F.col("roles"), "admin"), ",").alias("roles"))


@query("shared_keys", "select o_custkey as id from orders intersect select user_id from events")
def shared_keys(spark, sf):
    return C.shared_keys(
        given(spark, sf, "orders").select(F.col("o_custkey").alias("id")), given(spark, sf, "events").select(F.col("user_id").alias("id")), "id"
    )


@query(
    "parameter_query",
    "select o_orderkey, o_orderstatus from orders where o_orderpriority in ('1-URGENT', '5-LOW') and o_custkey < 500",
)
def parameter_query(spark, sf):
    given(spark, sf, "orders").createOrReplaceTempView("sourceworks_orders")
    return run_query(
        spark,
        """select o_orderkey, o_orderstatus from sourceworks_orders
           where o_orderpriority in (:priorities) and o_custkey < :top""",
        {"priorities": ["1-URGENT", "5-LOW"], "top": 500},
    )


@query(
    "seed_load",
    """select o_orderkey as action_id, o_orderstatus as role, o_orderpriority as name from orders
       union all select (select max(o_orderkey) from orders) + row_number() over (order by c_name), c_mktsegment, c_name from customer""",
)
def seed_load(spark, sf):
    target = given(spark, sf, "orders").selectExpr(
        "o_orderkey as action_id", "'x' as state", "o_orderstatus as role", "o_orderpriority as name",
        "'d' as description", "'h' as href",
    )
    seed = given(spark, sf, "customer").selectExpr("'*' as state", "c_mktsegment as role", "c_name as name", "'d' as description", "'h' as href")
    assert target.columns == catalog_schema("actions").names
    return append_seed(target, seed, "action_id", ["name"]).select("action_id", "role", "name")


@query("exclusive_merge", "select o_orderkey, o_custkey from orders")
def exclusive_merge(spark, sf):
    """Orders of odd years and of even ones, which have no key in common."""
    orders = given(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    return G.merge_exclusive(orders.where("year % 2 = 1"), orders.where("year % 2 = 0"), ["o_orderkey"]).drop("year")


@query(
    "intersect_merge",
    """select o_orderkey, 'first' as origin from orders where year(o_orderdate) <= 1996
       union all select o_orderkey, 'second' from orders where year(o_orderdate) >= 1995 and year(o_orderdate) > 1996""",
)
def intersect_merge(spark, sf):
    orders = given(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    first = orders.where("year <= 1996").select("o_orderkey", F.lit("first").alias("origin"))
    second = orders.where("year >= 1995").select("o_orderkey", F.lit("second").alias("origin"))
    return G.merge_intersect(first, second, ["o_orderkey"])


@query(
    "match_counts",
    """with p as (select o_custkey * 2 as k from orders),
            s as (select user_id as k from events)
       select (select count(*) from p) as production_count, (select count(*) from s) as staging_count,
              (select count(*) from s where k in (select k from p)) as match_count,
              (select count(*) from s where k not in (select k from p)) as new_count""",
)
def match_counts(spark, sf):
    production = given(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("k"))
    return G.match_counts(production, given(spark, sf, "events").select(F.col("user_id").alias("k")), ["k"])
