"""Queries over task trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceworks.functions import sqlfuncs
from sourceworks.operators import tree as T
from sourceworks.operators.runs import user_has_run
from sourceworks.schemas import TASK_DEFINITIONS, task_definitions
from sourcechecks.inputs import derived, given, sql, with_tables
from sourcechecks.registry import query

_DEFINITIONS = "defs as (select * from (values " + ", ".join(
    f"({i}, '{name}', '{kind}')" for i, (name, _, kind) in enumerate(TASK_DEFINITIONS, 1)
) + ") t(task_id, name, task_run_type))"


def _walk(table: str) -> str:
    """Recursive listing with paths that sort like the tasks are listed."""
    place = "lpad(cast({t}.parent_task_order as varchar), 4, '0') || lpad(cast({t}.pr_task_id as varchar), 12, '0')"
    return f"""walk as (
        select t.run_id, t.pr_task_id, {place.format(t="t")} as path from {table} t where t.parent_task_id = 0
        union all select t.run_id, t.pr_task_id, w.path || {place.format(t="t")}
        from {table} t join walk w on t.run_id = w.run_id and t.parent_task_id = w.pr_task_id)"""


@query(
    "tree_order",
    with_tables("big_tree", f"""{_walk("big_tree")}
        select run_id, pr_task_id, row_number() over (partition by run_id order by path) as task_order from walk""", True),
)
def tree_order(spark, sf):
    return T.tree_order(derived(spark, sf, "big_tree"))


_ORDERED = with_tables("tasks task_runs", f"""{_walk("tasks")}, {_DEFINITIONS},
        ranked as (select run_id, pr_task_id, row_number() over (partition by run_id order by path) as task_order from walk)
        select r.task_order, t.pr_task_id, t.run_id, t.task_id, t.task_status, t.workflow_operation,
               d.name as task_name, d.task_run_type
        from ranked r join tasks t on t.pr_task_id = r.pr_task_id join task_runs u
        on u.run_id = t.run_id and u.workflow_operation = t.workflow_operation join defs d on d.task_id = t.task_id""", True)
_ORDERED_LOAD = with_tables("tasks", f"""{_walk("tasks")},
        ranked as (select run_id, pr_task_id, row_number() over (partition by run_id order by path) as task_order from walk)
        select r.task_order, t.pr_task_id, t.run_id from ranked r join tasks t on t.pr_task_id = r.pr_task_id
        where t.workflow_operation = 'load'""", True)


@query("tasks_ordered", _ORDERED)
def tasks_ordered(spark, sf):
    listed = T.tasks_ordered(derived(spark, sf, "tasks"), task_definitions(spark), derived(spark, sf, "task_runs"))
    return listed.select(
        "task_order", "pr_task_id", "run_id", "task_id", "task_status", "workflow_operation", "task_name", "task_run_type"
    )


@query("tasks_ordered_load", _ORDERED_LOAD)
def tasks_ordered_load(spark, sf):
    listed = T.tasks_ordered(
        derived(spark, sf, "tasks"), task_definitions(spark), derived(spark, sf, "task_runs"), "load"
    )
    return listed.select("task_order", "pr_task_id", "run_id")


def _sql_tasks(spark, sf):
    sqlfuncs.register_tasks(derived(spark, sf, "tasks"), task_definitions(spark), derived(spark, sf, "task_runs"))


@query("sql_tasks_ordered", _ORDERED)
def sql_tasks_ordered(spark, sf):
    """The listing of every run by the SQL table function, with its default workflow."""
    _sql_tasks(spark, sf)
    return spark.sql(
        """select o.task_order, o.pr_task_id, o.run_id, o.task_id, o.task_status, o.workflow_operation, o.task_name, o.task_run_type
           from catalog_workflows r, lateral get_tasks_ordered(r.run_id) o"""
    )


@query("sql_tasks_ordered_load", _ORDERED_LOAD)
def sql_tasks_ordered_load(spark, sf):
    """The same for a named workflow."""
    _sql_tasks(spark, sf)
    return spark.sql(
        """select o.task_order, o.pr_task_id, o.run_id
           from catalog_workflows r, lateral get_tasks_ordered(r.run_id, workflow => 'load') o"""
    )


@query(
    "tree_descendants",
    with_tables("big_tree", """down as (
        select parent_task_id as root_id, pr_task_id from big_tree where parent_task_id between 7 and 48
        union all select d.root_id, t.pr_task_id from big_tree t join down d on t.parent_task_id = d.pr_task_id)
        select root_id, pr_task_id from down""", True),
)
def tree_descendants(spark, sf):
    tree = derived(spark, sf, "big_tree")
    return T.descendants(tree, tree.where("pr_task_id between 7 and 48").select("pr_task_id"))


# Tasks below which everything is dropped: those an error event names.
_NAMED = "select distinct event_id + 1 as pr_task_id from events where event_type = 'error'"


_WITHOUT = with_tables("tasks", f"""named as ({_NAMED}), doomed as (
        select t.pr_task_id from tasks t join named n on t.parent_task_id = n.pr_task_id
        union select t.pr_task_id from tasks t join doomed d on t.parent_task_id = d.pr_task_id)
        select pr_task_id, parent_task_id, run_id from tasks where pr_task_id not in (select pr_task_id from doomed)""", True)


@query("sql_delete_children", _WITHOUT)
def sql_delete_children(spark, sf):
    """The procedure as an SQL script over the tasks that error events name."""
    _sql_tasks(spark, sf)
    named = given(spark, sf, "events").where("event_type = 'error'").selectExpr("event_id + 1 as pr_task_id")
    named.createOrReplaceTempView("named_tasks")
    spark.sql(sqlfuncs.DELETE_RUN_TASK_CHILDREN)
    return spark.table("remaining_tasks").select("pr_task_id", "parent_task_id", "run_id")


@query("delete_subtrees", _WITHOUT)
def delete_subtrees(spark, sf):
    named = given(spark, sf, "events").where("event_type = 'error'").selectExpr("event_id + 1 as pr_task_id")
    return T.delete_subtrees(derived(spark, sf, "tasks"), named).select("pr_task_id", "parent_task_id", "run_id")


@query(
    "has_children",
    with_tables("tasks", """select pr_task_id, run_id,
        exists (select 1 from tasks c where c.run_id = t.run_id and c.parent_task_id = t.pr_task_id) as has_children
        from tasks t"""),
)
def has_children(spark, sf):
    return T.with_children_flag(derived(spark, sf, "tasks")).select("pr_task_id", "run_id", "has_children")


@query(
    "next_child",
    with_tables("tasks", """select t.pr_task_id, coalesce(max(c.parent_task_order) + 1, 1) as next_order
        from tasks t left join tasks c on c.parent_task_id = t.pr_task_id group by t.pr_task_id"""),
)
def next_child(spark, sf):
    tasks = derived(spark, sf, "tasks")
    return T.next_child_order(tasks, tasks)


@query(
    "add_tasks",
    with_tables("tasks", """asked as (select event_id, user_id + 1 as parent, event_id % 13 + 1 as task_id from events where event_type = 'signup'),
        top as (select max(pr_task_id) as m from tasks),
        last as (select parent_task_id, max(parent_task_order) as o from tasks group by all)
        select pr_task_id, run_id, task_id, task_status, parent_task_id, parent_task_order, workflow_operation from tasks
        union all select (select m from top) + row_number() over (order by a.event_id), t.run_id, a.task_id, 'Waiting', a.parent,
               cast(coalesce(l.o, 0) + row_number() over (partition by a.parent order by a.event_id) as int), t.workflow_operation
        from asked a join tasks t on t.pr_task_id = a.parent left join last l on l.parent_task_id = a.parent"""),
)
def add_tasks(spark, sf):
    asked = given(spark, sf, "events").where("event_type = 'signup'").selectExpr(
        "event_id as request_id", "user_id + 1 as pr_task_id", "event_id % 13 + 1 as task_id"
    )
    added = T.add_child_tasks(derived(spark, sf, "tasks"), asked)
    return added.select(
        "pr_task_id", "run_id", "task_id", "task_status", "parent_task_id", "parent_task_order", "workflow_operation"
    )


@query(
    "next_task",
    with_tables("tasks", f"""{_walk("tasks")}, {_DEFINITIONS},
        idle as (select * from tasks where run_id not in (select run_id from tasks where task_status in ('Scheduled', 'Running'))),
        first as (select t.run_id, min_by(t.pr_task_id, w.path) as pr_task_id from idle t
                  join walk w on w.pr_task_id = t.pr_task_id where t.task_status = 'Waiting' group by t.run_id)
        select f.run_id, f.pr_task_id, t.task_id, d.task_run_type, d.task_run_type = 'System' as goes_on
        from first f join tasks t on t.pr_task_id = f.pr_task_id join defs d on d.task_id = t.task_id""", True),
)
def next_task(spark, sf):
    return T.next_tasks(derived(spark, sf, "tasks"), task_definitions(spark))


@query(
    "next_task_workflow",
    with_tables("tasks task_runs", f"""{_walk("tasks")},
        first as (select t.run_id, min_by(t.pr_task_id, w.path) as pr_task_id from tasks t
                  join walk w on w.pr_task_id = t.pr_task_id join task_runs r
                  on r.run_id = t.run_id and r.workflow_operation = t.workflow_operation
                  where t.task_status = 'Waiting'
                  and t.run_id not in (select run_id from tasks where task_status in ('Scheduled', 'Running')) group by t.run_id)
        select run_id, pr_task_id from first""", True),
)
def next_task_workflow(spark, sf):
    chosen = T.next_tasks(derived(spark, sf, "tasks"), task_definitions(spark), derived(spark, sf, "task_runs"))
    return chosen.select("run_id", "pr_task_id")


# Resets: every click event asks for the task with its number, as its user.
_RESETS = """asked as (select user_id as user_oid, event_id + 1 as pr_task_id from events where event_type = 'click'),
    owned as (select distinct a.pr_task_id from asked a join tasks t on t.pr_task_id = a.pr_task_id
              join users u on u.user_oid = a.user_oid join task_runs r on r.run_id = t.run_id
              where t.task_status <> 'Waiting' and (list_contains(u.roles, 'admin')
                    or a.user_oid in (r.collection_user_oid, r.load_user_oid, r.check_user_oid, r.qa_user_oid)))"""


@query(
    "reset_rows",
    with_tables("tasks users task_runs", f"""{_RESETS}, doomed as (
        select t.pr_task_id from tasks t join owned n on t.parent_task_id = n.pr_task_id
        union select t.pr_task_id from tasks t join doomed d on t.parent_task_id = d.pr_task_id)
        select t.pr_task_id, t.run_id, if(o.pr_task_id is null, t.task_status, 'Waiting') as task_status,
               if(o.pr_task_id is null, t.task_start, null) as task_start,
               if(o.pr_task_id is null, t.task_message, null) as task_message
        from tasks t left join owned o on o.pr_task_id = t.pr_task_id
        where t.pr_task_id not in (select pr_task_id from doomed)""", True),
)
def reset_rows(spark, sf):
    tasks = derived(spark, sf, "tasks")
    asked = given(spark, sf, "events").where("event_type = 'click'").selectExpr(
        "user_id as user_oid", "event_id + 1 as pr_task_id"
    )
    pairs = asked.join(tasks.select("pr_task_id", "run_id"), "pr_task_id").select("user_oid", "run_id").distinct()
    allowed = user_has_run(pairs, derived(spark, sf, "users"), derived(spark, sf, "task_runs")).where("has_run")
    reset = T.reset_tasks(tasks, asked, allowed)
    return reset.select("pr_task_id", "run_id", "task_status", "task_start", "task_message")



# Chains of up to 1,500 tasks, each the only child of the one before.
_CHAINS = """select cast(floor(o_orderkey / 1500) as bigint) as run_id, o_orderkey + 1 as pr_task_id,
        if(o_orderkey % 1500 = 0, 0, o_orderkey) as parent_task_id, 1 as parent_task_order from {orders}"""


@query(
    "deep_tree_order",
    f"""with chains as ({_CHAINS.format(orders="orders")}),
            top as (select run_id, pr_task_id, parent_task_id,
                    sum(if(parent_task_id = 0 or parent_task_id not in (select pr_task_id from chains), 1, 0))
                    over (partition by run_id order by pr_task_id) as piece from chains),
            rooted as (select run_id, piece from top group by all having bool_or(parent_task_id = 0))
        select t.run_id, t.pr_task_id, row_number() over (partition by t.run_id order by t.pr_task_id) as task_order
        from top t join rooted r on r.run_id = t.run_id and r.piece = t.piece""",
)
def deep_tree_order(spark, sf):
    return T.tree_order(sql(spark, sf, _CHAINS))


@query(
    "one_chain_order",
    "select cast(0 as bigint) as run_id, o_orderkey + 1 as pr_task_id, row_number() over (order by o_orderkey) as task_order from orders",
)
def one_chain_order(spark, sf):
    """All orders as one chain, each task the only child of the one before."""
    return T.tree_order(
        sql(spark, sf, "select 0L as run_id, o_orderkey + 1 as pr_task_id, o_orderkey as parent_task_id, 1 as parent_task_order from {orders}")
    )


@query(
    "shuffled_chain_order",
    """select cast(0 as bigint) as run_id, (o_orderkey * 7919) % 1000003 + 1 as pr_task_id, row_number() over (order by o_orderkey) as task_order
       from orders where o_orderkey < 1000003""",
)
def shuffled_chain_order(spark, sf):
    """The same chain under ids without any order, so that neighbours lie in different partitions."""
    return T.tree_order(
        sql(
            spark, sf,
            """select 0L as run_id, (o_orderkey * 7919) % 1000003 + 1 as pr_task_id,
                      if(o_orderkey = 0, 0, ((o_orderkey - 1) * 7919) % 1000003 + 1) as parent_task_id, 1 as parent_task_order
               from {orders} where o_orderkey < 1000003""",
        )
    )
