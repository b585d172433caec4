"""Queries that run a stream over a given table to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceworks.schemas import task_definitions
from sourceworks.session import scratch_path
from sourceworks.streaming import feed
from sourcechecks.inputs import derived, given, with_tables
from sourcechecks.registry import query
from sourcechecks.trees import _walk


def _event_stream(spark, sf):
    schema = given(spark, sf, "events").schema
    return feed.change_stream(spark, sf, schema, "parquet", pathGlobFilter="events.parquet")


@query(
    "latest_state",
    """select user_id, max(ts) as ts, arg_max_null(event_id, ts) as event_id, arg_max_null(event_type, ts) as event_type,
              arg_max_null(props, ts) as props from events group by user_id""",
)
def latest_state(spark, sf):
    target, state = scratch_path(spark, "latest"), scratch_path(spark, "state")
    shape = (["user_id"], ["ts", "event_id"], ["event_type", "props"])
    feed.write_latest(_event_stream(spark, sf), *shape, target, state).awaitTermination()
    return feed.read_latest(spark, target, *shape)


@query(
    "live_task_lists",
    with_tables(
        "tasks task_runs",
        f"""{_walk("tasks")},
            ranked as (select run_id, pr_task_id, row_number() over (partition by run_id order by path) as task_order from walk)
            select t.run_id, r.task_order, t.pr_task_id, t.task_id from ranked r join tasks t on t.pr_task_id = r.pr_task_id
            join task_runs u on u.run_id = t.run_id and u.workflow_operation = t.workflow_operation
            where t.run_id in (select user_id from events)""",
        True,
    ),
)
def live_task_lists(spark, sf):
    """Task lists of the runs that changed, as a subscriber sees them."""
    changes = _event_stream(spark, sf).select(F.col("user_id").alias("run_id"))
    target, state = scratch_path(spark, "lists"), scratch_path(spark, "state")

    def tables():
        return derived(spark, sf, "tasks"), task_definitions(spark), derived(spark, sf, "task_runs")

    feed.relist_changed_runs(changes, tables, target, state).awaitTermination()
    return feed.current_lists(spark, target).select("run_id", "task_order", "pr_task_id", "task_id")


@query(
    "subscriber_changes",
    """select e.event_id, e.user_id as run_id, c_name as subscriber from events e
       join customer on c_custkey = e.user_id or c_custkey - 1 = e.user_id""",
)
def subscriber_changes(spark, sf):
    """Every change once per subscriber of its run; each customer follows two runs."""
    changes = _event_stream(spark, sf).select("event_id", F.col("user_id").alias("run_id"))
    runs = F.explode(F.array(F.col("c_custkey"), F.col("c_custkey") - 1)).alias("run_id")
    follows = given(spark, sf, "customer").select(runs, F.col("c_name").alias("subscriber"))
    target, state = scratch_path(spark, "sent"), scratch_path(spark, "state")
    sent = feed.for_subscribers(changes, follows).writeStream.format("parquet")
    sent.option("checkpointLocation", state).trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.parquet(target).select("event_id", "run_id", "subscriber")
