"""Task trees: pre-order listing, descendants, next runnable task, resets.

Trees are adjacency lists; parent 0 marks a root. Order numbers and subtrees come from
ranked Euler tours (see ``tours``). Memberships are found by jumps: every task knows an ancestor and what lies
between, and takes over from that ancestor what it knows itself, so the length of
the jumps doubles with every round and a tree of depth d takes log2 d rounds. What a
round finds is written to the checkpoint folder, so that neither the plan nor
the loss of an executor makes an earlier round run again; tasks that are done are
left out of later rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceworks.operators.ordering import number_by_sort
from sourceworks.operators.tours import ON_CYCLE, pre_order, subtree_intervals
from sourceworks.session import cut_lineage

_RANGE = 64  # places of a list


def tree_order(tasks: DataFrame) -> DataFrame:
    """(run_id, pr_task_id, task_order), the pre-order number per run from 1.

    A parent comes before its children, the children by order (then id). There is no limit to the depth,
    and no task carries a path (see ``tours``). Tasks that no root leads to are left
    out: those with a missing ancestor, and those on or below a cycle.
    """
    return pre_order(tasks)


def tasks_ordered(
    tasks: DataFrame, definitions: DataFrame, runs: DataFrame, workflow: str | None = None
) -> DataFrame:
    """Ordered tasks of runs with their definitions, limited to one workflow.

    Without ``workflow`` each run shows the tasks of its own workflow. Order
    numbers count the whole tree, so the listing may have gaps.
    """
    wanted = runs.select("run_id", (F.lit(workflow) if workflow else F.col("workflow_operation")).alias("workflow_operation"))
    described = definitions.select(
        "task_id",
        F.col("name").alias("task_name"),
        F.col("description").alias("task_description"),
        "task_run_type",
    )
    return (
        tree_order(tasks)
        .join(tasks, ["run_id", "pr_task_id"])
        .join(wanted, ["run_id", "workflow_operation"], "left_semi")
        .join(described, "task_id")
        .select("task_order", *tasks.columns, "task_name", "task_description", "task_run_type")
    )


def descendants(tasks: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, pr_task_id) for all tasks below each of the given tasks.

    The result has one row per pair; use ``subtree_members`` where the root does
    not matter. A subtree is an interval of its list (see ``tours``), cut into ranges of places; a task meets
    the intervals that reach into its range. So the rows compared exceed the pairs found by at most
    two ranges per given task, whatever the depth. A given task on a cycle is an error, found in as many
    rounds as the logarithm of the table's size; tasks below a cycle have their subtrees like others.
    """
    edges = tasks.select(F.lit(0).cast("bigint").alias("run_id"), "pr_task_id", "parent_task_id", "parent_task_order")
    placed = cut_lineage(subtree_intervals(edges))
    if not placed.where(F.col("state") == ON_CYCLE).isEmpty():
        lost = edges.join(placed.where(F.col("state") == ON_CYCLE).select("pr_task_id"), "pr_task_id", "left_semi")
        cycle = on_cycle(lost)
        if not roots.join(cycle, "pr_task_id", "left_semi").isEmpty():
            raise ValueError("a given task is on a cycle or above one")
        below = lost.join(cycle, "pr_task_id", "left_anti")  # tops now lack their parent, as orphans do
        again = subtree_intervals(below).withColumn("list", F.struct(F.lit(True).alias("below"), F.col("list").alias("tail")))
        placed = placed.where(F.col("state") != ON_CYCLE).withColumn(
            "list", F.struct(F.lit(False).alias("below"), F.col("list").alias("tail"))
        )
        placed = cut_lineage(placed.unionByName(again))
    spans = placed.join(roots.select("pr_task_id"), "pr_task_id").where("upto > at")
    ranges = F.sequence(F.expr(f"floor(at / {_RANGE})"), F.expr(f"floor(upto / {_RANGE})"))
    wanted = spans.select(
        F.col("pr_task_id").alias("root_id"), "list", F.col("at").alias("_at"), F.col("upto").alias("_upto"), F.explode(ranges).alias("_range")
    )
    ranged = placed.select("pr_task_id", "list", "at", F.expr(f"floor(at / {_RANGE})").alias("_range"))
    met = ranged.join(wanted, ["list", "_range"]).where("at > _at and at <= _upto")
    return met.select("root_id", "pr_task_id")


def on_cycle(tasks: DataFrame) -> DataFrame:
    """(pr_task_id) of the tasks on a cycle, of a table in which every task is on one or below one.

    After as many steps up as there are tasks everyone has arrived at a cycle, and every
    task of one is arrived at; steps double each round.
    """
    up = cut_lineage(tasks.select("pr_task_id", F.col("parent_task_id").alias("above")))
    for _ in range(up.count().bit_length()):
        higher = up.select(F.col("pr_task_id").alias("above"), F.col("above").alias("_above"))
        up = cut_lineage(up.join(higher, "above").select("pr_task_id", F.col("_above").alias("above")))
    return up.select(F.col("above").alias("pr_task_id")).distinct()


def subtree_members(tasks: DataFrame, roots: DataFrame) -> DataFrame:
    """(pr_task_id) of all tasks below any of the given tasks, each once.

    Jumps as for ``tree_paths``, with whether a given task was passed; a task is
    done when that is so, or at a root. Rounds end when jumps are as long as the
    table, so tasks on a cycle are judged by the tasks of their cycle.
    """
    given = roots.select(F.col("pr_task_id").alias("above")).distinct().withColumn("_given", F.lit(True))
    known = cut_lineage(
        tasks.select("pr_task_id", F.col("parent_task_id").alias("above"))
        .join(given, "above", "left")
        .select("pr_task_id", "above", F.coalesce("_given", F.lit(False)).alias("below"))
    )
    rounds = math.ceil(math.log2(max(known.count(), 2))) + 1
    found = [known.where("below")]
    for _ in range(rounds):
        waiting = known.where("not below and above <> 0")
        if waiting.isEmpty():
            break
        ancestor = known.select(F.col("pr_task_id").alias("above"), F.col("above").alias("_above"), F.col("below").alias("_below"))
        settled = known.where("below or above = 0")
        jumped = cut_lineage(
            waiting.join(ancestor, "above").select("pr_task_id", F.col("_above").alias("above"), F.col("_below").alias("below"))
        )
        found.append(jumped.where("below"))
        known = jumped.unionByName(settled)
    members = found[0]
    for more in found[1:]:
        members = members.unionByName(more)
    return members.select("pr_task_id").distinct()


def delete_subtrees(tasks: DataFrame, roots: DataFrame) -> DataFrame:
    """R2 (J9): tasks without anything below the given tasks, which stay unless they lie below another one."""
    return tasks.join(subtree_members(tasks, roots), "pr_task_id", "left_anti").select(*tasks.columns)


def with_children_flag(tasks: DataFrame) -> DataFrame:
    """Whether a task has children in its run."""
    parents = tasks.select("run_id", F.col("parent_task_id").alias("pr_task_id")).distinct()
    flagged = tasks.join(parents.withColumn("_has", F.lit(True)), ["run_id", "pr_task_id"], "left")
    return flagged.select(*tasks.columns, F.coalesce("_has", F.lit(False)).alias("has_children"))


def next_child_order(tasks: DataFrame, parents: DataFrame) -> DataFrame:
    """Order number of the next child for each given task; 1 for a leaf."""
    asked = parents.select("pr_task_id").distinct()
    children = tasks.select(F.col("parent_task_id").alias("pr_task_id"), "parent_task_order")
    last = children.join(asked, "pr_task_id", "left_semi").groupBy("pr_task_id").agg(F.max("parent_task_order").alias("_last"))
    return parents.select("pr_task_id").join(last, "pr_task_id", "left").select(
        "pr_task_id", F.coalesce(F.col("_last") + 1, F.lit(1)).alias("next_order")
    )


def add_child_tasks(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """Tasks plus one waiting child per request, placed after the existing children.

    ``requests`` has (request_id, pr_task_id, task_id); several requests for one
    parent are placed in request order. New ids go on from the greatest one. Only
    the requests are numbered, and only the children of their parents looked at.
    """
    parents = tasks.select("pr_task_id", "run_id", "workflow_operation")
    asked = requests.join(parents, "pr_task_id")
    by_id = number_by_sort(asked, [], ["request_id"], "_id")
    placed = number_by_sort(by_id, ["pr_task_id"], ["request_id"], "_nth")
    numbered = placed.join(next_child_order(tasks, requests.select("pr_task_id").distinct()), "pr_task_id")
    values = {
        "parent_task_id": F.col("pr_task_id"),
        "parent_task_order": (F.col("next_order") + F.col("_nth") - 1).cast("int"),
        "task_status": F.lit("Waiting"),
        "pr_task_id": tasks.agg(F.max("pr_task_id")).scalar() + F.col("_id"),
    }
    created = numbered.select(
        *[
            values[f.name].alias(f.name)
            if f.name in values
            else F.col(f.name)
            if f.name in ("run_id", "task_id", "workflow_operation")
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in tasks.schema.fields
        ]
    )
    return tasks.unionByName(created)


def next_tasks(tasks: DataFrame, definitions: DataFrame, workflows: DataFrame | None = None) -> DataFrame:
    """T4: the first waiting task of each run in tree order.

    Runs with a scheduled or running task give none. ``goes_on`` tells whether a
    program may start it by itself (a ``System`` task). ``workflows`` (run_id,
    workflow_operation) limits the choice to a run's current workflow. Only idle runs are numbered,
    and of the numbers only the least waiting one per run is kept.
    """
    busy = tasks.where(F.col("task_status").isin("Scheduled", "Running")).select("run_id")
    idle = cut_lineage(tasks.join(busy, "run_id", "left_anti"))
    waiting = idle.where("task_status = 'Waiting'")
    if workflows is not None:
        waiting = waiting.join(workflows, ["run_id", "workflow_operation"], "left_semi")
    first = (
        pre_order(idle.join(waiting.select("run_id").distinct(), "run_id", "left_semi"))
        .join(waiting.select("run_id", "pr_task_id", "task_id"), ["run_id", "pr_task_id"])
        .groupBy("run_id")
        .agg(F.min_by(F.struct("pr_task_id", "task_id"), "task_order").alias("_next"))
    )
    return (
        first.select("run_id", "_next.pr_task_id", "_next.task_id")
        .join(definitions.select("task_id", "task_run_type"), "task_id")
        .select(
            "run_id", "pr_task_id", "task_id", "task_run_type", (F.col("task_run_type") == "System").alias("goes_on")
        )
    )


def reset_tasks(tasks: DataFrame, requests: DataFrame, allowed: DataFrame) -> DataFrame:
    """Set tasks back to waiting and drop what hangs below them.

    ``requests`` has (user_oid, pr_task_id), ``allowed`` the (user_oid, run_id)
    pairs that may be changed; a waiting task is not reset.
    """
    owned = (
        requests.join(tasks.where("task_status != 'Waiting'").select("pr_task_id", "run_id"), "pr_task_id")
        .join(allowed, ["user_oid", "run_id"], "left_semi")
        .select("pr_task_id")
        .distinct()
    )
    kept = delete_subtrees(tasks, owned)
    marked = kept.join(owned.withColumn("_reset", F.lit(True)), "pr_task_id", "left")
    cleared = ["task_start", "task_completed", "task_message", "task_stack_trace"]
    changed = {c: F.when(F.col("_reset").isNull(), F.col(c)) for c in cleared if c in tasks.columns}
    changed["task_status"] = F.when(F.col("_reset"), "Waiting").otherwise(F.col("task_status"))
    return marked.withColumns(changed).select(*tasks.columns)
