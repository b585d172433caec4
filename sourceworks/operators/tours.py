"""Euler tours of trees and their ranking, the base of pre-order numbers and of subtrees as intervals.

A tour enters a task, goes through its children in order and leaves it; the tours of a run's roots follow each other. It is
kept as a list of steps, each with the step that follows: ``2 * id`` enters a
task, ``2 * id + 1`` leaves one that has children. A step's rank is the number of tasks
entered from it to the end of its list. Ranks come from pointer jumping: a row holds a
step ahead and the tasks entered on the way there, and takes over both from that step, so
that distances double with each round; rows have the same width whatever the depth.

Steps are first put in order, and every partition follows its own steps as far as they stay in it.
Only steps to which another partition points go into the rounds, few where ids
of a tree are near each other, and at most all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceworks.operators.ordering import previous_in_groups
from sourceworks.session import cut_lineage, ship_package

STEPS_PER_TASK = 2_000_000
OPEN, AT_ROOT, AT_ORPHAN, ON_CYCLE = range(4)
LINK = "run_id bigint, step bigint, ahead bigint, entered bigint, tail bigint, state int"


def tour_steps(tasks: DataFrame) -> DataFrame:
    """The steps of the tours of tasks (run_id, pr_task_id, parent_task_id, parent_task_order): run_id, step, ahead, entered.

    Children go by order number, then id; a parent of 0 marks a root. Each task
    tells its previous sibling, or as the first child its parent, that it comes next,
    so a task hears of two others at most, however many children it has.
    """
    named = tasks.select(
        "run_id", "parent_task_id", F.struct(F.col("parent_task_order").alias("at"), F.col("pr_task_id").alias("id")).alias("place")
    )
    placed = previous_in_groups(named, ["run_id", "parent_task_id"], "place", "before")
    told = F.array(
        F.struct(F.col("place.id").alias("to"), F.col("parent_task_id").alias("parent"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("next")),
        F.struct(
            F.coalesce("before.id", "parent_task_id").alias("to"),
            F.lit(None).cast("bigint").alias("parent"),
            F.when(F.col("before").isNull(), F.col("place.id")).alias("first"),
            F.when(F.col("before").isNotNull(), F.col("place.id")).alias("next"),
        ),
    )
    heard = (
        placed.select("run_id", F.explode(told).alias("_t"))
        .select("run_id", "_t.*")
        .groupBy("run_id", "to")
        .agg(F.max("parent").alias("parent"), F.max("first").alias("first"), F.max("next").alias("next"))
        .where("parent is not null")
    )
    after = F.when(F.col("next").isNotNull(), 2 * F.col("next")).when(F.col("parent") != 0, 2 * F.col("parent") + 1)
    enter = F.struct(
        (2 * F.col("to")).alias("step"),
        F.when(F.col("first").isNotNull(), 2 * F.col("first")).otherwise(after).alias("ahead"),
        F.lit(1).cast("bigint").alias("entered"),
    )
    leave = F.struct((2 * F.col("to") + 1).alias("step"), after.alias("ahead"), F.lit(0).cast("bigint").alias("entered"))
    steps = F.when(F.col("first").isNull(), F.array(enter)).otherwise(F.array(enter, leave))
    return heard.select("run_id", F.explode(steps).alias("_s")).select("run_id", "_s.*")


def _place_of(runs: np.ndarray, steps: np.ndarray, run: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Places of (run, step) in ascending rows, -1 where there is none."""
    low = np.searchsorted(runs, run, side="left")
    end = np.searchsorted(runs, run, side="right")
    high = end.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        less = open_ & (steps[np.minimum(middle, len(steps) - 1)] < step)
        low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
    found = low < end
    found[found] = steps[low[found]] == step[found]
    return np.where(found, low, -1)


def _followed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every step of a sorted partition with the first step ahead of it that lies in another one."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    run, step, entered = (table.column(c).to_numpy().copy() for c in ("run_id", "step", "entered"))
    given = table.column("ahead").combine_chunks()
    none = given.is_null().to_numpy(zero_copy_only=False)
    ahead = given.fill_null(0).to_numpy().copy()
    to = np.where(none, -1, _place_of(run, step, run, ahead))
    last = np.arange(len(step))
    for _ in range(len(step).bit_length() + 1):
        on = np.flatnonzero(to >= 0)
        if not len(on):
            break
        target = to[on]
        entered[on] += entered[target]
        last[on], to[on] = last[target], to[target]
    state = np.where(to >= 0, ON_CYCLE, np.where(none[last], AT_ROOT, OPEN)).astype(np.int32)
    leads = pa.array(ahead[last], mask=state != OPEN)
    columns = [pa.array(run), pa.array(step), leads, pa.array(entered), pa.array(step[last]), pa.array(state)]
    for batch in pa.Table.from_arrays(columns, names=["run_id", "step", "ahead", "entered", "tail", "state"]).to_batches(100_000):
        yield batch


def _jumped(rows: DataFrame, among: DataFrame) -> DataFrame:
    """``rows`` with what the step ahead of them knows; a step that is nowhere ends the list of an orphan."""
    known = among.select(
        "run_id",
        F.col("step").alias("ahead"),
        F.col("ahead").alias("_ahead"),
        F.col("entered").alias("_entered"),
        F.col("tail").alias("_tail"),
        F.col("state").alias("_state"),
    )
    waiting = F.col("state") == OPEN
    joined = rows.join(known, ["run_id", "ahead"], "left")
    return joined.select(
        "run_id",
        "step",
        F.when(waiting, F.col("_ahead")).alias("ahead"),
        (F.col("entered") + F.when(waiting, F.coalesce("_entered", F.lit(0))).otherwise(0)).alias("entered"),
        F.when(waiting, F.coalesce("_tail", "tail")).otherwise(F.col("tail")).alias("tail"),
        F.when(waiting, F.coalesce("_state", F.lit(AT_ORPHAN))).otherwise(F.col("state")).alias("state"),
    )


def ranked_steps(steps: DataFrame, steps_per_task: int = STEPS_PER_TASK) -> DataFrame:
    """run_id, step, entered (tasks entered from the step to the end of its list), tail (its last step) and state.

    The state says where a list ends: at the last root of a run, at an orphan
    (whose parent is missing), or nowhere, as it leads to a cycle. Rounds are at most the
    binary logarithm of the steps that partitions point to.
    """
    spark = steps.sparkSession
    ship_package(spark)
    steps = cut_lineage(steps)
    parts = steps.count() // steps_per_task + 1
    order = ("run_id", "step")
    followed = steps.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_followed, LINK)
    links = cut_lineage(followed)
    if links.where(F.col("state") == OPEN).isEmpty():
        return links.select("run_id", "step", "entered", "tail", "state")
    wanted = links.where(F.col("state") == OPEN).select("run_id", F.col("ahead").alias("step")).distinct()
    core = cut_lineage(links.join(wanted, ["run_id", "step"], "left_semi"))
    for _ in range(core.count().bit_length() + 1):
        waiting = core.where(F.col("state") == OPEN)
        if waiting.isEmpty():
            break
        settled = core.where(F.col("state") != OPEN)  # stays as it is, and is not dealt again
        core = cut_lineage(_jumped(waiting, core).unionByName(settled))
    core = core.withColumn("state", F.when(F.col("state") == OPEN, ON_CYCLE).otherwise(F.col("state")))
    return _jumped(links, core).select("run_id", "step", "entered", "tail", "state")


def pre_order(tasks: DataFrame) -> DataFrame:
    """(run_id, pr_task_id, task_order): numbers from 1 of all tasks that a root leads to."""
    ranked = ranked_steps(tour_steps(tasks)).where((F.col("state") == AT_ROOT) & (F.col("step") % 2 == 0))
    ranked = cut_lineage(ranked.select("run_id", F.shiftright("step", 1).alias("pr_task_id"), "entered"))
    total = ranked.groupBy("run_id").agg(F.max("entered").alias("_all"))
    number = F.col("_all") - F.col("entered") + 1
    return ranked.join(total, "run_id").select("run_id", "pr_task_id", number.alias("task_order"))


def subtree_intervals(tasks: DataFrame) -> DataFrame:
    """run_id, pr_task_id, list, at, upto, state: a task's subtree is what lies in its list from ``at`` to ``upto``.

    Places of a list ascend in pre-order (they are negative: counted from its end). Tasks on or below a cycle have no place.
    """
    ranked = ranked_steps(tour_steps(tasks))
    enters = F.when(F.col("step") % 2 == 0, F.col("entered"))
    leaves = F.when(F.col("step") % 2 != 0, F.col("entered"))
    both = ranked.groupBy("run_id", F.shiftright("step", 1).alias("pr_task_id")).agg(
        F.max(enters).alias("_enter"), F.max(leaves).alias("_leave"), F.max("tail").alias("list"), F.max("state").alias("state")
    )
    placed = F.col("state") != ON_CYCLE
    size = F.when(F.col("_leave").isNull(), 1).otherwise(F.col("_enter") - F.col("_leave"))
    return both.select(
        "run_id",
        "pr_task_id",
        "list",
        F.when(placed, -F.col("_enter")).alias("at"),
        F.when(placed, size - 1 - F.col("_enter")).alias("upto"),
        "state",
    )
