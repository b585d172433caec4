"""SQL-callable forms: check functions, ownership, task listings, and the two procedures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceworks.operators.manifest import repair_manifest
from sourceworks.operators.tours import ON_CYCLE, pre_order, subtree_intervals
from sourceworks.session import cut_lineage

NOT_BLANK = "check_not_blank_or_empty"
ARRAY_NOT_BLANK = "check_array_not_blank_or_empty"
_RANGE = 64  # places of a list


def register(spark: SparkSession) -> None:
    """Create both checks as temporary SQL functions, which Catalyst inlines."""
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {NOT_BLANK}(value STRING) RETURNS BOOLEAN
            RETURN NOT coalesce(value, 'x') RLIKE '^\\\\s*$'"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {ARRAY_NOT_BLANK}(items ARRAY<STRING>) RETURNS BOOLEAN
            RETURN coalesce(
                size(items) > 0 AND NOT exists(items, item -> coalesce(item, 'x') RLIKE '^\\\\s*$'),
                true)"""
    )


def register_ownership(users: DataFrame, runs: DataFrame) -> None:
    """``user_has_run(user, run)``: whether the user is an admin or one of the run's four owners.

    Its two look-ups become outer joins of the query that calls it, so it can be applied to tables of any size.
    """
    spark = users.sparkSession
    users.select("user_oid", "roles").createOrReplaceTempView("catalog_users")
    runs.createOrReplaceTempView("catalog_runs")
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION user_has_run(asking BIGINT, run BIGINT) RETURNS BOOLEAN
           RETURN coalesce((SELECT max(array_contains(u.roles, 'admin')) FROM catalog_users u WHERE u.user_oid = asking), false)
               OR coalesce(array_contains((SELECT max(array(r.collection_user_oid, r.load_user_oid, r.check_user_oid, r.qa_user_oid))
                                           FROM catalog_runs r WHERE r.run_id = run), asking), false)"""
    )


def register_tasks(tasks: DataFrame, definitions: DataFrame, runs: DataFrame) -> None:
    """``get_tasks_ordered(run, workflow)``, ``get_task_children(task)`` and ``delete_run_task_children(task)``.

    Order numbers and intervals of all tasks are found once, here; the functions look them up, so a query can call them for
    any number of runs or tasks (by ``LATERAL``). Without a workflow a run shows the tasks of its own. Task ids are unique
    over all runs, as everywhere in the catalog. Tasks on or below a cycle have no children that could be listed.
    """
    spark = tasks.sparkSession
    tasks.createOrReplaceTempView("catalog_tasks")
    definitions.createOrReplaceTempView("catalog_definitions")
    runs.select("run_id", "workflow_operation").createOrReplaceTempView("catalog_workflows")
    cut_lineage(pre_order(tasks)).createOrReplaceTempView("catalog_task_order")
    placed = subtree_intervals(tasks).where(F.col("state") != ON_CYCLE)
    cut_lineage(placed.withColumn("range", F.expr(f"floor(at / {_RANGE})"))).createOrReplaceTempView("catalog_task_intervals")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tasks.schema)
    columns = ", ".join(f"t.{c}" for c in tasks.columns)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION get_tasks_ordered(run BIGINT, workflow STRING DEFAULT NULL)
            RETURNS TABLE (task_order BIGINT, {shape}, task_name STRING, task_description STRING, task_run_type STRING)
            RETURN SELECT o.task_order, {columns}, d.name, d.description, d.task_run_type
                   FROM catalog_task_order o
                   JOIN catalog_tasks t ON t.run_id = o.run_id AND t.pr_task_id = o.pr_task_id
                   JOIN catalog_workflows w ON w.run_id = t.run_id
                   JOIN catalog_definitions d ON d.task_id = t.task_id
                   WHERE o.run_id = run AND t.workflow_operation = coalesce(workflow, w.workflow_operation)"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION get_task_children(task BIGINT) RETURNS TABLE (pr_task_id BIGINT)
            RETURN SELECT m.pr_task_id
                   FROM (SELECT run_id, list, at, upto, explode(sequence(floor(at / {_RANGE}), floor(upto / {_RANGE}))) AS range
                         FROM catalog_task_intervals WHERE pr_task_id = task) s
                   JOIN catalog_task_intervals m
                   ON m.run_id = s.run_id AND m.list = s.list AND m.range = s.range AND m.at > s.at AND m.at <= s.upto"""
    )


#: The task table without anything below the tasks that the view ``named_tasks`` (pr_task_id) names, as a script. It leaves
#: them as the view ``remaining_tasks``: the rows that a script returns are collected by the driver.
DELETE_RUN_TASK_CHILDREN = """
BEGIN
    DECLARE named BIGINT DEFAULT 0;
    SET named = (SELECT count(*) FROM named_tasks);
    IF named = 0 THEN
        CREATE OR REPLACE TEMPORARY VIEW remaining_tasks AS SELECT * FROM catalog_tasks;
    ELSE
        CREATE OR REPLACE TEMPORARY VIEW remaining_tasks AS SELECT t.* FROM catalog_tasks t LEFT ANTI JOIN (
            SELECT c.pr_task_id FROM (SELECT DISTINCT pr_task_id FROM named_tasks) n, LATERAL get_task_children(n.pr_task_id) c
        ) gone ON gone.pr_task_id = t.pr_task_id;
    END IF;
END
"""


def register_repair(manifest: DataFrame, file_types: DataFrame) -> None:
    """``update_files(run)``: the manifest of a run with loaders, file ids and flags put right."""
    spark = manifest.sparkSession
    cut_lineage(repair_manifest(manifest, file_types)).createOrReplaceTempView("catalog_repaired")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in manifest.schema)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION update_files(run BIGINT) RETURNS TABLE ({shape})
            RETURN SELECT {", ".join(f"m.{c}" for c in manifest.columns)} FROM catalog_repaired m WHERE m.run_id = run"""
    )
