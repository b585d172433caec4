"""The run ledger: enrichment, ownership, previous runs, claims, templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceworks.functions.names import contains_ignore_case, id_sort_key
from sourceworks.functions.values import joined
from sourceworks.operators.ordering import previous_in_groups
from sourceworks.schemas import WORKFLOWS

ADMIN = "admin"
OWNER_COLUMNS = [f"{w}_user_oid" for w in WORKFLOWS]


def _workflow_column(workflow: Column, suffix: str) -> Column:
    """The column of a row's own workflow, such as ``load_pipeline``; null for other workflows."""
    value = None
    for name in WORKFLOWS:
        column = F.col(f"{name}{suffix}")
        value = F.when(workflow == name, column) if value is None else value.when(workflow == name, column)
    return value


def enrich_runs(runs: DataFrame, sources: DataFrame, users: DataFrame) -> DataFrame:
    """Runs with their source and the names of their four owners.

    Owners meet the users in one join, without the runs' empty places.
    """
    owners = runs.select("run_id", F.explode(F.array(*[F.struct(F.lit(w).alias("workflow"), F.col(f"{w}_user_oid").alias("user_oid")) for w in WORKFLOWS])).alias("_o"))
    named = owners.select("run_id", "_o.*").where("user_oid is not null").join(users.select("user_oid", "name"), "user_oid")
    names = named.groupBy("run_id").agg(*[F.max(F.when(F.col("workflow") == w, F.col("name"))).alias(f"{w}_user") for w in WORKFLOWS])
    enriched = runs.join(sources.select("ds_id", F.col("code").alias("ds_code"), "files_location"), "ds_id").join(names, "run_id", "left")
    return enriched.select(
        "run_id", "ds_id", "ds_code", "files_location",
        F.date_format("record_date", "yyyy-MM-dd").alias("record_date"),
        "workflow_operation", "operation_state",
        *[f"{w}_user" for w in WORKFLOWS],
        *[c for c in runs.columns if c not in {"run_id", "ds_id", "record_date", "workflow_operation",
                                               "operation_state", *OWNER_COLUMNS}],
    )


def my_runs(runs: DataFrame, user_oid: int, workflow: str) -> DataFrame:
    """Runs of a workflow that are this user's or nobody's."""
    if workflow not in WORKFLOWS:
        raise ValueError(f"workflow must be one of {', '.join(WORKFLOWS)}")
    owner = F.coalesce(F.col(f"{workflow}_user_oid"), F.lit(user_oid))
    return runs.where((F.col("workflow_operation") == workflow) & (owner == user_oid))


def for_roles(table: DataFrame, roles: Sequence[str], column: str = "role") -> DataFrame:
    """Rows open to any of the roles; an admin sees every row."""
    if ADMIN in roles:
        return table
    return table.where(F.col(column).isin(list(roles)))


def user_operations(operations: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Workflow operations open to the roles, in workflow order."""
    return for_roles(operations, roles).orderBy("workflow_order").select("name", "href")


def user_actions(actions: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Actions open to the roles."""
    return for_roles(actions, roles).select("name", "description", "href")


def user_has_run(requests: DataFrame, users: DataFrame, runs: DataFrame) -> DataFrame:
    """For each (user_oid, run_id) whether the user is an admin or one of the four owners."""
    admin = users.select("user_oid", F.array_contains("roles", ADMIN).alias("_admin"))
    owners = runs.select("run_id", F.array(*OWNER_COLUMNS).alias("_owners"))
    judged = requests.join(admin, "user_oid", "left").join(owners, "run_id", "left")
    owned = F.array_contains("_owners", F.col("user_oid"))
    has = F.coalesce("_admin", F.lit(False)) | F.coalesce(owned, F.lit(False))
    return judged.select(*requests.columns, has.alias("has_run"))


def list_users(users: DataFrame) -> DataFrame:
    """Users with their roles as text and whether they may be edited."""
    return users.select(
        "user_oid",
        "name",
        "username",
        joined(F.col("roles")).alias("roles"),
        (~F.array_contains("roles", ADMIN)).alias("can_edit"),
    )


def lookup(table: DataFrame, column: str, value) -> DataFrame:
    """Rows with this key."""
    return table.where(F.col(column) == value)


def has_rows(table: DataFrame) -> bool:
    """Whether there is any row; reads no more than it needs to find one."""
    return not table.isEmpty()


def first_row(table: DataFrame, *order: str) -> DataFrame:
    """The first row in the given order, as a DataFrame of at most one row."""
    return (table.orderBy(*order) if order else table).limit(1)


def jobs_with_status(documents: DataFrame, status: str) -> DataFrame:
    """P10: job documents with a status, their nested task reference as columns."""
    return documents.where(F.col("status") == status).select(
        "id",
        "status",
        F.col("settings.name").alias("job_name"),
        F.col("settings.properties.runId").alias("run_id"),
        F.col("settings.properties.pipelineRunTaskId").alias("pr_task_id"),
        F.col("settings.properties.runNext").alias("run_next"),
        F.col("progress.step").alias("step"),
    )


def check_row_shape(df: DataFrame, expected) -> DataFrame:
    """The same rows under ``expected``, a schema with as many columns in the same places."""
    if len(df.columns) != len(expected.fields):
        raise ValueError(f"expected {len(expected.fields)} columns, got {len(df.columns)}")
    return df.toDF(*[f.name for f in expected.fields]).to(expected)


def has_null_item(items: Column) -> Column:
    """Whether an array holds a null item."""
    return F.exists(items, lambda item: item.isNull())


def search_text(df: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the term in any displayed column, ignoring case.

    Columns are searched one by one, so a term cannot match across two of them.
    """
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(contains_ignore_case(F.col(name).cast("string"), term), F.lit(False))
    return df.where(found)


def task_details(tasks: DataFrame, definitions: DataFrame) -> DataFrame:
    """Task rows with their definition."""
    described = definitions.select("task_id", "name", "description", "state", "task_run_type")
    return tasks.join(described, "task_id")


def previous_runs(runs: DataFrame) -> DataFrame:
    """For every run the run before it of the same source, null for the first."""
    return previous_in_groups(runs.select("run_id", "ds_id"), ["ds_id"], "run_id", "previous_run_id")


def last_run(runs: DataFrame, ds_id: int) -> DataFrame:
    """The second newest run of a source."""
    siblings = runs.where(F.col("ds_id") == ds_id).select("run_id")
    return siblings.orderBy(F.desc("run_id")).offset(1).limit(1)


def natural_sort(df: DataFrame, id_column: str, ascending: bool = True) -> DataFrame:
    """T5: order by the number in an id, equal numbers by the text of the id."""
    key = id_sort_key(F.col(id_column))
    return df.orderBy(key.asc() if ascending else key.desc(), F.col(id_column))


def claim_runs(runs: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hand ready runs to users for the workflow the runs are in.

    ``claims`` has (claim_id, run_id, user_oid). The first claim (least claim_id) of a
    ready run gets it. Returns the new runs and the claims that got none.
    """
    first = claims.groupBy("run_id").agg(F.min(F.struct("claim_id", "user_oid")).alias("_first"))
    asked = first.select("run_id", F.col("_first.claim_id").alias("_claim"), F.col("_first.user_oid").alias("_user"))
    taken = F.col("_claim").isNotNull() & (F.col("operation_state") == "Ready")
    changed = {"operation_state": F.when(taken, "Active").otherwise(F.col("operation_state"))}
    for workflow in WORKFLOWS:
        owner = F.col(f"{workflow}_user_oid")
        mine = taken & (F.col("workflow_operation") == workflow)
        changed[f"{workflow}_user_oid"] = F.when(mine, F.col("_user")).otherwise(owner)
    updated = runs.join(asked, "run_id", "left").withColumns(changed).select(*runs.columns)
    ready = runs.where("operation_state = 'Ready'").select("run_id")
    won = asked.join(ready, "run_id", "left_semi").select(F.col("_claim").alias("claim_id"))
    return updated, claims.join(won, "claim_id", "left_anti")


def template_of_run(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Template id of each run, chosen from its source by the run's workflow."""
    templates = sources.select("ds_id", *[f"{w}_pipeline" for w in WORKFLOWS])
    chosen = _workflow_column(F.col("workflow_operation"), "_pipeline")
    return runs.join(templates, "ds_id").select("run_id", "workflow_operation", chosen.alias("pipeline_id"))


def activated_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Runs that went from Ready to Active between two states of the run table."""
    was_ready = before.where("operation_state = 'Ready'").select("run_id")
    return after.where("operation_state = 'Active'").join(was_ready, "run_id", "left_semi")


def instantiate_templates(
    activated: DataFrame, sources: DataFrame, templates: DataFrame, template_tasks: DataFrame
) -> DataFrame:
    """Task rows of newly active runs, copied from their template.

    Parents are template positions, as in the template; ids are handed out by
    the writer.
    """
    known = templates.select("pipeline_id")
    steps = template_tasks.select("pipeline_id", "task_id", "parent_task", "parent_task_order")
    return (
        template_of_run(activated, sources)
        .join(known, "pipeline_id", "left_semi")
        .join(steps, "pipeline_id")
        .select(
            "run_id",
            "task_id",
            F.lit("Waiting").alias("task_status"),
            F.col("parent_task").alias("parent_task_id"),
            "parent_task_order",
            "workflow_operation",
        )
    )


def template_steps(templates: DataFrame, definitions: DataFrame, names: DataFrame) -> DataFrame:
    """Template rows from ordered name lists.

    ``names`` has (template, names array); each list item becomes a root step
    whose order is its place in the list. Unknown names drop out.
    """
    items = names.select("template", F.posexplode("names").alias("_at", "task_name"))
    known = definitions.select("task_id", F.col("name").alias("task_name"))
    return (
        items.join(templates.select("pipeline_id", F.col("name").alias("template")), "template")
        .join(known, "task_name")
        .select(
            "pipeline_id",
            "task_id",
            F.lit(0).cast("bigint").alias("parent_task"),
            (F.col("_at") + 1).alias("parent_task_order"),
        )
    )


def label_counts(rows: DataFrame, run: str, label: str) -> DataFrame:
    """Number of rows per run and label, one row for each pair."""
    return rows.groupBy(run, label).agg(F.count(F.lit(1)).cast("int").alias("label_rows"))


def label_maps(counts: DataFrame, run: str, label: str, labels: Sequence[str]) -> DataFrame:
    """Per run a map label -> number of rows for a declared set of labels, also as JSON text.

    Labels are in order; a label without rows has no entry, other labels are left to ``label_counts``.
    """
    sums = [F.sum(F.when(F.col(label) == name, F.col("label_rows"))).alias(f"_{k}") for k, name in enumerate(sorted(labels))]
    entries = F.array(
        *[F.struct(F.lit(name).alias("key"), F.col(f"_{k}").cast("int").alias("value")) for k, name in enumerate(sorted(labels))]
    )
    held = F.filter(entries, lambda e: e["value"].isNotNull())
    stats = counts.groupBy(run).agg(*sums).select(run, F.map_from_entries(held).alias("plotting_stats"))
    return stats.withColumn("plotting_stats_json", F.to_json("plotting_stats"))
