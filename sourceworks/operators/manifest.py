"""The manifest of a run: what is expected, what arrived, repair, carry forward."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceworks import schemas
from sourceworks.functions.names import (
    delimiter_char,
    file_extension,
    file_id,
    id_number,
    url_file_name,
)
from sourceworks.functions.values import blank_to_null
from sourceworks.operators.ordering import number_by_sort, number_in_groups

MANIFEST_VIEW = [
    "st_oid", "table_name", "file_id", "file_name", "sub_table", "delimiter", "qualified", "encoding",
    "url", "comments", "record_count", "collect_type", "analyze_table", "load",
]
CARRIED = [
    "table_name", "file_name", "loader_type", "qualified", "encoding", "sub_table", "file_id", "url",
    "comments", "collect_type", "delimiter",
]
EDITABLE = [
    "table_name", "file_id", "file_name", "sub_table", "loader_type", "delimiter", "qualified",
    "encoding", "url", "comments", "collect_type", "analyze_table", "load",
]


def run_manifest(manifest: DataFrame, run_id: int) -> DataFrame:
    """The manifest of one run."""
    return manifest.where(F.col("run_id") == run_id).select(*MANIFEST_VIEW)


def manifest_counts(runs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows per run, 0 for a run without any."""
    counts = manifest.groupBy("run_id").agg(F.count(F.lit(1)).alias("tables"))
    return runs.select("run_id").join(counts, "run_id", "left").select(
        "run_id", F.coalesce("tables", F.lit(0).cast("bigint")).alias("tables")
    )


def files_with_tables(manifest: DataFrame, flag: str | None = None) -> DataFrame:
    """A4/A5 (P8): read options of every flagged sub table, with its position in id order in its run's file.

    One row per sub table: a file may have any number of them.
    """
    chosen = manifest.where(F.col(flag)) if flag else manifest
    numbered = number_in_groups(chosen, ["run_id", "file_name"], "st_oid", "position")
    delimiter = delimiter_char(F.col("delimiter")).alias("delimiter")
    return numbered.select(
        "run_id", "file_name", "position", "st_oid", "table_name", "sub_table", delimiter, "qualified"
    )


def table_definitions(manifest: DataFrame, columns: DataFrame) -> DataFrame:
    """The text-table definition of each manifest row that has a profile.

    A definition lists the columns of one table, so its length is bounded by the table's width.
    """
    ordered = F.array_sort(F.collect_list(F.struct("column_index", "name")))
    lists = columns.groupBy("st_oid").agg(ordered.alias("_columns"))
    body = F.array_join(F.transform("_columns", lambda c: F.concat(c["name"], F.lit(" text"))), ",")
    # The words of the statement.
    definition = F.concat(F.lit("CREATE table "), "table_name", F.lit(" ("), body, F.lit(")"))
    return manifest.select("st_oid", "table_name").join(lists, "st_oid").select(
        "st_oid", "table_name", definition.alias("definition")
    )


def files_to_load(manifest: DataFrame, columns: DataFrame) -> DataFrame:
    """J10 (P8): loadable tables per run and file; tables without a profile drop out."""
    profiled = manifest.join(columns.select("st_oid"), "st_oid", "left_semi")
    return files_with_tables(profiled, "load")


def compare_files(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Per run and file name whether it is missing, extra or present.

    Both sides collapse to one row per name in a single pre-combined aggregate,
    which does the work of a full outer join; repeated names are counted, and the
    collect type comes from the expected row with the greatest id.
    """
    wanted = expected.select("run_id", "file_name", "st_oid", "collect_type", F.lit(1).alias("e"), F.lit(0).alias("f"))
    arrived = found.select("run_id", "file_name", F.lit(0).alias("e"), F.lit(1).alias("f"))
    merged = wanted.unionByName(arrived, allowMissingColumns=True).groupBy("run_id", "file_name").agg(
        F.max_by("collect_type", "st_oid").alias("collect_type"),
        F.sum("e").alias("expected_rows"),
        F.sum("f").alias("found_rows"),
    )
    status = (
        F.when(F.col("found_rows") == 0, "missing").when(F.col("expected_rows") == 0, "extra").otherwise("present")
    )
    return merged.select("run_id", "file_name", "collect_type", "expected_rows", "found_rows", status.alias("status"))


def follow_up_tasks(compared: DataFrame, scanned_before: DataFrame) -> DataFrame:
    """Tasks to add under the scan task of each run that misses files.

    A run that was scanned before and still misses files gets the single row
    ``rescan_failed`` instead.
    """
    fetchable = F.col("collect_type").isin(schemas.FETCHABLE_COLLECT_TYPES)
    per_run = (
        compared.where("status = 'missing'")
        .groupBy("run_id")
        .agg(
            F.count_if(fetchable).alias("download"),
            F.count_if(~F.coalesce(fetchable, F.lit(False))).alias("collect"),
        )
    )
    marked = per_run.join(
        scanned_before.select("run_id").distinct().withColumn("_again", F.lit(True)), "run_id", "left"
    )

    def step(task_id: int | None, outcome: str, files: Column) -> Column:
        return F.struct(
            F.lit(task_id).cast("bigint").alias("task_id"), F.lit(outcome).alias("outcome"), files.alias("files")
        )

    everything = F.col("download") + F.col("collect")
    failed = F.array(step(None, "rescan_failed", everything))
    added = F.concat(
        F.when(F.col("download") > 0, F.array(step(schemas.TASK_DOWNLOAD_MISSING, "added", F.col("download"))))
        .otherwise(F.array()),
        F.when(F.col("collect") > 0, F.array(step(schemas.TASK_COLLECT_MISSING, "added", F.col("collect"))))
        .otherwise(F.array()),
        F.array(step(schemas.TASK_SCAN_FOLDER, "added", everything)),
    )
    steps = F.when(F.col("_again"), failed).otherwise(added)
    return marked.select("run_id", F.posexplode(steps).alias("_at", "_step")).select(
        "run_id",
        (F.col("_at") + 1).alias("step"),
        "_step.task_id",
        "_step.outcome",
        "_step.files",
    )


def extra_file_messages(compared: DataFrame) -> DataFrame:
    """a message for every extra file of a run, in order of names; one row per file."""
    extra = compared.where("status = 'extra'").select("run_id", "file_name")
    numbered = number_by_sort(extra, ["run_id"], ["file_name"], "position")
    message = F.concat("file_name", F.lit(" arrived but no source table asks for it"))
    return numbered.select("run_id", "position", "file_name", message.alias("message"))


def repair_manifest(manifest: DataFrame, file_types: DataFrame) -> DataFrame:
    """D5 (J8, A9, W1): loader by extension, missing file ids, flags that follow the loader.

    New ids go on from the greatest number in use in the run (from 0 when there
    is none), in order of ``st_oid``.
    """
    extension = F.lower(file_extension(F.col("file_name")))
    lookup = file_types.select(
        F.col("file_extension").alias("_extension"), F.col("loader_type").alias("_loader")
    )
    typed = manifest.join(lookup, extension == F.col("_extension"), "left").withColumn(
        "loader_type", F.coalesce("_loader", "loader_type")
    )
    used = manifest.groupBy("run_id").agg(F.coalesce(F.max(id_number(F.col("file_id"))), F.lit(0)).alias("_used"))
    blank = manifest.where(F.col("file_id").isNull()).select("run_id", "st_oid")
    fresh = number_in_groups(blank, ["run_id"], "st_oid", "_nth").join(used, "run_id").select(
        "st_oid", file_id(F.col("_used") + F.col("_nth")).alias("_fresh")
    )
    sub_table_loader = F.col("loader_type").isin(schemas.SUB_TABLE_LOADERS)
    return (
        typed.join(fresh, "st_oid", "left")
        .withColumns(
            {
                "file_id": F.coalesce("file_id", "_fresh"),
                "qualified": F.col("qualified") & (F.col("loader_type") == "Flat"),
                "sub_table": F.when(sub_table_loader, F.col("sub_table")),
            }
        )
        .select(*manifest.columns)
    )


def carry_forward(manifest: DataFrame, previous: DataFrame) -> DataFrame:
    """The manifest with the listed runs' rows replaced by copies of their previous run's.

    ``previous`` has (run_id, previous_run_id). Flags, counts and ids of the
    copies start at their defaults; the writer hands out ``st_oid``. Runs without
    a previous one are left alone.
    """
    replaced = previous.where(F.col("previous_run_id").isNotNull())
    kept = manifest.join(replaced.select("run_id"), "run_id", "left_anti").select(*manifest.columns)
    defaults = {
        "st_oid": F.lit(None).cast("bigint"),
        "analyze_table": F.lit(True),
        "load": F.lit(True),
        "record_count": F.lit(0),
    }
    source = manifest.select(F.col("run_id").alias("previous_run_id"), *CARRIED)
    copies = source.join(replaced, "previous_run_id").withColumns(defaults).select(*manifest.columns)
    return kept.unionByName(copies)


def set_flags(table: DataFrame, keys: DataFrame, key: str, values: dict) -> DataFrame:
    """Set columns to fixed values for a list of keys."""
    marked = table.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    changed = {
        name: F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(name)) for name, value in values.items()
    }
    return marked.withColumns(changed).select(*table.columns)


def fetch_list(manifest: DataFrame, compared: DataFrame) -> DataFrame:
    """Distinct addresses of missing files that can be fetched, with the way to fetch them."""
    missing = compared.where("status = 'missing'").select("run_id", "file_name")
    urls = (
        manifest.where(F.col("url").isNotNull() & F.col("collect_type").isin(schemas.FETCHABLE_COLLECT_TYPES))
        .join(missing, ["run_id", "file_name"], "left_semi")
        .select("run_id", "url")
        .distinct()
    )
    return urls.select("run_id", "url", fetch_route(F.col("url")).alias("route"), url_file_name(F.col("url")).alias("target"))


def fetch_route(url: Column) -> Column:
    """Feature service, archive or plain file."""
    return (
        F.when(F.lower(url).contains("/arcgis/rest/"), "service").when(url.endswith(".zip"), "archive").otherwise("file")
    )


def apply_guarded(manifest: DataFrame, changes: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply insert, update and delete rows that their user may make.

    ``changes`` has (change_id, op, user_oid, st_oid, run_id, new values). Of several
    accepted changes to a row a delete wins, else the update with the greatest
    change_id; ``allowed`` is the subset of (user_oid,
    run_id) that may be changed. Returns the new manifest and the rejected
    changes with a reason. Updates and deletes are judged by the run the row is
    in, not by the run the change names.
    """
    owner = manifest.select("st_oid", F.col("run_id").alias("_run"))
    located = changes.join(owner, "st_oid", "left").withColumn(
        "_run", F.when(F.col("op") == "insert", F.col("run_id")).otherwise(F.col("_run"))
    )
    rights = allowed.select("user_oid", F.col("run_id").alias("_run")).distinct().withColumn("_may", F.lit(True))
    judged = located.join(rights, ["user_oid", "_run"], "left")
    accepted = judged.where(F.coalesce("_may", F.lit(False)))
    rejected = judged.where(~F.coalesce("_may", F.lit(False))).select(
        "change_id",
        F.when(F.col("_run").isNull(), "no record").otherwise("not owner").alias("reason"),
    )
    cleaned = accepted.withColumns(
        {c: blank_to_null(F.col(c)) for c in ("sub_table", "delimiter", "comments") if c in changes.columns}
    )
    edits = [c for c in EDITABLE if c in changes.columns]
    last = F.max_by(F.struct("op", *edits), F.struct((F.col("op") == "delete").alias("gone"), "change_id"))
    touched = cleaned.where("op != 'insert'").groupBy("st_oid").agg(last.alias("_last")).select(
        "st_oid", "_last.op", *[F.col(f"_last.{c}").alias(f"_new_{c}") for c in edits]
    )
    current = (
        manifest.join(touched, "st_oid", "left")
        .where("op is null or op != 'delete'")
        .withColumns(
            {c: F.when(F.col("op") == "update", F.col(f"_new_{c}")).otherwise(F.col(c)) for c in edits}
        )
        .select(*manifest.columns)
    )
    defaults = {"record_count": F.lit(0), "encoding": F.lit("utf8"), "analyze_table": F.lit(True), "load": F.lit(True)}
    added = cleaned.where("op = 'insert'")
    for name in manifest.columns:
        if name == "st_oid":
            added = added.withColumn(name, F.lit(None).cast("bigint"))
        elif name not in added.columns:
            added = added.withColumn(name, defaults.get(name, F.lit(None)))
    return reduce(DataFrame.unionByName, [current, added.select(*manifest.columns)]), rejected
