"""Change feed of the task table and latest state per key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sourceworks.operators.tree import tasks_ordered
from sourceworks.session import cut_lineage

CHANGE_SCHEMA = "event_id bigint, run_id bigint, op string, ts timestamp_ntz"


def change_stream(
    spark: SparkSession, folder: str, schema: str = CHANGE_SCHEMA, format: str = "json", **options
) -> DataFrame:
    """V1: rows of change files as they arrive; each insert, update or delete names its run."""
    return spark.readStream.format(format).schema(schema).options(**options).load(folder)


def _batch_folder(target: str, batch_id: int) -> str:
    return f"{target.rstrip('/')}/batch_id={batch_id}"


def _run(stream: DataFrame, write: Callable, state: str, mode: str, trigger: dict | None) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", state)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


LIST_BUCKETS = 64
INDEX = "bucket int, version bigint, batch_id bigint"


def _index(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """(bucket, version) of the newest batch (before a given one): the version in which each bucket's lists are."""
    index = spark.read.schema(INDEX).parquet(f"{target.rstrip('/')}/index")
    earlier = index if before is None else index.where(F.col("batch_id") < before)
    newest = earlier.agg(F.max("batch_id")).first()[0]
    return earlier.where(F.col("batch_id") == newest).select("bucket", "version")


def _versions(spark: SparkSession, target: str, index: DataFrame) -> DataFrame:
    """The lists of the indexed buckets; folders of other versions are not read."""
    lists = spark.read.parquet(f"{target.rstrip('/')}/lists")
    return lists.join(index.select("bucket", "version"), ["bucket", "version"], "left_semi").drop("version")


def relist_changed_runs(
    changes: DataFrame,
    tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame]],
    target: str,
    state: str,
    trigger: dict | None = None,
    buckets: int = LIST_BUCKETS,
) -> StreamingQuery:
    """V2: on changes, list the tasks of the changed runs anew and put them in place of their old lists.

    ``tables`` returns current (tasks, definitions, runs). Only changed runs are
    read. Runs are dealt over ``buckets``; a batch writes the buckets of its runs anew, with the unchanged
    lists in them, as a version of their own, and then an index that says in which version each bucket is. So there is one list per
    run at any time, without a compaction. A batch reads the index of the batch before it and
    replaces its own folders, so a repeated batch leaves the same files; a reader sees a batch as a whole or not at all.
    """
    base = target.rstrip("/")
    spark = changes.sparkSession
    spark.createDataFrame([], "bucket int, version bigint").write.mode("overwrite").parquet(f"{base}/index/batch_id=-1")

    def relist(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        changed = cut_lineage(batch.select("run_id").distinct())
        tasks, definitions, runs = tables()
        own = cut_lineage(tasks.join(changed, "run_id", "left_semi"))  # read once, for the order and for the listing
        listed = tasks_ordered(
            own, definitions, runs.join(changed, "run_id", "left_semi")
        )
        bucket = F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int")
        touched = [(r.bucket, batch_id) for r in changed.select(bucket.alias("bucket")).distinct().collect()]
        known = {r.bucket: r.version for r in _index(session, base, batch_id).collect()}
        lists = listed.withColumn("bucket", bucket)
        old = [(b, known[b]) for b, _ in touched if b in known]
        if old:
            kept = _versions(session, base, session.createDataFrame(old, "bucket int, version bigint"))
            lists = lists.unionByName(kept.join(changed, "run_id", "left_anti"))
        lists.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/lists/version={batch_id}")
        index = session.createDataFrame(list((known | dict(touched)).items()), "bucket int, version bigint")
        index.coalesce(1).write.mode("overwrite").parquet(f"{base}/index/batch_id={batch_id}")

    return _run(changes, relist, state, "append", trigger)


def current_lists(spark: SparkSession, target: str) -> DataFrame:
    """V4: the listing of every run; what a subscriber sees first. Reads one version of each bucket."""
    return _versions(spark, target, _index(spark, target)).drop("bucket")


def stale_versions(spark: SparkSession, target: str) -> DataFrame:
    """V4: versions (version) that the newest index does not use; their folders may be deleted while the stream goes on."""
    index = spark.read.schema(INDEX).parquet(f"{target.rstrip('/')}/index")
    return index.select("version").distinct().join(_index(spark, target).select("version"), "version", "left_anti")


def for_subscribers(changes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """V3: each change once per subscriber of its run; changes nobody follows drop out."""
    return changes.join(subscriptions.select("run_id", "subscriber"), "run_id")


def latest_state(
    events: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """V5: newest row per key by ``order``; works on tables and on streams (update mode)."""
    newest = events.groupBy(*key).agg(F.max(F.struct(*order, *values)).alias("_newest"))
    return newest.select(*key, *[F.col(f"_newest.{c}").alias(c) for c in [*order, *values]])


def write_latest(
    events: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    target: str,
    state: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """V5: reduce each batch to its newest row per key and write it to the batch's own folder.

    What is known per key lives in the written table, so the stream itself holds
    no state that could grow with the number of keys.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        latest_state(batch, key, order, values).write.mode("overwrite").parquet(_batch_folder(target, batch_id))

    return _run(events, store, state, "append", trigger)


def read_latest(
    spark: SparkSession, target: str, key: Sequence[str], order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """V5: the newest row per key over all batches, in whatever order they came."""
    return latest_state(spark.read.parquet(target), key, order, values)


def compact_latest(
    spark: SparkSession, target: str, compacted: str, key: Sequence[str], order: Sequence[str], values: Sequence[str]
) -> None:
    """V5: the batches of ``target`` as a single batch in another folder."""
    read_latest(spark, target, key, order, values).write.mode("overwrite").parquet(_batch_folder(compacted, 0))
