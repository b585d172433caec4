"""Page files of a feature service, ingested as they arrive, with a ledger of the pages seen.

A page may be fetched several times; every try is a file of its own. The features of a page are
taken from one good file of it, however many there are and in whatever batches they arrive, and the ledger
says of every file what became of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sourceworks.session import cut_lineage
from sourceworks.sources.features import checked_pages, feature_rows

LEDGER = "page string, path string, outcome string, taken boolean, batch_id bigint"
MERGED = 8  # batches whose taken pages are merged into one folder, then folders of those, and so on


def page_of(path: Column) -> Column:
    """The page a file belongs to: its name up to the first mark of a try (``_try``) or its ending."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(_try.*)?\.[^.]*$", "")


def page_ledger(spark: SparkSession, target: str) -> DataFrame:
    """Every page file seen: page, path, outcome (ok, retry, fatal), whether its features were taken, and its batch."""
    return spark.read.schema(LEDGER).parquet(f"{target.rstrip('/')}/ledger")


def _taken_folder(base: str, level: int, number: int) -> str:
    """Where the pages are that ``MERGED ** level`` batches took, the ``number``-th so many from the first batch on."""
    return f"{base}/taken/level={level}/number={number}" if level else f"{base}/ledger/batch_id={number}"


def _taken_folders(base: str, batch_id: int) -> list[str]:
    """The folders with the pages that batches before the given one took: fewer than ``MERGED`` of each level."""
    folders, level, upto = [], 0, batch_id
    while upto:
        folders += [_taken_folder(base, level, n) for n in range(upto - upto % MERGED, upto)]
        level, upto = level + 1, upto // MERGED
    return folders


def _taken_pages(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema("page string, taken boolean").parquet(*folders).where("taken")


def _taken_before(spark: SparkSession, base: str, batch_id: int, whole: bool) -> DataFrame:
    """Pages that other batches took: those before, or with ``whole`` all that the ledger has."""
    if not whole:
        if batch_id == 0:
            return spark.createDataFrame([], "page string")
        try:
            return _taken_pages(spark, _taken_folders(base, batch_id)).select("page")
        except AnalysisException:  # batches of this ledger were written without merged folders
            pass
    return page_ledger(spark, base).where((F.col("batch_id") != batch_id) & F.col("taken")).select("page").distinct()


def _merge_taken(spark: SparkSession, base: str, batch_id: int) -> None:
    """Merge the pages taken by the last batches where the given one is the last of ``MERGED`` (or of so many times as many)."""
    level, number = 0, batch_id + 1
    while number % MERGED == 0:
        level, number = level + 1, number // MERGED
        parts = [_taken_folder(base, level - 1, n) for n in range((number - 1) * MERGED, number * MERGED)]
        try:
            merged = _taken_pages(spark, parts).distinct()
        except AnalysisException:  # see ``_taken_before``
            return
        merged.write.mode("overwrite").parquet(_taken_folder(base, level, number - 1))


def _last_batch(spark: SparkSession, base: str) -> int:
    """The greatest batch with a row in the ledger, -1 without one."""
    try:
        last = page_ledger(spark, base).agg(F.max("batch_id")).first()[0]
    except AnalysisException:
        return -1
    return -1 if last is None else last


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """The features of all pages as one table."""
    return spark.read.parquet(f"{target.rstrip('/')}/features").drop("batch_id")


def missing_pages(planned: DataFrame, ledger: DataFrame) -> DataFrame:
    """Planned pages (page, ...) without a good file, with the number of tries so far."""
    seen = ledger.groupBy("page").agg(F.count(F.lit(1)).alias("tries"), F.max("taken").alias("_taken"))
    return (
        planned.join(seen, "page", "left")
        .where(~F.coalesce("_taken", F.lit(False)))
        .select(*planned.columns, F.coalesce("tries", F.lit(0)).alias("tries"))
    )


def ingest_pages(
    spark: SparkSession,
    folder: str,
    target: str,
    state: str,
    fields: Sequence[str],
    geometry_type: str = "",
    files_per_batch: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Take the features of page files below ``folder`` over to ``target`` (see ``feature_rows`` for the columns).

    A batch writes its features and its ledger to folders of its own, which a repeated batch replaces; pages
    taken by other batches are not taken again. Of several good files of a page in a batch the one with the least path counts.
    Taken pages are merged as batches go on, so a batch opens as many folders as the logarithm of its number and not all of them.
    """
    base = target.rstrip("/")
    options = {"wholetext": "true", **({"maxFilesPerTrigger": str(files_per_batch)} if files_per_batch else {})}
    arriving = spark.readStream.format("text").options(**options).load(folder)
    pages = arriving.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))

    last = _last_batch(spark, base)  # a stream that lost its state goes over batches that the ledger has

    def store(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = _taken_before(session, base, batch_id, whole=batch_id <= last)
        found = cut_lineage(checked_pages(batch).select(page_of(F.col("path")).alias("page"), "path", "outcome"))
        first = found.where("outcome = 'ok'").groupBy("page").agg(F.min("path").alias("path")).join(before, "page", "left_anti")
        marked = found.join(first.withColumn("taken", F.lit(True)), ["page", "path"], "left")
        ledger = cut_lineage(marked.select("page", "path", "outcome", F.coalesce("taken", F.lit(False)).alias("taken")))
        features = feature_rows(batch.join(ledger.where("taken").select("path"), "path", "left_semi"), fields, geometry_type)
        features.write.mode("overwrite").parquet(f"{base}/features/batch_id={batch_id}")
        ledger.write.mode("overwrite").parquet(f"{base}/ledger/batch_id={batch_id}")
        _merge_taken(session, base, batch_id)

    return (
        pages.writeStream.foreachBatch(store)
        .option("checkpointLocation", state)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
