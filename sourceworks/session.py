"""Session set-up, shared scratch space and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
TASK_BYTES = 4 * 1024 * 1024


def build_session(app_name: str = "sourceworks", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators are written for.

    AQE stays on: it coalesces shuffle partitions, turns joins into broadcast
    joins only on measured sizes and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    root = context.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if root is None and context.master.startswith("local"):
        root = context.getCheckpointDir() or tempfile.mkdtemp(prefix="sourceworks-")
        if "://" not in root and not root.startswith("file:"):
            root = "file://" + os.path.abspath(root)
    if root is None:
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/sourceworks/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read on from there.

    Nothing before it runs again, whatever executor is lost. Unlike a checkpoint,
    the written table has known size, so that a small one is broadcast and prunes
    what it is joined with.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *keys: str, size: str) -> DataFrame:
    """Rows that stand for files or parts of them, of about ``size`` (an expression) bytes each, dealt over tasks by what is behind them.

    The rows themselves are so short that AQE would put all of them into one task; a number of partitions that is given it
    leaves alone. There are as many tasks as there are ``TASK_BYTES``, and for few rows twice as many tasks as rows, so that
    seldom more than one of them meet in a task.
    """
    written = cut_lineage(rows)
    count, total = written.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.expr(size)), F.lit(0))).first()
    least = 8 * rows.sparkSession.sparkContext.defaultParallelism
    return written.repartition(max(1, min(2 * count, max(least, total // TASK_BYTES))), *keys)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on executors that were not given it."""
    context = spark.sparkContext
    if getattr(context, "_sourceworks_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="sourceworks-py-")
    archive = shutil.make_archive(
        os.path.join(folder, "sourceworks"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    context.addPyFile(archive)
    context._sourceworks_shipped = True
