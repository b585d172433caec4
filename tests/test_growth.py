"""What must not grow with the tables: rows at the driver, files in a task, memory of an aggregate."""

import os

from pyspark.sql import functions as F

from sourceworks.functions import sqlfuncs
from sourceworks.schemas import catalog_schema, task_definitions
from sourceworks.session import TASK_BYTES, dealt
from sourceworks.sources import spanning
from sourceworks.sources.records import RECORD, profile_records
from sourceworks.streaming import pages


def test_the_script_leaves_its_rows_with_the_executors(spark, rows):
    made = [(i, 1, None, None, 1, None, "Complete", p, o, "load", None) for i, p, o in [(1, 0, 1), (2, 0, 2), (3, 2, 1), (4, 3, 1)]]
    runs = spark.createDataFrame([(1, "load")], "run_id bigint, workflow_operation string")
    sqlfuncs.register_tasks(spark.createDataFrame(made, catalog_schema("pipeline_run_tasks")), task_definitions(spark), runs)
    for named, left in ([(2,), (2,)], [(1,), (2,)]), ([], [(1,), (2,), (3,), (4,)]):
        spark.createDataFrame(named, "pr_task_id bigint").createOrReplaceTempView("named_tasks")
        assert spark.sql(sqlfuncs.DELETE_RUN_TASK_CHILDREN).columns == []
        assert rows(spark.table("remaining_tasks"), "pr_task_id") == left


def test_rows_for_files_are_not_put_into_one_task(spark):
    files = spark.range(40).selectExpr("concat('/data/file', id) as path")
    held = dealt(files, "path", size="1").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert held < 8
    large = dealt(files, "path", size=f"{100 * TASK_BYTES}")
    assert large.count() == 40 and large.rdd.getNumPartitions() == 80


def test_a_profile_does_not_sort_its_cells(spark, rows):
    records = spark.createDataFrame(
        [(1, True, ["A", "B"], ["N", "C"]), (1, False, ["x", None], None), (1, False, ["long"], None), (2, True, ["Z"], ["C"])], RECORD
    )
    found = profile_records(records, spark.createDataFrame([(1, "ONE"), (2, "TWO")], "st_oid bigint, table_name string"))
    assert rows(found) == [(1, "ONE", 0, "A", "N", 1, 4, 2), (1, "ONE", 1, "B", "C", 0, 0, 2), (2, "TWO", 0, "Z", "C", None, None, 0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    cells = plan[: plan.index("Generate posexplode")].splitlines()
    above = next(line for line in reversed(cells[:-1]) if "Aggregate" in line or "Sort" in line)
    assert "HashAggregate" in above


def test_documents_over_blocks_read_little_more_than_themselves(monkeypatch, tmp_path):
    """Where a record ends is looked for in small steps, not by cutting a megabyte into records."""
    file = tmp_path / "a.csv"
    file.write_bytes(b"k,v\n" + b"".join(b'%d,"line\nof %d"\n' % (i, i) for i in range(40_000)))
    block = {"path": str(file), "start": 0, "stop": 1000, "delimiter": ",", "qualified": True, "encoding": "UTF-8", "inside": False}
    cut = []
    real = spanning.RecordRule.records
    monkeypatch.setattr(spanning.RecordRule, "records", lambda self, data, inside: cut.append(len(data)) or real(self, data, inside))
    for stop in range(1000, 1040):  # some of the stops lie inside quotes
        texts = list(spanning.record_texts(block | {"stop": stop}))
        assert texts[-1][1].endswith('"') or texts[-1][1] == "k,v"
    assert max(cut) < 100_000


def test_batches_open_few_folders_of_taken_pages(spark, tmp_path, rows):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for n in range(20):  # every page comes twice, in batches far from each other
        for copy in ("", "_try1"):
            (folder / f"page{n}{copy}.json").write_text('{"features":[{"attributes":{"ID":"%d"}}]}' % n)
            os.utime(folder / f"page{n}{copy}.json", (1000 + n + 40 * bool(copy),) * 2)
    for state in ("first", "second"):  # the second stream starts anew over the same target
        pages.ingest_pages(spark, str(folder), target, str(tmp_path / state), ["ID"], files_per_batch=2).awaitTermination()
        assert rows(pages.ingested(spark, target)) == sorted([(str(n),) for n in range(20)], key=repr)
    assert spark.read.parquet(f"{target}/taken/level=1/number=0").count() == 16
    assert spark.read.parquet(f"{target}/taken/level=1/number=1").count() == 4
    for batch, opened in ((0, 0), (7, 7), (8, 1), (20, 6), (512, 1), (4095, 28)):
        folders = pages._taken_folders("t", batch)
        assert len(folders) == opened
