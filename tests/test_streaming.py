import json

from sourceworks.operators.tree import tree_order
from sourceworks.schemas import catalog_schema, task_definitions
from sourceworks.streaming import feed


def put(folder, name, entries):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(e) + "\n" for e in entries))


def test_lists_follow_the_changes(spark, tmp_path):
    folder, target, state = tmp_path / "changes", str(tmp_path / "lists"), str(tmp_path / "state")
    current = {}

    def tables():
        made = [(i, r, None, None, 1, None, "Waiting", p, o, "load", None) for r, t in current.items() for i, p, o in t]
        tasks = spark.createDataFrame(made, catalog_schema("pipeline_run_tasks"))
        return tasks, task_definitions(spark), spark.createDataFrame([(r, "load") for r in current], "run_id bigint, workflow_operation string")

    def relist():
        feed.relist_changed_runs(feed.change_stream(spark, str(folder)), tables, target, state).awaitTermination()
        return sorted((r.run_id, r.task_order, r.pr_task_id) for r in feed.current_lists(spark, target).collect())

    current.update({1: [(10, 0, 1), (11, 10, 1)], 2: [(20, 0, 1)]})
    put(folder, "a.json", [{"event_id": 1, "run_id": 1, "op": "insert"}, {"event_id": 2, "run_id": 2, "op": "insert"}])
    assert relist() == [(1, 1, 10), (1, 2, 11), (2, 1, 20)]
    current.update({1: [(12, 0, 1), (10, 0, 2)], 2: [(99, 0, 1)]})
    put(folder, "b.json", [{"event_id": 3, "run_id": 1, "op": "delete"}])
    assert relist() == [(1, 1, 12), (1, 2, 10), (2, 1, 20)]  # run 2 did not change
    current[1] = []
    put(folder, "c.json", [{"event_id": 4, "run_id": 1, "op": "delete"}])
    assert relist() == [(2, 1, 20)]
    lists = spark.read.parquet(f"{target}/index")
    assert lists.where("batch_id = 2").count() <= 2 and sorted(r.version for r in feed.stale_versions(spark, target).collect()) in ([0, 1], [1])


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """The same changes once more, as after a failure: one list per run, before and after."""
    folder, target = tmp_path / "changes", str(tmp_path / "lists")
    made = [(10 * r + i, r, None, None, 1, None, "Waiting", 0, i, "load", None) for r in range(1, 40) for i in range(3)]

    def tables():
        tasks = spark.createDataFrame(made, catalog_schema("pipeline_run_tasks"))
        return tasks, task_definitions(spark), spark.createDataFrame([(r, "load") for r in range(1, 40)], "run_id bigint, workflow_operation string")

    put(folder, "a.json", [{"event_id": r, "run_id": r, "op": "insert"} for r in range(1, 40)])
    seen = []
    for state in ("first", "second"):  # the second one starts without a state, so batch 0 comes again
        feed.relist_changed_runs(feed.change_stream(spark, str(folder)), tables, target, str(tmp_path / state), buckets=4).awaitTermination()
        seen.append(sorted((r.run_id, r.task_order, r.pr_task_id) for r in feed.current_lists(spark, target).collect()))
    assert seen[0] == seen[1] == [(r, i + 1, 10 * r + i) for r in range(1, 40) for i in range(3)]


def test_latest_state_over_batches(spark, tmp_path):
    folder, target, state = tmp_path / "changes", str(tmp_path / "latest"), str(tmp_path / "state")
    shape = (["run_id"], ["ts", "event_id"], ["op"])

    def write():
        stream = feed.change_stream(spark, str(folder), maxFilesPerTrigger=1)
        feed.write_latest(stream, *shape, target, state).awaitTermination()
        return sorted((r.run_id, r.op) for r in feed.read_latest(spark, target, *shape).collect())

    put(folder, "a.json", [{"event_id": 1, "run_id": 1, "op": "insert", "ts": "2024-01-02T00:00:00"}])
    put(folder, "b.json", [{"event_id": 2, "run_id": 1, "op": "late", "ts": "2024-01-01T00:00:00"},
                           {"event_id": 3, "run_id": 2, "op": "insert", "ts": "2024-01-01T00:00:00"}])
    assert write() == [(1, "insert"), (2, "insert")]
    put(folder, "c.json", [{"event_id": 4, "run_id": 2, "op": "update", "ts": "2024-01-03T00:00:00"}])
    assert write() == [(1, "insert"), (2, "update")]
    compacted = str(tmp_path / "compacted")
    feed.compact_latest(spark, target, compacted, *shape)
    assert sorted((r.run_id, r.op) for r in feed.read_latest(spark, compacted, *shape).collect()) == [(1, "insert"), (2, "update")]


def test_stateful_latest_state(spark, tmp_path):
    folder = tmp_path / "changes"
    put(folder, "a.json", [{"event_id": i, "run_id": i % 2, "op": f"op{i}", "ts": f"2024-01-0{i}T00:00:00"} for i in range(1, 6)])
    newest = feed.latest_state(feed.change_stream(spark, str(folder)), ["run_id"], ["ts", "event_id"], ["op"])
    seen = []
    stream = newest.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
    stream.foreachBatch(lambda df, _: seen.extend((r.run_id, r.op) for r in df.collect())).trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == [(0, "op4"), (1, "op5")]


def test_subscribers_get_only_their_runs(spark):
    changes = spark.createDataFrame([(1, 7), (2, 8)], "event_id bigint, run_id bigint")
    follows = spark.createDataFrame([(7, "ann"), (7, "bob")], "run_id bigint, subscriber string")
    assert sorted((r.event_id, r.subscriber) for r in feed.for_subscribers(changes, follows).collect()) == [(1, "ann"), (1, "bob")]


def test_order_of_an_empty_table(spark):
    assert tree_order(spark.createDataFrame([], catalog_schema("pipeline_run_tasks"))).count() == 0
