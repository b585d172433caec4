import random
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourceworks.operators import changes as C
from sourceworks.operators import checks as Q
from sourceworks.operators import manifest as M
from sourceworks.operators import merge as G
from sourceworks.operators import ordering as O
from sourceworks.operators import profile as P
from sourceworks.operators import runs as R
from sourceworks.operators import tours
from sourceworks.operators import tree as T
from sourceworks.functions import names as N
from sourceworks.schemas import WORKFLOWS, catalog_schema, file_types, task_definitions

SMALL = settings(max_examples=12, deadline=None)


def measures(df):
    return sorted((r.name, r.min_length, r.max_length, r.record_count) for r in df.collect())


def test_profile(spark):
    df = spark.createDataFrame([("ab",), ("",), ("abcd",), (None,)], "a string")
    assert measures(P.profile(df, "t")) == [("a", 0, 4, 4)]


def test_profile_of_no_rows(spark):
    assert measures(P.profile(spark.createDataFrame([], "a string"), "t")) == [("a", None, None, 0)]


def test_profile_merge(spark):
    parts = spark.createDataFrame(
        [("t", 0, "a", "", 0, 4, 3), ("t", 0, "a", "DATE", 1, 9, 2)],
        "table_name string, column_index int, name string, type string, min_length int, max_length int, record_count bigint",
    )
    row = P.merge_profiles(parts).first()
    assert (row.min_length, row.max_length, row.record_count, row.type) == (0, 9, 5, "DATE")


@SMALL
@given(st.lists(st.tuples(st.integers(0, 3), st.text("ab", max_size=5)), min_size=1, max_size=20))
def test_merged_parts_equal_the_whole(spark, data):
    df = spark.createDataFrame(data, "part int, a string")
    merged = P.merge_profiles(P.profile(df, "t", by=["part"]))
    assert measures(merged) == measures(P.profile(df.select("a"), "t"))


def test_upsert_twice_is_once(spark, rows):
    stored = spark.createDataFrame([(1, "A", "VARCHAR", 5, 1, "kept", 0)], "st_oid bigint, name string, type string, max_length int, min_length int, label string, column_index int")
    fresh = spark.createDataFrame([(1, "A", "VARCHAR", 9, 0, 1), (1, "B", "DATE", 8, 8, 0)], "st_oid bigint, name string, type string, max_length int, min_length int, column_index int")
    once = P.upsert_profile(stored, fresh)
    assert rows(once) == [(1, "A", "VARCHAR", 9, 0, "kept", 1), (1, "B", "DATE", 8, 8, None, 0)]
    assert rows(P.upsert_profile(once, fresh)) == rows(once)


def test_suffix_repeats_spreads_a_hot_name(spark):
    columns = spark.range(1000).select(F.lit("t").alias("table_name"), F.expr("if(id % 3 = 0, 'B', 'A')").alias("name"), F.col("id").alias("column_index"))
    named = {r.column_index: r.name for r in P.suffix_repeats(columns, "column_index").collect()}
    assert named[0] == "B_334" and named[999] == "B_1" and named[1] == "A_666" and len(set(named.values())) == 1000


@pytest.mark.parametrize("step", [1, 4_194_304])
def test_numbering_does_not_depend_on_the_spread_of_keys(spark, step):
    df = spark.range(0, 300, 3).select(F.expr("if(id % 2 = 0, 1, null)").alias("g"), (F.col("id") * step).alias("k"))
    got = O.number_in_groups(df, ["g"], "k", "n", total="all").collect()
    for group in (1, None):
        members = sorted((r.k, r.n, r.all) for r in got if r.g == group)
        assert [n for _, n, _ in members] == list(range(1, 51)) and {a for *_, a in members} == {50}


@pytest.mark.parametrize("step", [1, 4_194_304])
def test_previous_does_not_depend_on_the_spread_of_keys(spark, step):
    df = spark.range(0, 90).select(F.expr("id % 2").alias("g"), (F.col("id") * step).alias("k"))
    got = {r.k // step: r.p for r in O.previous_in_groups(df, ["g"], "k", "p").collect()}
    assert got == {k: ((k - 2) * step if k >= 2 else None) for k in range(90)}


def test_number_by_sort_over_many_partitions(spark):
    df = spark.range(0, 5000, numPartitions=7).select(F.expr("if(id < 4000, 'hot', 'cold')").alias("g"), F.expr("5000 - id").alias("k"))
    got = O.number_by_sort(df, ["g"], ["k"], "n").collect()
    hot = sorted((r.k, r.n) for r in got if r.g == "hot")
    assert [n for _, n in hot] == list(range(1, 4001)) and len(got) == 5000


def test_key_range(spark):
    keys = spark.range(5, 28).toDF("k")
    assert P.key_range(keys, "k").first().dense
    assert not P.key_range(keys.where("k <> 9"), "k").first().dense
    empty = P.key_range(keys.where("k < 0"), "k").first()
    assert (empty.max_key, empty.min_key, empty.dense) == (-1, -1, False)


def manifest(spark, entries):
    """Manifest rows from (st_oid, run_id, file_name, overrides)."""
    defaults = dict(table_name="T", analyze_table=True, load=True, qualified=True, encoding="utf8", sub_table="S",
                    record_count=0, file_id=None, url=None, comments=None, collect_type="Download",
                    loader_type="Excel", delimiter=None)
    schema = catalog_schema("source_tables")
    full = [{**defaults, "st_oid": s, "run_id": r, "file_name": f, **over} for s, r, f, over in entries]
    return spark.createDataFrame([tuple(e[c] for c in schema.names) for e in full], schema)


def test_repair(spark):
    m = manifest(spark, [(1, 7, "x.CSV", {"file_id": "F1"}), (2, 7, "b.xlsx", {"file_id": "F3"}), (3, 7, "c.dbf", {}),
                         (4, 7, "d.zzz", {}), (5, 8, "e.mdb", {})])
    got = {r.st_oid: r for r in M.repair_manifest(m, file_types(spark)).collect()}
    assert [got[i].file_id for i in range(1, 6)] == ["F1", "F3", "F4", "F5", "F1"]
    assert [got[i].loader_type for i in range(1, 6)] == ["Flat", "Excel", "DBF", "Excel", "MDB"]
    assert [got[i].qualified for i in range(1, 6)] == [True, False, False, False, False]
    assert [got[i].sub_table for i in range(1, 6)] == [None, "S", None, "S", "S"]


def test_compare_files(spark, rows):
    m = manifest(spark, [(1, 7, "a.csv", {}), (2, 7, "b.csv", {}), (3, 7, "a.csv", {"collect_type": "Email"})])
    found = spark.createDataFrame([(7, "b.csv"), (7, "c.csv"), (7, "c.csv")], "run_id bigint, file_name string")
    assert rows(M.compare_files(m, found)) == [
        (7, "a.csv", "Email", 2, 0, "missing"), (7, "b.csv", "Download", 1, 1, "present"), (7, "c.csv", None, 0, 2, "extra"),
    ]


def test_follow_ups(spark, rows):
    m = manifest(spark, [(1, 7, "a.csv", {}), (2, 7, "b.csv", {"collect_type": "FOI"}), (3, 8, "a.csv", {"collect_type": "REST"})])
    nothing = spark.createDataFrame([], "run_id bigint, file_name string")
    compared = M.compare_files(m, nothing)
    again = spark.createDataFrame([(8,)], "run_id bigint")
    assert rows(M.follow_up_tasks(compared, again)) == [
        (7, 1, 4, "added", 1), (7, 2, 5, "added", 1), (7, 3, 3, "added", 2), (8, 1, None, "rescan_failed", 1),
    ]


def test_carry_forward(spark, rows):
    m = manifest(spark, [(1, 7, "a.csv", {"load": False, "record_count": 9}), (2, 8, "old.csv", {}), (3, 9, "keep.csv", {})])
    previous = spark.createDataFrame([(8, 7), (9, None)], "run_id bigint, previous_run_id bigint")
    got = M.carry_forward(m, previous)
    assert rows(got, "st_oid", "run_id", "file_name", "load", "record_count") == [
        (1, 7, "a.csv", False, 9), (3, 9, "keep.csv", True, 0), (None, 8, "a.csv", True, 0),
    ]


def test_lists_per_file_keep_nulls_and_order(spark):
    m = manifest(spark, [(2, 7, "a.mdb", {"sub_table": None, "delimiter": ";x"}), (1, 7, "a.mdb", {"table_name": "U"})])
    tables = sorted(M.files_with_tables(m, "analyze_table").collect(), key=lambda t: t.position)
    assert [(t.st_oid, t.table_name, t.sub_table, t.delimiter) for t in tables] == [(1, "U", "S", ","), (2, "T", None, ";")]


def test_compare_files_takes_any_id_and_type(spark, rows):
    m = manifest(spark, [(2**61, 7, "a.csv", {"collect_type": "Courier"}), (1, 7, "a.csv", {})])
    none = spark.createDataFrame([], "run_id bigint, file_name string")
    assert rows(M.compare_files(m, none), "collect_type", "expected_rows") == [("Courier", 2)]


def test_several_changes_to_one_row(spark, rows):
    m = manifest(spark, [(1, 7, "a.csv", {}), (2, 7, "b.csv", {})])
    changes = spark.createDataFrame(
        [(1, "update", 5, 1, None, "OLD"), (3, "update", 5, 1, None, "NEW"), (2, "delete", 5, 2, None, None), (4, "update", 5, 2, None, "X")],
        "change_id int, op string, user_oid bigint, st_oid bigint, run_id bigint, table_name string",
    )
    allowed = spark.createDataFrame([(5, 7)], "user_oid bigint, run_id bigint")
    assert rows(M.apply_guarded(m, changes, allowed)[0], "st_oid", "table_name") == [(1, "NEW")]


def test_the_first_claim_wins(spark, rows):
    schema = "run_id bigint, workflow_operation string, operation_state string, " + ", ".join(f"{w}_user_oid bigint" for w in WORKFLOWS)
    runs = spark.createDataFrame([(1, "load", "Ready", None, None, None, None), (2, "load", "Active", None, 9, None, None)], schema)
    claims = spark.createDataFrame([(5, 1, 50), (4, 1, 40), (6, 2, 60)], "claim_id bigint, run_id bigint, user_oid bigint")
    updated, rejected = R.claim_runs(runs, claims)
    assert rows(updated, "run_id", "operation_state", "load_user_oid") == [(1, "Active", 40), (2, "Active", 9)]
    assert rows(rejected, "claim_id") == [(5,), (6,)]


def test_long_words_keep_their_letters(spark):
    text = spark.range(1).select(N.display_label(F.concat(F.lit("a_"), F.repeat(F.lit("x"), 1_500_000))).alias("t"))
    assert text.select(F.length("t")).first()[0] == 1_500_002


def test_guarded_changes(spark, rows):
    m = manifest(spark, [(1, 7, "a.csv", {}), (2, 7, "b.csv", {}), (3, 8, "c.csv", {})])
    changes = spark.createDataFrame(
        [(1, "update", 5, 1, None, "NEW", " "), (2, "delete", 5, 2, None, None, None), (3, "delete", 5, 3, None, None, None),
         (4, "insert", 5, None, 7, "ADD", "x"), (5, "insert", 6, None, 7, "NO", "x"), (6, "update", 5, 99, None, "NO", "x")],
        "change_id int, op string, user_oid bigint, st_oid bigint, run_id bigint, table_name string, comments string",
    )
    allowed = spark.createDataFrame([(5, 7)], "user_oid bigint, run_id bigint")
    current, rejected = M.apply_guarded(m, changes, allowed)
    assert rows(current, "st_oid", "run_id", "table_name", "comments") == [(1, 7, "NEW", None), (3, 8, "T", None), (None, 7, "ADD", "x")]
    assert rows(rejected) == [(3, "not owner"), (5, "not owner"), (6, "no record")]


def tasks(spark, entries):
    """Task rows from (id, parent, order) of run 1."""
    schema = catalog_schema("pipeline_run_tasks")
    made = [(i, 1, None, None, 1, None, "Complete", p, o, "collection", None) for i, p, o in entries]
    return spark.createDataFrame(made, schema)


A, B, C_, D, E, FF = 1, 2, 3, 4, 5, 6
GOLDEN = [(A, 0, 1), (B, 0, 2), (C_, 0, 3), (D, B, 1), (E, B, 2), (FF, D, 1)]


def listed(df):
    return [r.pr_task_id for r in df.orderBy("task_order").collect()]


def test_golden_tree(spark):
    assert listed(T.tree_order(tasks(spark, GOLDEN))) == [A, B, D, FF, E, C_]


def test_delete_children(spark, rows):
    roots = spark.createDataFrame([(B,)], "pr_task_id bigint")
    assert rows(T.delete_subtrees(tasks(spark, GOLDEN), roots), "pr_task_id") == [(A,), (B,), (C_,)]


def test_nested_roots_are_followed_once(spark, rows):
    chain = tasks(spark, [(i, i - 1, 1) for i in range(1, 9)])
    members = T.subtree_members(chain, chain.where("pr_task_id in (2, 3, 5)").select("pr_task_id"))
    assert rows(members) == [(i,) for i in range(3, 9)]


def test_next_child(spark, rows):
    parents = spark.createDataFrame([(B,), (FF,)], "pr_task_id bigint")
    assert rows(T.next_child_order(tasks(spark, GOLDEN), parents)) == [(B, 3), (FF, 1)]


def test_deep_chain_and_unreachable_cycle(spark):
    chain = [(i, i - 1, 1) for i in range(1, 13)] + [(20, 21, 1), (21, 20, 1)]
    assert listed(T.tree_order(tasks(spark, chain))) == list(range(1, 13))


def test_chain_of_1500(spark, rows):
    chain = tasks(spark, [(i, i - 1, 1) for i in range(1, 1501)])
    assert listed(T.tree_order(chain)) == list(range(1, 1501))
    assert rows(T.delete_subtrees(chain, chain.where("pr_task_id = 3").select("pr_task_id")), "pr_task_id") == [(1,), (2,), (3,)]


def test_cycle_below_a_root_is_reported(spark):
    loop = tasks(spark, [(20, 21, 1), (21, 20, 1)])
    with pytest.raises(ValueError, match="cycle"):
        T.descendants(loop, loop.where("pr_task_id = 20").select("pr_task_id"))


@SMALL
@given(st.lists(st.integers(0, 100), min_size=1, max_size=15))
def test_order_is_a_permutation(spark, parents):
    made = [(i, p % i, i % 3) for i, p in enumerate(parents, 1)]
    assert sorted(listed(T.tree_order(tasks(spark, made)))) == [i for i, *_ in made]


def test_tours_over_many_partitions(spark):
    """Ranks do not depend on which steps lie in one partition; orphans and cycles are left out of the order."""
    pick = random.Random(4)
    made = [(i, pick.randrange(i) if i % 50 else 0, pick.randrange(3)) for i in range(1, 400)]
    ids = pick.sample(range(1, 10_000), 399)
    name = {0: 0, **{i: ids[i - 1] for i, *_ in made}}
    rows_ = [(name[i], name[p], o) for i, p, o in made]
    lost = [(20_001, 20_000, 1), (20_002, 20_001, 1), (20_011, 20_012, 1), (20_012, 20_011, 1), (20_013, 20_011, 2)]
    children = {}
    for i, p, o in rows_:
        children.setdefault(p, []).append((o, i))
    order, stack = [], [i for _, i in sorted(children[0], reverse=True)]
    while stack:
        order.append(stack.pop())
        stack += [i for _, i in sorted(children.get(order[-1], []), reverse=True)]
    table = tasks(spark, rows_ + lost)
    for size in (7, 100, 1_000_000):
        ranked = tours.ranked_steps(tours.tour_steps(table), size)
        found = ranked.where("step % 2 = 0").collect()
        placed = sorted((-r.entered, r.step // 2) for r in found if r.state == tours.AT_ROOT)
        assert [i for _, i in placed] == order
        state = {r.step // 2: r.state for r in found if r.step >= 40_000}
        assert state == {20_001: 2, 20_002: 2, 20_011: 3, 20_012: 3, 20_013: 3}
    assert listed(T.tree_order(table)) == order
    pairs = T.descendants(table, spark.createDataFrame([(i,) for i in (*ids[:40], 20_001, 20_013)], "pr_task_id bigint")).collect()
    below = {}
    for i in reversed(order):
        below[i] = {c for _, c in children.get(i, [])}.union(*(below[c] for _, c in children.get(i, [])))
    assert sorted(map(tuple, pairs)) == sorted([(i, c) for i in ids[:40] for c in below[i]] + [(20_001, 20_002)])


def test_a_long_cycle_is_found_in_few_rounds(spark):
    loop = spark.range(1, 100_001).selectExpr("1L as run_id", "id as pr_task_id", "id % 100000 + 1 as parent_task_id", "1 as parent_task_order")
    with pytest.raises(ValueError, match="cycle"):
        T.descendants(loop, loop.where("pr_task_id = 20").select("pr_task_id"))


def test_next_task_waits_for_a_busy_run(spark, rows):
    k = tasks(spark, GOLDEN)
    status = F.when(F.col("pr_task_id").isin(FF, C_), "Waiting").otherwise("Complete")
    assert rows(T.next_tasks(k.withColumn("task_status", status), task_definitions(spark)), "pr_task_id", "goes_on") == [(FF, False)]
    busy = F.when(F.col("pr_task_id") == A, "Running").otherwise(status)
    assert rows(T.next_tasks(k.withColumn("task_status", busy), task_definitions(spark))) == []


def test_reset_needs_rights_and_a_started_task(spark, rows):
    k = tasks(spark, GOLDEN)
    asked = spark.createDataFrame([(5, B), (6, A)], "user_oid bigint, pr_task_id bigint")
    allowed = spark.createDataFrame([(5, 1)], "user_oid bigint, run_id bigint")
    assert rows(T.reset_tasks(k, asked, allowed), "pr_task_id", "task_status") == [(A, "Complete"), (B, "Waiting"), (C_, "Complete")]


def test_add_tasks_places_several_requests(spark, rows):
    asked = spark.createDataFrame([(1, B, 4), (2, B, 5), (3, FF, 3)], "request_id bigint, pr_task_id bigint, task_id bigint")
    added = T.add_child_tasks(tasks(spark, GOLDEN), asked).where("pr_task_id > 6")
    assert rows(added, "pr_task_id", "parent_task_id", "parent_task_order", "task_id", "task_status") == [
        (7, B, 3, 4, "Waiting"), (8, B, 4, 5, "Waiting"), (9, FF, 1, 3, "Waiting"),
    ]


def test_ownership(spark, rows):
    users = spark.createDataFrame([(1, ["admin"]), (2, ["load"]), (3, ["qa"])], "user_oid bigint, roles array<string>")
    runs = spark.createDataFrame([(10, 2, None, None, None)], "run_id bigint, collection_user_oid bigint, load_user_oid bigint, check_user_oid bigint, qa_user_oid bigint")
    asked = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (2, 99), (9, 10)], "user_oid bigint, run_id bigint")
    assert rows(R.user_has_run(asked, users, runs)) == [(1, 10, True), (2, 10, True), (2, 99, False), (3, 10, False), (9, 10, False)]


def test_unknown_workflow_is_refused(spark):
    with pytest.raises(ValueError, match="workflow"):
        R.my_runs(spark.range(1), 1, "done")


def test_natural_sort(spark):
    ids = spark.createDataFrame([("F10",), ("F2",), ("F1",)], "id string")
    assert [r.id for r in R.natural_sort(ids, "id").collect()] == ["F1", "F2", "F10"]
    assert [r.id for r in R.natural_sort(ids, "id", False).collect()] == ["F10", "F2", "F1"]


def test_row_shape(spark):
    shape = spark.range(1).selectExpr("id as a", "'x' as b").schema
    assert R.check_row_shape(spark.range(2).selectExpr("id", "'y'"), shape).columns == ["a", "b"]
    with pytest.raises(ValueError, match="columns"):
        R.check_row_shape(spark.range(1), shape)


def test_search_does_not_match_across_columns(spark, rows):
    df = spark.createDataFrame([("ab", "cd"), ("xBCx", None)], "a string, b string")
    assert rows(R.search_text(df, "bc", ["a", "b"])) == [("xBCx", None)]


def test_sparse_update_sets_null(spark, rows):
    table = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, m string, n int")
    changes = spark.createDataFrame([(1, 1, {"m": "x", "n": "7"}), (1, 2, {"m": None})], "k int, seq int, changes map<string,string>")
    updated = C.sparse_update(table, C.fold_changes(changes, "k", "seq"), "k", ["m", "n"])
    assert rows(updated) == [(1, None, 7), (2, "b", 6)]


def test_exclusive_merge_refuses_overlap(spark):
    with pytest.raises(ValueError, match="share"):
        G.merge_exclusive(spark.range(3), spark.range(2, 5), ["id"])
    assert G.merge_exclusive(spark.range(3), spark.range(3, 5), ["id"]).count() == 5


@SMALL
@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("bcd"), max_size=6))
def test_missing_and_extra_are_disjoint(spark, expected, found):
    m = manifest(spark, [(i, 1, f"{n}.csv", {}) for i, n in enumerate(expected)])
    f = spark.createDataFrame([(1, f"{n}.csv") for n in found], "run_id bigint, file_name string")
    got = {r.file_name: r.status for r in M.compare_files(m, f).collect()}
    assert {n for n, s in got.items() if s == "missing"} == {f"{n}.csv" for n in set(expected) - set(found)}
    assert {n for n, s in got.items() if s == "extra"} == {f"{n}.csv" for n in set(found) - set(expected)}


def test_reference_actions(spark, rows):
    child = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, p int")
    gone = spark.createDataFrame([(10,), (30,)], "p int")
    assert rows(Q.cascade_delete(child, "p", gone, "p")) == [(2, 20), (3, None)]
    assert rows(Q.set_null_on_delete(child, "p", gone, "p")) == [(1, None), (2, 20), (3, None)]
    assert rows(Q.restricted_deletes(child, "p", gone, "p")) == [(10,)]


def test_profile_drift(spark, rows):
    def stored(entries):
        return spark.createDataFrame(entries, "table_name string, name string, min_length int, max_length int")

    before, after = stored([("t", "A", 1, 2), ("t", "B", 1, 2), ("t", "C", 0, 0)]), stored([("t", "A", 1, 3), ("t", "C", 0, 0), ("t", "D", 1, 1)])
    assert rows(P.profile_drift(before, after), "name", "drift") == [("A", "length"), ("B", "removed"), ("D", "added")]


def test_a_change_rewrites_only_files_with_its_keys(spark, tmp_path):
    path = str(tmp_path / "table")
    table = spark.range(1000).selectExpr("id as st_oid", "true as load", "concat('n', id) as name")
    C.write_parted(table, path, "st_oid", 32)
    files = lambda: {(r.part, r.file) for r in C.files_with_keys(spark, path, spark.read.parquet(path), "st_oid").collect()}
    before = files()
    keys = spark.createDataFrame([(3,), (500,), (2000,)], "st_oid bigint")
    held = {r.part for r in C.files_with_keys(spark, path, keys, "st_oid").collect()}
    assert len(before) == 32 and len(held) <= 2

    def change(rows):
        flagged = M.set_flags(rows, keys, "st_oid", {"load": False}).where("st_oid <> 500")
        return flagged.unionByName(keys.where("st_oid = 2000").selectExpr("st_oid", "false as load", "'new' as name"))

    touched = {r.part for r in C.rewrite_keys(spark, path, keys, "st_oid", change, 32).collect()}
    after = files()
    assert held <= touched and len(touched) <= 3
    assert {f for f in before if f[0] not in touched} == {f for f in after if f[0] not in touched}
    assert not {f for f in before if f[0] in touched} & after
    found = {r.st_oid: (r.load, r.name) for r in spark.read.parquet(path).collect()}
    assert found == {i: (i != 3, f"n{i}") for i in range(1000) if i != 500} | {2000: (False, "new")}


def test_a_part_without_rows_goes(spark, tmp_path):
    path = str(tmp_path / "table")
    C.write_parted(spark.range(2).selectExpr("id as k"), path, "k", 64)
    C.rewrite_keys(spark, path, spark.range(1).selectExpr("id as k"), "k", lambda rows: rows.where("k <> 0"), 64)
    assert [r.k for r in spark.read.parquet(path).collect()] == [1]
