from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loam.operators import changes as C

INDEX = "path string, mtime long, size long"


def paths_of(df):
    return sorted(r.path for r in df.collect())


def test_translate(spark):
    rows = spark.createDataFrame([("Create", False, True), ("Create", True, True), ("remove_file", False, False), ("remove", False, False), ("any", False, False), ("any", True, True), ("access", False, True), (None, False, True)], "k string, d boolean, e boolean")
    got = [r.op for r in rows.select(C.translate(F.col("k"), F.col("d"), F.col("e")).alias("op")).collect()]
    assert got == ["upsert", "upsert_tree", "remove", "remove_tree", "remove_tree", "upsert_tree", None, None]


def test_rename_sides_are_judged_apart(spark):
    ev = spark.createDataFrame([(1, "rename", "/in/a", "/in/b"), (2, "rename", "/out/a", "/in/c"), (3, "rename", "/in/d", "/out/d"), (4, "upsert", None, None)], "seq long, op string, path string, to_path string")
    got = {(r.path, r.op) for r in C.split_renames(ev, F.col("path").startswith("/in/")).collect()}
    assert got == {("/in/a", "remove"), ("/in/b", "upsert"), ("/in/c", "upsert"), ("/in/d", "remove")}


def test_last_operation_wins(spark):
    ev = spark.createDataFrame([(1, "/a", "upsert"), (2, "/a", "remove"), (2, "/b", "remove"), (2, "/b", "upsert")], "seq long, path string, op string")
    assert {tuple(r) for r in C.coalesce(ev).collect()} == {("/a", "remove"), ("/b", "upsert")}


def test_quiet_batches_over_days(spark):
    t0 = datetime(2025, 1, 1, 23, 59)
    at = [t0 + timedelta(seconds=s) for s in (0, 50, 100, 5000, 5010)] + [t0 + timedelta(days=3)]
    ev = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "seq long, ts timestamp_ntz")
    assert [r.batch for r in C.quiet_batches(ev, "ts", 60).orderBy("seq").collect()] == [1, 1, 1, 2, 2, 3]
    assert C.quiet_batches(ev.limit(0), "ts", 60).count() == 0


def test_high_water_closes_a_batch(spark):
    t0 = datetime(2025, 1, 1, 23, 59, 57)
    # paths by second; a pause before 100, a second full batch after it
    at = [(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "a"), (5, "b"), (6, "c"), (100, "d"), (200, "a"), (201, "b"), (202, None), (203, "c"), (204, "c"), (300, "x")]
    ev = spark.createDataFrame([(i, t0 + timedelta(seconds=s), p) for i, (s, p) in enumerate(at)], "seq long, ts timestamp_ntz, path string")
    got = [r.batch for r in C.quiet_batches(ev, "ts", 60, path="path", high_water=3).orderBy("seq").collect()]
    assert got == [1, 1, 1, 1, 2, 2, 2, 3, 4, 4, 4, 4, 5, 6]
    assert [r.batch for r in C.quiet_batches(ev, "ts", 60, path="path").orderBy("seq").collect()] == [1] * 7 + [2] + [3] * 5 + [4]
    assert C.quiet_batches(ev.limit(0), "ts", 60, path="path").count() == 0


def test_tree_operations_spare_siblings(spark):
    index = spark.createDataFrame([(p, 1, 1) for p in ("/top", "/sub", "/sub/a", "/sub/x/b", "/sub2/c")], INDEX)
    assert paths_of(C.remove_trees(index, ["/sub"])) == ["/sub2/c", "/top"]
    listing = spark.createDataFrame([(p, 2, 2) for p in ("/new/1", "/new/d/2", "/newer/3", "/top")], INDEX)
    ops = spark.createDataFrame([("/sub", "remove_tree"), ("/new", "upsert_tree"), ("/top", "upsert"), ("/gone", "remove")], "path string, op string")
    got = {r.path: r.mtime for r in C.apply_changes(index, ops, listing).collect()}
    assert got == {"/sub2/c": 1, "/new/1": 2, "/new/d/2": 2, "/top": 2}


def test_upsert_ignores_null_keys_and_repeats(spark):
    index = spark.createDataFrame([("/a", 1, 1), ("/b", 1, 1)], INDEX)
    rows = spark.createDataFrame([("/b", 2, 2), ("/b", 3, 1), (None, 9, 9), ("/c", None, 1)], INDEX)
    assert {tuple(r) for r in C.upsert(index, rows).collect()} == {("/a", 1, 1), ("/b", 3, 1), ("/c", None, 1)}


def test_reconcile_then_apply_gives_the_listing(spark):
    index = spark.createDataFrame([("/a", 1, 1), ("/b", 1, 1), ("/c", 1, None)], INDEX)
    listing = spark.createDataFrame([("/a", 2, 1), ("/c", 1, None), ("/d", 1, 1)], INDEX)
    assert {tuple(r) for r in C.reconcile(index, listing).collect()} == {("/a", "modified"), ("/b", "removed"), ("/d", "added")}
    assert C.reconcile(listing, listing).count() == 0


def test_orphans_and_nesting(spark):
    index = spark.createDataFrame([("/r/a", 1, 1), ("/r2/b", 1, 1)], INDEX)
    assert paths_of(C.orphans(index, ["/r"])) == ["/r2/b"] and paths_of(C.orphans(index, [])) == []
    assert C.nested_roots(["/a/b", "/a", "/ab"]) == [("/a", "/a/b")]


def test_queue_and_cache(spark):
    queue = spark.createDataFrame([("/r/a",), ("/r/b",), ("/x/c",)], "path string")
    assert paths_of(C.compact_queue(queue, ["/r"], spark.createDataFrame([("/r/a",), ("/x/c",)], "path string"))) == ["/r/a"]
    images = spark.createDataFrame([("/i", 1, 1), ("/i", 2, 1)], INDEX)
    done = spark.createDataFrame([("/i", 1, 1, "text"), ("/i", 1, 1, "text")], INDEX + ", content string")
    assert {(r.mtime, r.cached) for r in C.cached_content(images, done).collect()} == {(1, "text"), (2, None)}


def test_recent_searches(spark):
    rows = spark.createDataFrame([(" a ", 1), ("a", 5), ("b", 3), ("  ", 9)], "q string, at long")
    assert [tuple(r) for r in C.recent_searches(rows).collect()] == [("a", 5), ("b", 3)]
