from pyspark.sql import functions as F

from loam.operators import ledger as L
from loam.session import small_join


class Clock:
    now = 0

    def __call__(self):
        return self.now


def make(spark, tmp_path):
    clock = Clock()
    book = L.WorkLedger(spark, f"file://{tmp_path}/book", clock)
    book.enqueue(spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "unit string"))
    return book, clock


def states(book):
    return {r.unit: r.state for r in L.fold(book.events()).collect()}


def test_units_are_processed_once(spark, tmp_path):
    book, clock = make(spark, tmp_path)
    assert states(book) == {"a": "pending", "b": "pending"}
    (a, token), = book.lease(100, 1)
    assert book.process(a, token, spark.range(3))
    book.enqueue(spark.createDataFrame([("a",)], "unit string"))
    assert states(book) == {"a": "done", "b": "pending"}
    assert book.results().count() == 3


def test_expired_lease_returns_and_stale_writer_is_rejected(spark, tmp_path):
    book, clock = make(spark, tmp_path)
    (unit, old), = book.lease(100, 1)
    assert [u for u, _ in book.lease(100, 5)] == ["b"]
    clock.now = 101
    retaken = dict(book.lease(100, 5))
    assert set(retaken) == {"a", "b"} and retaken[unit] > old
    assert not book.commit(unit, old)
    assert book.process(unit, retaken[unit], spark.range(2))
    assert not book.commit(unit, old)
    assert book.results().count() == 2  # the retry replaced, it did not add


def test_failure_before_commit_leaves_no_result(spark, tmp_path):
    book, _ = make(spark, tmp_path)
    (unit, token), = book.lease(100, 1)
    spark.range(5).write.mode("overwrite").parquet(book.output(unit))
    assert book.results() is None and states(book)[unit] == "leased"


def test_journal_pending_edge_cases(spark):
    journal = spark.createDataFrame([("C:", 1, 10, "x"), ("C:", 1, 10, "y"), ("C:", 1, 20, None), ("C:", 2, 5, ""), ("C:", 1, None, ""), (None, 1, 3, ""), ("D:", None, 4, "")], "volume string, journal_id long, usn long, extra string")
    cursors = spark.createDataFrame([(1, "C:", 1, 15, "committed"), (2, "C:", 1, 99, "failed"), (3, "C:", 1, None, "committed"), (1, "C:", 1, 15, "committed"), (4, None, 1, 50, "committed")], "run_id long, volume string, journal_id long, next_usn long, run_status string")
    got = {tuple(r) for r in L.journal_pending(journal, cursors).collect()}
    assert got == {("C:", 20), ("C:", 5), (None, 3), ("D:", 4)}
    assert L.journal_pending(journal.limit(0), cursors).count() == 0
    assert L.journal_pending(journal, cursors.limit(0)).count() == 5


def test_listing_pending_edge_cases(spark):
    listing = spark.createDataFrame([("\\\\?\\C:\\a", 1, 1, 1), ("C:\\a", 2, 2, 2), ("C:\\b", 1, 1, 1), ("C:\\new", None, None, 1), (None, 1, 1, 1), ("C:\\n", None, None, 1)], "path string, mtime long, size long, seen_at long")
    indexed = spark.createDataFrame([("C:\\a", 1, 1, 1), ("C:\\b", 9, 9, 1), ("C:\\b", 1, 1, 2), ("C:\\gone", 1, 1, 1), ("C:\\n", None, None, 1)], "path string, mtime long, size long, indexed_at long")
    assert {r.path for r in L.listing_pending(listing, indexed).collect()} == {"C:\\a", "C:\\new"}


def test_small_join_beyond_the_bound_is_salted(spark):
    big = spark.range(200).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    for how in ("left", "inner"):
        assert sorted(map(repr, small_join(big, small, ["k"], how, most=1).select("k", "id", "v").collect())) == sorted(map(repr, big.join(small, "k", how).select("k", "id", "v").collect()))


def test_cursor_usable():
    assert L.cursor_usable('{"journal_id": 1, "next_usn": 5}', 1, 5)
    assert not L.cursor_usable({"journal_id": 1, "next_usn": 4}, 1, 5) and not L.cursor_usable(None, 1, 0) and not L.cursor_usable({"journal_id": 2, "next_usn": 9}, 1, 0)


def test_stale_writer_never_touches_the_winners_output(spark, tmp_path):
    book, clock = make(spark, tmp_path)
    (unit, old), = book.lease(100, 1)
    clock.now = 101
    new = dict(book.lease(100, 5))[unit]
    assert book.process(unit, new, spark.range(2))
    assert not book.process(unit, old, spark.range(7))  # it wrote, but beside the winner
    assert book.results().count() == 2 and states(book)[unit] == "done"


def test_two_coordinators_never_get_one_token(spark, tmp_path):
    book, clock = make(spark, tmp_path)
    other = L.WorkLedger(spark, book.root, clock)
    mine = book.lease(10_000_000, 1)
    assert other.folder.claim(f"claims/{other._key('b')}/1")  # the other one is about to lease b
    assert [u for u, _ in book.lease(10_000_000, 5)] == [] and mine == [("a", 1)]


def test_long_names_and_compaction(spark, tmp_path):
    book, clock = make(spark, tmp_path)
    name = "x" * 400
    book.enqueue(spark.createDataFrame([(name, [1, 1])], "unit string, version array<long>"))
    taken = dict(book.lease(100, 9))
    assert book.process(name, taken[name], spark.range(1)) and book.commit("a", taken["a"], upto=50)
    before = {tuple(map(str, r)) for r in L.fold(book.events()).collect()}
    book.compact()
    assert {tuple(map(str, r)) for r in L.fold(book.events()).collect()} == before and book.results().count() == 1
    book.enqueue(spark.createDataFrame([(name, 5, [2, 1])], "unit string, token long, version array<long>"))
    assert name in {r.unit for r in L.claimable(book.events(), 0).collect()}  # a new version is work again


def test_leases_hold_and_expire_in_the_cursor_table(spark):
    journal = spark.createDataFrame([("C:", 1, 10), ("C:", 1, 20), ("D:", 2, 5)], "volume string, journal_id long, usn long")
    cursors = spark.createDataFrame([(1, "C:", 1, 15, "committed", 0), (2, "C:", 1, None, "running", 1000), (1, "D:", 2, 9, "failed", 0)], "run_id long, volume string, journal_id long, next_usn long, run_status string, started_at long").withColumn("started_at", F.timestamp_seconds("started_at"))
    at = lambda now: {tuple(r) for r in L.journal_items(journal, L.fold(L.cursor_events(cursors)), now).collect()}
    assert at(1_000_000) == {("D:", 5)} and at(L.takeover(cursors)) == {("C:", 20), ("D:", 5)}


def test_safe_cursors(spark):
    runs = spark.createDataFrame([("C:", 1, 1, 10, True), ("C:", 1, 2, 20, True), ("C:", 1, 3, 30, False), ("C:", 1, 4, 40, True), (None, 1, 1, 5, False)], "volume string, journal_id long, run_id long, next_usn long, done boolean")
    assert {(r.volume, r.safe) for r in L.safe_cursors(runs).collect()} == {("C:", 20), (None, None)}
