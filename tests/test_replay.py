import random
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.operators import replay as R

SCHEMA = "s string, seq long, k long, gone boolean, txn string, parts int, v string"


def feed(txn=False):
    return R.Feed(("s",), "seq", ("k",), F.coalesce(F.col("gone"), F.lit(False)), 1, "txn" if txn else None, "parts" if txn else None)


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_out_of_order_and_repeated(spark):
    data = [("a", 3, 1, None, None, None, "new"), ("a", 1, 1, False, None, None, "old"), ("a", 2, 2, True, None, None, ""), ("a", 3, 1, None, None, None, "new"), ("a", None, 5, False, None, None, ""), ("a", 4, None, False, None, None, "")]
    assert [tuple(r) for r in R.state(rows(spark, data), feed(), "v", closed=True).collect()] == [("a", 1, 3, "new")]


def test_gap_holds_what_comes_after(spark):
    data = [("a", 1, 1, False, None, None, "x"), ("a", 2, 2, False, None, None, "x"), ("a", 4, 1, True, None, None, "x"), ("b", 9, 7, False, None, None, "x")]
    got = {tuple(r)[:3] for r in R.state(rows(spark, data), feed(), closed=False).select("s", "k", "seq").collect()}
    assert got == {("a", 1, 1), ("a", 2, 2), ("b", 7, 9)}
    assert {tuple(r) for r in R.state(rows(spark, data), feed(), closed=True).collect()} == {("a", 2, 2), ("b", 7, 9)}


def test_incomplete_transaction_stays_out(spark):
    data = [("a", 1, 1, False, "t1", 2, "x"), ("a", 2, 2, False, "t1", 2, "x"), ("a", 3, 1, True, "t2", 2, "x")]
    assert {r.k for r in R.state(rows(spark, data), feed(True), closed=True).collect()} == {1, 2}
    more = [*data, ("a", 4, 3, False, "t2", 2, "x")]
    assert {r.k for r in R.state(rows(spark, more), feed(True), closed=False).collect()} == {2, 3}


def test_empty(spark):
    assert R.state(rows(spark, []), feed(), closed=False).count() == 0
    assert R.watermarks(rows(spark, []), feed()).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 3), st.booleans()), max_size=20))
def test_same_as_replay_in_order(spark, events):
    once = {s: (k, g) for s, k, g in events}
    want, mark = {}, min(once, default=0)
    while mark + 1 in once:
        mark += 1
    for s in sorted(once):
        if s > mark:
            break
        k, g = once[s]
        want.pop(k, None)
        if not g:
            want[k] = s
    data = [("a", s, k, g, None, None, "") for s, (k, g) in once.items()] * 2
    got = {r.k: r.seq for r in R.state(rows(spark, data[::-1]), feed(), closed=False).collect()}
    assert got == want


def test_watermark_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 4)
    data = [("a", s, 1, False, None, None, "") for s in [*range(1, 23), *range(25, 31)]] + [("b", s, 1, False, None, None, "") for s in range(3, 40)]
    assert {tuple(r) for r in R.watermarks(rows(spark, data), feed()).collect()} == {("a", 1, 22, 30), ("b", 3, 39, 39)}


@pytest.mark.parametrize("with_txn", [False, True])
def test_replica_over_many_runs_equals_one_replay(spark, tmp_path, with_txn):
    rng = random.Random(5)
    data = []
    for s in ("a", None):
        for seq in range(1, 25):
            if seq != 17:  # a gap that is filled in the last run
                data.append((s, seq, rng.randrange(4), rng.random() < 0.3, f"t{(seq + 1) // 2}", 2, f"v{seq}"))
    rng.shuffle(data)
    missing = [(s, 17, 1, False, "t9", 2, "v17") for s in ("a", None)]
    runs = [data[:20], data[15:40], data[40:] + data[:3], missing]
    f = replace(feed(with_txn), first=1)
    replica = R.Replica(spark, f"file://{tmp_path}/r", f, "v")
    so_far = []
    for run in runs:
        so_far += run
        replica.apply(rows(spark, run))
        want = {tuple(r) for r in R.state(rows(spark, so_far), f, "v").collect()} if run is runs[-1] else None
        got = {tuple(r) for r in replica.table().collect()}
        assert want is None or got == want
    assert replica.apply(rows(spark, runs[0])) == 5 and {tuple(r) for r in replica.table().collect()} == want  # known records change nothing


def test_end_of_feed_lifts_the_watermark(spark, tmp_path):
    replica = R.Replica(spark, f"file://{tmp_path}/r", feed())
    replica.apply(rows(spark, [("a", 1, 1, False, None, None, ""), ("a", 3, 2, False, None, None, "")]))
    assert {r.k for r in replica.table().collect()} == {1}
    replica.apply(rows(spark, []), spark.createDataFrame([("a", 3)], "s string, end long"))
    assert {r.k for r in replica.table().collect()} == {1, 2}
