"""Streams over several micro-batches: late rows, and state that goes on from batch to batch."""

import os
import time
from datetime import datetime, timedelta

import pytest

from quillon.operators import ranges
from quillon.streaming import event_time, keyed, solved

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
START = datetime(2024, 1, 1, 12)


def batch_file(spark, folder, number, rows):
    """One parquet file for each call, in the order of calls."""
    part = f"{folder}/raw-{number}"
    spark.createDataFrame([(i, START + timedelta(hours=h), u, k, v) for i, h, u, k, v in rows], SCHEMA).coalesce(1).write.parquet(part)
    os.makedirs(f"{folder}/in", exist_ok=True)
    name = next(n for n in os.listdir(part) if n.endswith(".parquet"))
    os.rename(f"{part}/{name}", f"{folder}/in/{number}.parquet")
    os.utime(f"{folder}/in/{number}.parquet", (time.time() - 1000 + number,) * 2)


@pytest.fixture
def batches(spark, folder):
    batch_file(spark, folder, 0, [(1, 0, 7, "view", 200.0), (2, 1, 7, "view", 200.0), (3, 96, 7, "click", 5.0)])
    batch_file(spark, folder, 1, [(5, 97, 7, "click", 5.0), (6, 98, 7, "error", 5.0)])
    # The day of event 4 is long over when it comes; event 7 comes in time.
    batch_file(spark, folder, 2, [(4, 2, 7, "click", 200.0), (7, 99, 7, "signup", 200.0)])
    return solved.read_events(spark, f"{folder}/in/*.parquet", files_a_batch=1)


def test_late_rows_do_not_count(batches, folder):
    got = {(r.start.day, r.event_type): r.n for r in solved.windowed_counts(batches, f"{folder}/out", f"{folder}/check").collect()}
    assert got == {(1, "view"): 2, (5, "click"): 2, (5, "error"): 1, (5, "signup"): 1}


def test_state_goes_on(batches, folder):
    kept = solved.with_resets(batches, f"{folder}/out", f"{folder}/check").collect()
    assert [(r.user_id, r.n_solved) for r in kept] == [(7, 2)]  # after the reset, the signup and the late click


def test_flags_are_set_once(batches, folder):
    got = {r.event_type: r.first_ts for r in solved.flags(solved.accepted(batches), f"{folder}/out", f"{folder}/check").collect()}
    assert set(got) == {"view", "signup"} and got["view"].hour == 12


def test_streams_join_over_batches(batches, folder, spark):
    joined = solved.append_all(solved.interval_join(batches, "click", "view", "200 hours"), f"{folder}/out", f"{folder}/check")
    assert {(r.click_id, r.view_id) for r in joined.select("click_id", "view_id").collect()} >= {(3, 1), (3, 2), (5, 1), (5, 2)}


def test_range_join_at_the_edges(spark):
    points = spark.createDataFrame([(x,) for x in (-10.0, -0.5, 0.0, 9.9, 10.0, 25.0)], "at double")
    spans = spark.createDataFrame([(-10.0, -10.0), (0.0, 10.0), (9.95, 100.0), (5.0, 4.0)], "low double, high double")
    got = sorted((r.at, r.low) for r in ranges.range_join(points, spans, "at", "low", "high", 10.0).collect())
    assert got == [(-10.0, -10.0), (0.0, 0.0), (9.9, 0.0), (10.0, 0.0), (10.0, 9.95), (25.0, 9.95)]


def test_as_of_join_takes_equal_times(spark):
    rows = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 5, 3)], "k string, t int, o int")
    facts = spark.createDataFrame([("a", 5, 1, "x"), ("a", 5, 2, "y"), ("a", 6, 3, "z")], "k string, t int, o int, v string")
    got = {r.o: r.last for r in ranges.as_of_join(rows, facts, "k", "t", "o", "v", "last").collect()}
    assert got == {1: "y", 2: None, 3: None}


def snapshot(df):
    return {r.user_id: (r.kinds, r.n_recent, r.seen) for r in df.collect()}


def batch_answer(rows, watermark, hours=72):
    """What the processor returns, of all rows (event_id, hour, user, kind, value) at once."""
    out = {}
    for user in {r[2] for r in rows}:
        own = [(h, i, k) for i, h, u, k, _ in rows if u == user]
        reset = max((x[:2] for x in own if x[2] == "error"), default=(-1, -1))
        own = [x for x in own if x[:2] > reset and x[2] != "error"]
        n = sum(k == "view" and h + hours > watermark for h, _, k in own)
        out[user] = (sorted({k for _, _, k in own}), n, n > 0)
    return out


def test_keyed_state_goes_on_after_a_restart(spark, folder):
    """Three runs from one checkpoint, each with new files: resets that come late, views that expire, and nothing else."""
    first = [(1, 0, 7, "view", 1.0), (2, 1, 7, "click", 1.0), (3, 2, 8, "view", 1.0), (4, 10, 9, "signup", 1.0), (5, 11, 9, "view", 1.0), (6, 12, 9, "view", 1.0)]
    second = [(8, 11.5, 7, "error", 1.0), (7, 12, 7, "purchase", 1.0), (9, 60, 8, "click", 1.0), (10, 60, 9, "view", 1.0)]
    # At an hour of 76 the view of user 8 has left; event 12 is from before the reset of user 9, which came first.
    third = [(11, 77, 9, "error", 1.0), (13, 77, 8, "view", 1.0)]
    fourth = [(12, 76.5, 9, "click", 1.0), (14, 78, 9, "signup", 1.0), (15, 140, 7, "click", 1.0)]
    seen = []
    for number, rows in enumerate((first, second, third, fourth)):
        batch_file(spark, folder, number, rows)
        got = keyed.progress(solved.read_events(spark, f"{folder}/in/*.parquet", files_a_batch=1), f"{folder}/out", f"{folder}/check")
        seen += rows
        assert snapshot(got) == batch_answer(seen, max(r[1] for r in seen) - 1), number
    assert keyed.PROVIDER != spark.conf.get("spark.sql.streaming.stateStore.providerClass")  # other queries keep theirs


def test_keyed_state_in_one_run(spark, folder):
    """Several micro-batches of one run, and an event that is later than the watermark allows."""
    rows = [[(1, 0, 7, "view", 1.0), (2, 50, 7, "click", 1.0)], [(3, 51, 7, "signup", 1.0)], [(4, 2, 7, "purchase", 1.0), (5, 52, 8, "view", 1.0), (6, 51.5, 8, "view", 1.0)]]
    for number, part in enumerate(rows):
        batch_file(spark, folder, number, part)
    got = snapshot(keyed.progress(solved.read_events(spark, f"{folder}/in/*.parquet", files_a_batch=1), f"{folder}/out", f"{folder}/check"))
    assert got == batch_answer([r for part in rows for r in part if r[0] != 4], 51)


def runs(spark, folder, parts, stream):
    """Rows that have come out after each of several runs from one checkpoint, each with a new file."""
    for number, rows in enumerate(parts):
        batch_file(spark, folder, number, rows)
        yield solved.append_all(stream(solved.read_events(spark, f"{folder}/in/*.parquet", files_a_batch=1)), f"{folder}/out", f"{folder}/check").collect()


def test_copies_within_the_watermark(spark, folder):
    parts = [
        [(1, 0, 7, "view", 1.0), (1, 0, 7, "view", 1.0), (2, 0.5, 7, "view", 1.0)],
        [(1, 0, 7, "view", 1.0), (2, 0.5, 7, "view", 1.0), (3, 9, 7, "view", 1.0)],  # copies after a restart
        [(3, 9, 8, "view", 1.0), (4, 1, 7, "view", 1.0), (5, 9.5, 7, "view", 1.0)],  # event 4 is later than the watermark
    ]
    got = [sorted(r.event_id for r in rows) for rows in runs(spark, folder, parts, lambda e: event_time.different(e, ["event_id"]))]
    assert got[0] == [1, 2] and got[1] == [1, 2, 3] and got[2] in ([1, 2, 3, 5], [1, 2, 3, 4, 5])


def test_sessions_close_behind_the_watermark(spark, folder):
    parts = [
        [(1, 0, 7, "view", 1.0), (2, 1, 7, "view", 1.0), (3, 0, 8, "view", 1.0)],
        [(4, 2, 7, "view", 1.0), (5, 1.5, 8, "view", 1.0), (6, 2.5, 7, "view", 1.0)],  # both go on after a restart, 8 by a late row
        [(7, 20, 9, "view", 1.0)],
        [(8, 1, 8, "view", 1.0), (9, 40, 9, "view", 1.0)],  # the session of event 8 is over
    ]
    *_, third, last = runs(spark, folder, parts, lambda e: event_time.sessions(e, "user_id", "2 hours"))
    key = lambda rows: sorted((r.user_id, r.n) for r in rows)
    assert key(third) == [(7, 4), (8, 2)] and key(last) == [(7, 4), (8, 2), (9, 1)]


def test_streams_join_outer(spark, folder):
    parts = [
        [(1, 0, 7, "view", 1.0), (2, 1, 7, "purchase", 1.0), (3, 1, 8, "purchase", 1.0)],
        [(4, 0.5, 8, "view", 1.0), (5, 2, 9, "purchase", 1.0)],  # meets event 3 after a restart
        [(6, 30, 7, "view", 1.0), (7, 30, 7, "purchase", 1.0)],  # event 5 stays alone
        [(8, 60, 7, "view", 1.0), (9, 60, 8, "purchase", 1.0)],
    ]
    got = [sorted((r.purchase_id, r.view_id) for r in rows) for rows in runs(spark, folder, parts, lambda e: event_time.left_outer(e, "purchase", "view", "6 hours"))]
    assert got[0] == [(2, 1)] and got[1] == [(2, 1), (3, 4)]
    assert got[3] == [(2, 1), (3, 4), (5, None), (7, 6)]
