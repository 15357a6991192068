"""Queries whose results or work went wrong on larger tables."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import dominance
from quillon.plans import registry

from .conftest import DATA


def run(spark, folder, name, **tables):
    for table, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return registry.QUERIES[name](spark, folder)


def test_sets_of_more_users_than_a_sketch_holds(spark, folder):
    """Every third of 30,000 users buys, every second views, and a null user does both."""
    users = spark.range(30_000).select(F.col("id").alias("user_id"))
    kinds = users.filter("user_id % 2 = 0").withColumn("event_type", F.lit("view")).union(users.filter("user_id % 3 = 0").withColumn("event_type", F.lit("purchase")))
    kinds = kinds.unionByName(spark.createDataFrame([(None, "view"), (None, "purchase"), (7, None)], "user_id bigint, event_type string"))
    events = kinds.withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(coalesce(user_id, 0) % 5)"))
    assert run(spark, folder, "d_sketch_sets", events=events).collect() == [(5_001, 10_000, 20_001)]
    assert run(spark, folder, "d_sketch_sets", events=events.limit(0)).collect() == [(0, 0, 0)]


def test_days_beyond_what_an_interval_holds(spark, folder):
    """60 waits of 3.65 million days each are more microseconds than 64 bits hold."""
    orders = spark.sql("SELECT 1L AS o_orderkey, 'x' AS o_orderpriority, timestamp_ntz'0001-01-02 00:00:00' AS o_orderdate")
    lines = spark.range(60).selectExpr("1L AS l_orderkey", "timestamp_ntz'9998-12-31 00:00:00' AS l_shipdate")
    got = run(spark, folder, "d_intervals", orders=orders, lineitem=lines).first()
    days = spark.sql("SELECT datediff(date'9998-12-31', date'0001-01-02')").first()[0]
    assert (got.total_days, got.longest_days, got.late) == (60 * days, days, 60)


def test_no_percentiles_by_part(spark):
    plan = registry.QUERIES["d_approximate"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    by_part = re.findall(r"Aggregate\(keys=\[[^]]*l_partkey.*", plan)
    assert by_part and not any("percentile" in line for line in by_part)


@pytest.mark.parametrize("first, second, same", [("<", ">", False), ("<=", "<", False), (">", "<=", False), (">=", ">=", False), (">=", "<=", True), ("<", "<=", False)])
def test_aggregates_of_inequalities_against_pairs(spark, first, second, same):
    """With stretches in many parts, ties, repeated rows, nulls, NaN and both zeros."""
    ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    rng = random.Random(first + second)
    value = lambda: rng.choice((None, math.nan, 0.0, -0.0, math.inf, rng.randrange(-4, 5) / 2, rng.random()))
    left, right = [(i, value(), value()) for i in range(90)] * 2, [(i, value(), value()) for i in range(70)]
    one, two = spark.createDataFrame(left, "v int, a double, b double"), spark.createDataFrame(right, "id int, x double, y double")
    got = dominance.inequality_aggregate(one, two, ("a", first, "x"), ("a" if same else "b", second, "y"), {"least": (F.min, "v"), "most": (F.max, "v")}, wide=3)
    place = lambda v: (v != v, 0 if v != v else v)
    fits = lambda op, p, q: None not in (p, q) and ops[op](place(p), place(q))
    found = [(i, [v for v, a, b in left if fits(first, a, x) and fits(second, a if same else b, y)]) for i, x, y in right]
    assert got.columns == ["id", "x", "y", "n", "least", "most"]
    assert sorted((r.id, r.n, r.least, r.most) for r in got.collect()) == [(i, len(vs), min(vs), max(vs)) for i, vs in found if vs]
    assert dominance.inequality_aggregate(one.limit(0), two, ("a", first, "x"), ("b", second, "y"), {}).count() == 0


@pytest.mark.parametrize("name", ["d_inequality_join", "d_range_join", "d_range_join_of_any_length"])
def test_no_pairs_are_made(spark, name):
    plan = registry.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CoGroup|_bin|_level|NestedLoop", plan)


def test_wide_ranges_hold_every_pictograph(spark):
    """And letters of most scripts lie outside of them, so the narrow ranges are not asked about those."""
    about, one = (re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), p)) for p in (text._about_pictographs(), text.pictographs().split("(?:")[0]))
    codes = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    assert all(about.match(c) for c in codes if one.match(c))
    assert not any(about.match(c) for c in "aé–ßжλ日本한")
    frame = spark.createDataFrame([("plain",), ("é \U0001f469\u200d\U0001f4bb©!",), ("",), (None,)], "s string")
    assert [r[0] for r in frame.select(text.wrap_pictographs(F.col("s"), "<", ">")).collect()] == ["plain", "é <\U0001f469\u200d\U0001f4bb><©>!", "", None]


def test_resets_without_python_state(spark, folder):
    """Events in any order, a reset between two of one kind, a user without one, null kinds and null users."""
    events = [(1, 5, "view", 10), (2, 5, "error", 20), (3, 5, "view", 30), (4, 5, "signup", 15), (6, 6, "view", 1), (5, 6, "signup", 1), (7, 7, "error", 9), (8, 8, None, 3), (9, None, "view", 4), (11, 9, "error", 5), (12, 9, "view", 5)]
    rows = spark.createDataFrame([(i, u, k, s, 1.0, "{}") for i, u, k, s in reversed(events)], "event_id bigint, user_id bigint, event_type string, s bigint, value double, props string")
    rows = rows.select("event_id", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, s)").alias("ts"), "user_id", "event_type", "value", "props")
    got = run(spark, folder, "t04_reset", events=rows)
    assert sorted(map(tuple, got.collect())) == [(5, 1), (6, 2), (7, 0), (8, 0), (9, 1)]
