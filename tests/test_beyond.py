"""Graph traversal, inequality joins and sketches against plain loops."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import aggregates, graphs, inequality, ranges, sketches

from .conftest import DATA


def reach(edges, node):
    """Fewest edges from node to every node that can be reached."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    found, frontier, hops = {}, {node}, 0
    while frontier:
        hops += 1
        frontier = {y for x in frontier for y in after.get(x, ())} - set(found)
        found |= dict.fromkeys(frontier, hops)
    return found


@pytest.mark.parametrize("hub", [3])
def test_graphs_against_loops(spark, hub):
    rng = random.Random(hub)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(46)] + [(50, 51), (51, 50), (52, 52), (53, 54)]
    edges += [(60, x) for x in range(61, 80)] + [(70, 60)] + edges[:5]  # a hub on a cycle; repeated edges
    frame = spark.createDataFrame([(a, b, "x") for a, b in edges] + [(None, 3, "x"), (4, None, "x")], "src int, dst int, next string")
    nodes = {x for e in edges for x in e}
    pairs = {(a, b): h for a in nodes for b, h in reach(edges, a).items()}
    got = graphs.closure(frame, hub).collect()
    assert len(got) == len(pairs) and {(r.src, r.dst): r.hops for r in got} == pairs
    seeds = [0, 60, 99]
    expected = {s: 0 for s in seeds}
    for s in seeds:
        for b, h in reach(edges, s).items():
            expected[b] = min(h, expected.get(b, h))
    got = graphs.levels(frame, spark.createDataFrame([(s,) for s in [*seeds, 0]] + [(None,)], "node int"), hub).collect()
    assert len(got) == len(expected) and {r.node: r.level for r in got} == expected
    on_cycle = {a: min(b for b in nodes if (a, b) in pairs and (b, a) in pairs) for a in nodes if (a, a) in pairs}
    got = graphs.cycles(frame, hub).collect()
    assert len(got) == len(on_cycle) and {r.node: r.component for r in got} == on_cycle


def test_graphs_of_nothing(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert graphs.closure(none).count() == graphs.cycles(none).count() == 0
    assert graphs.levels(none, spark.createDataFrame([("a",)], "node string")).collect() == [("a", 0)]


def test_rounds_go_on_from_passages(spark, monkeypatch):
    """Nodes that no edge leads to go through no round, however many there are; ways beyond what is told to all tasks agree."""
    edges = [(1000 + i, i % 3) for i in range(300)] + [(i, i + 1) for i in range(8)]
    pairs = {(a, b): h for a in {a for a, _ in edges} for b, h in reach(edges, a).items()}
    frame = spark.createDataFrame(edges, "src int, dst int")
    sizes, held = [], graphs.held

    def counted(df):
        rows = held(df)
        sizes.append(rows.count() if "hops" in df.columns else 0)
        return rows

    for told in (graphs.TOLD, 3):
        monkeypatch.setattr(graphs, "TOLD", told, raising=False)
        monkeypatch.setattr(graphs, "held", counted)
        sizes.clear()
        got = graphs.closure(frame).collect()
        assert len(got) == len(pairs) and {(r.src, r.dst): r.hops for r in got} == pairs
        assert sum(sizes) <= 8 * 8


def test_rounds_leave_no_lineage(spark):
    """The plan of what a long way has found reads files alone."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "src int, dst int")
    plan = graphs.levels(chain, spark.createDataFrame([(0,)], "node int"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def spark_order(v):
    return (isinstance(v, float) and math.isnan(v), 0 if isinstance(v, float) and math.isnan(v) else v)


@pytest.mark.parametrize("first, second", list(itertools.product(OPS, OPS)))
def test_places_of_matches(first, second):
    """The bit array against all pairs, with ties."""
    rng = np.random.default_rng(len(first) * 7 + len(second))
    for n, m in ((0, 3), (3, 0), (1, 1), (40, 25)):
        one, two, x, y = (rng.integers(0, 8, k) for k in (n, n, m, m))
        got = sorted((i, j) for left, right in inequality.matches(one, two, x, y, first, second) for i, j in zip(left.tolist(), right.tolist()))
        assert got == [(i, j) for i in range(n) for j in range(m) if OPS[first](one[i], x[j]) and OPS[second](two[i], y[j])]


@pytest.mark.parametrize("kinds, ops", [(("double", "bigint"), ("<", ">=")), (("string", "date"), (">=", "<")), (("timestamp_ntz", "decimal(9,2)"), (">", ">"))])
def test_inequality_join_against_pairs(spark, kinds, ops):
    from datetime import date, datetime, timedelta
    from decimal import Decimal

    rng = random.Random(ops[0])
    make = {
        "double": lambda: rng.choice((None, math.nan, math.inf, -1.5, 0.0, rng.random())), "bigint": lambda: rng.choice((None, rng.randrange(-5, 5))), "string": lambda: rng.choice((None, "", "é", "a", "ab")),
        "date": lambda: date(2024, 1, 1) + timedelta(days=rng.randrange(5)), "timestamp_ntz": lambda: datetime(2024, 1, 1) + timedelta(hours=rng.randrange(5)), "decimal(9,2)": lambda: Decimal(rng.randrange(5)) / 4,
    }
    left = [(i, make[kinds[0]](), make[kinds[1]]()) for i in range(60)]
    right = [(i, make[kinds[0]](), make[kinds[1]]()) for i in range(45)] * 2  # repeated rows
    frames = [spark.createDataFrame(rows, f"{p}id int, {p}a {kinds[0]}, {p}b {kinds[1]}") for p, rows in (("l", left), ("r", right))]
    got = inequality.inequality_join(*frames, ("la", ops[0], "ra"), ("lb", ops[1], "rb"), block=8, few=1000 if kinds[0] == "string" else 9)  # or blocks of blocks
    assert got.columns == ["lid", "la", "lb", "rid", "ra", "rb"]
    fits = lambda op, a, b: a is not None and b is not None and OPS[op](spark_order(a), spark_order(b))
    expected = sorted((i, j) for i, a, b in left for j, x, y in right if fits(ops[0], a, x) and fits(ops[1], b, y))
    assert sorted((r.lid, r.rid) for r in got.collect()) == expected
    assert inequality.inequality_join(frames[0].limit(0), frames[1], ("la", ops[0], "ra"), ("lb", ops[1], "rb")).count() == 0


def overlapping(spark, rows, block):
    """Pairs of intervals that overlap, and how many pairs of rows the tasks have looked at."""
    left = spark.createDataFrame(rows, "id int, low double, high double")
    right = left.select(F.col("id").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    return inequality.inequality_join(left, right, ("low", "<=", "other_high"), ("high", ">=", "other_low"), block=block)


def test_a_few_very_long_intervals(spark, monkeypatch):
    """Intervals a thousand times the median, and no nested loop; most pairs of blocks are ruled out all the same."""
    rng = random.Random(1)
    rows = [(i, at, at + rng.random()) for i, at in enumerate(rng.random() * 2_000 for _ in range(600))]
    rows += [(1000 + i, at, at + 1_000) for i, at in enumerate((0.0, 300.0, 900.0))]
    seen = []
    meeting = inequality._meeting
    monkeypatch.setattr(inequality, "_meeting", lambda left, right, *ops: seen.append((len(left) * len(right), met := meeting(left, right, *ops))) or met)
    got = overlapping(spark, rows, 16)
    assert sorted((r.id, r.other) for r in got.collect()) == sorted((a[0], b[0]) for a in rows for b in rows if a[1] <= b[2] and a[2] >= b[1])
    total, met = seen[0]
    assert len(met) < 0.5 * total
    assert not re.search(r"CartesianProduct|NestedLoop", got._jdf.queryExecution().executedPlan().toString())


def test_sketches_merge_as_one(spark):
    rows = spark.range(30_000).select(F.pmod("id", F.lit(7)).cast("int").alias("day"), F.pmod("id", F.lit(20_011)).alias("who"), (F.col("id") % 1000).cast("double").alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(6, None, None), (9, None, None)], "day int, who bigint, v double"))
    by_day = sketches.sketched(rows, ["day"], "who", "v")
    got = sketches.merged(by_day, []).select("n", sketches.distinct_by_hll("hll").alias("hll"), sketches.distinct_by_theta("theta").alias("theta"), sketches.quantile("kll", 0.5).alias("middle")).first()
    again = sketches.merged(sketches.merged(by_day, [F.pmod("day", F.lit(2)).alias("odd")]), []).select(sketches.distinct_by_theta("theta").alias("theta"), sketches.distinct_by_hll("hll").alias("hll")).first()
    assert got.n == 30_002 and abs(got.hll - 20_011) < 0.06 * 20_011 and abs(got.theta - 20_011) < 0.06 * 20_011 and abs(got.middle - 500) < 30
    assert (again.theta, again.hll) == (got.theta, got.hll)
    lone = by_day.filter("day = 9").select(sketches.distinct_by_hll("hll").alias("h"), sketches.distinct_by_theta("theta").alias("t")).first()
    assert (lone.h, lone.t) == (0, 0)


@pytest.mark.parametrize("name", ["d_inequality_join", "m17_levels", "m17_reachable", "m17_cycles", "d_sketch_rollup"])
def test_plans_join_by_keys(spark, name):
    from quillon.plans import registry

    plan = registry.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|NestedLoop", plan)


def test_places_when_all_rows_share_a_day(spark):
    """All rows of one day, and many of one time: ranges stay even, as later order columns split ties."""
    rows = spark.range(20_000).select(F.pmod(F.col("id") * 7919, F.lit(20_000)).alias("id"), F.lit("2024-01-01").cast("date").alias("day"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("ordinal_"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        placed = ranges.places(rows, ["day", "ordinal_", "id"])
        got = placed.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted(got, key=lambda r: (r.day, r.ordinal_, r.id))
    assert [r.ordinal for r in order] == list(range(1, 20_001)) and placed.columns == ["id", "day", "ordinal_", "ordinal"]
    files = placed.inputFiles()
    sizes = sorted(spark.read.parquet(f).count() for f in files)
    assert len(sizes) == 16 and sizes[-1] < 2 * sizes[8]


def test_places_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, 1), (None, 1), (3, 2), (1, None), (1, 0)], "a int, _row int")
    got = sorted((r.ordinal, r.a, r._row) for r in ranges.places(rows, ["a", "_row"]).collect())
    assert got == [(1, None, 1), (2, None, 1), (3, 1, None), (4, 1, 0), (5, 3, 2)]
    assert ranges.places(rows.limit(0), ["a"]).count() == 0


def test_spans_of_matches(spark):
    pattern = r"\b[0-9]{1,2}-[IVX]+-[0-9]{4}\b"
    texts = ["9-VI-2000", "x 9-VI-2000 9-VI-2000,9-VI-2000", "19-VI-2000 and 9-VI-2000", "129-VI-2000 29-VI-2000", "é9-VI-20001 9-VI-2000", "none", "", None]
    got = {r.t: r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.match_spans(F.col("t"), pattern).alias("m")).collect()}
    for t in texts[:-1]:
        assert [(m.found, m.start) for m in got[t]] == [(m[0], m.start()) for m in re.finditer(pattern.replace("\\b", r"(?<![0-9A-Za-z_])", 1).replace("\\b", r"(?![0-9A-Za-z_])"), t)], t
    assert got[None] is None


def test_samples_merge_in_any_order(spark):
    """States of any split of the rows, merged in any order, are one; ranks are near."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    digests = pa.array([f"{x:016x}" for x in rng.integers(0, 1 << 62, 5_000)])
    sample = aggregates.Sample(300)
    whole = sorted(digests.take(sample.kept(digests)).to_pylist())
    for _ in range(3):
        parts = [digests.take(pa.array(p)) for p in np.array_split(rng.permutation(5_000), 7)]
        held = None
        for i in rng.permutation(7):
            both = parts[i] if held is None else pa.concat_arrays([held, parts[i]])
            held = both.take(sample.kept(both))
        assert sorted(held.to_pylist()) == whole
    rows = spark.range(9_000).select((F.col("id") % 3).alias("kind"), F.col("id").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("d"))
    rows = rows.unionByName(spark.createDataFrame([(None, 5, "a"), (None, None, "b"), (9, None, "c")], "kind bigint, v bigint, d string"))
    seen = []
    for parts in (1, 5, 40):
        got = aggregates.sampled_quantiles(rows.repartition(parts), "kind", F.col("d"), "v", [0.1, 0.5, 0.9], k=400).collect()
        seen.append(sorted(map(str, got)))
        for r in got:
            if r.kind is None:
                assert (r.n, r.sampled, r.quantiles) == (1, 1, [5.0, 5.0, 5.0])
            else:
                assert r.n == 3_000 and r.sampled == 400 and all(abs(q / 9_000 - share) < 0.08 for q, share in zip(r.quantiles, (0.1, 0.5, 0.9)))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 4
    assert aggregates.sampled_quantiles(rows.limit(0), "kind", F.col("d"), "v", [0.5]).count() == 0


def test_range_join_of_any_length(spark):
    """Points and intervals over many orders of magnitude, with ends that touch, repeated, infinite and odd ones."""
    rng = random.Random(3)
    numbers = [0.0, -0.0, 1.0, -1.0, 0.5, 1e-300, 1e300, -1e12, 1e12, 2.0**52, math.inf, -math.inf, math.nan, None] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 7) for _ in range(120)]
    spans = [(a, a + rng.choice((0.0, 1e-9, 1.0, 1e3, 1e9))) for a in numbers if a is not None] + [(3.0, 2.0), (None, 1.0), (1.0, None), (-math.inf, math.inf), (0.0, math.inf), (-math.inf, 1.0)]
    points = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "p int, at double")
    frames = spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "s int, low double, high double")
    expected = sorted((i, j) for i, x in enumerate(numbers) for j, (a, b) in enumerate(spans) if None not in (x, a, b) and a <= x <= b)
    got = ranges.range_join(points, frames, "at", "low", "high")
    assert sorted((r.p, r.s) for r in got.collect()) == expected and got.columns == ["p", "at", "s", "low", "high"]
    assert ranges.range_join(points, frames.limit(0), "at", "low", "high").count() == 0
    assert not re.search(r"CartesianProduct|NestedLoop", got._jdf.queryExecution().executedPlan().toString())


def test_as_of_join_by_stretches(spark):
    """Stretches of time give what one window gives: first rows of a stretch, equal times, null keys and values, keys without facts."""
    rng = random.Random(4)
    make = lambda n: [(rng.choice("aab") if rng.random() > 0.1 else None, rng.randrange(60), i, rng.choice((None, f"v{i}"))) for i in range(n)]
    rows, facts = make(200) + [("none", 5, 999, "x")], make(40)
    frames = [spark.createDataFrame(x, "k string, t int, o int, v string") for x in (rows, facts)]
    frames[0] = frames[0].drop("v")
    plain = ranges.as_of_join(*frames, "k", "t", "o", "v", "last")
    cut = ranges.as_of_join(*frames, "k", "t", "o", "v", "last", lambda c: F.floor(c / 7))
    assert cut.columns == plain.columns == ["k", "t", "o", "last"]
    got = {r.o: r.last for r in cut.collect()}
    for k, t, o, _ in rows:
        before = [(x[1], x[2], x[3]) for x in facts if x[0] == k and k is not None and x[1] <= t and x[3] is not None]
        if k is not None:
            assert got[o] == (max(before)[2] if before else None), (k, t, o)
    assert len(got) == len(rows) == cut.count()


def test_pictographs_by_property(spark):
    """The pattern for the JVM against the property itself, over every code point below the private planes and some sequences."""
    import regex

    texts = ["".join(chr(c) for c in range(a, min(a + 512, 0x20000)) if not 0xD800 <= c < 0xE000 and c not in (0xFE0F, 0x200D)) for a in range(0, 0x20000, 512)]
    texts += ["a\U0001f469‍\U0001f4bbb\U0001f469‍x", "❤️️❤", "‍\U0001f44d‍‍\U0001f44d", "1️⃣ \U0001f1ea\U0001f1f8", ""]
    plain = regex.compile("(\\p{Extended_Pictographic}(️|‍\\p{Extended_Pictographic})*)")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t], "i int, t string").select("i", text.wrap_pictographs(F.col("t"), "<", ">").alias("w")).collect()
    assert {r.i: r.w for r in rows} == {i: plain.sub(r"<\1>", t) for i, t in enumerate(texts) if t}
