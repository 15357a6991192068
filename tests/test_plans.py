"""Plans: what reaches the scan, which join is taken, and that relational queries stay out of Python."""

import re

import pytest

from quillon.plans import registry

from .conftest import DATA

#: Functions of one's own and keyed state are Python by their nature.
PYTHON = {"d_aggregate_function", "d_table_function", "t04_reset", "d_inequality_join", "d_merged_aggregate", "r05_link_source"}
STREAMS = {n for n in registry.QUERIES if n.startswith("t0")} | {"d_windowed_counts", "d_interval_join", "k06_emitted_rows", "k06_message_source"} | {n for n in registry.QUERIES if n.startswith("d_stream_")}


def plan(spark, name):
    return registry.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, join", [("d_merge_join", "SortMergeJoin"), ("d_shuffled_hash_join", "ShuffledHashJoin"), ("d_broadcast_join", "BroadcastHashJoin")])
def test_hints_choose_the_join(spark, name, join):
    assert set(re.findall(r"\w+Join\b", plan(spark, name))) == {join}


@pytest.mark.parametrize(
    "name, columns",
    [("a01_grouped_sums", {"l_orderkey", "l_extendedprice", "l_discount"}), ("a02_conditional_counts", {"o_custkey", "o_orderstatus"}), ("a06_extent", {"user_id", "event_type", "value"}), ("o07_distinct", {"p_brand", "p_type"})],
)
def test_scans_read_what_is_needed(spark, name, columns):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan(spark, name))
    assert schemas and all({c.split(":")[0] for c in s.split(",")} == columns for s in schemas)


def test_filters_reach_the_scan(spark):
    assert "EqualTo(event_type,view)" in plan(spark, "o06_concatenation")
    assert "GreaterThan(value,200.0)" in plan(spark, "o06_concatenation")


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - PYTHON - STREAMS))
def test_stays_on_the_jvm(spark, name):
    assert not re.search(r"EvalPython|MapInArrow|MapInPandas|FlatMapGroups|PythonUDTF", plan(spark, name))
    wide = re.findall(r"CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))
    assert not wide or name in {"j06_grid", "o08_padded_rows", "w04_equal_count_buckets_of_all", "w12_successor_of_all", "a08_normalised_power_of_all"}  # regions, or one row
