"""Data sources of one's own: partitions, filters that reach the reader, and offsets."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillon.sources import connectors
from quillon.streaming import solved


@pytest.fixture
def pages(spark, folder):
    connectors.register(spark)
    html = lambda i: None if i == 3 else f'<a href="/é{i}">one</a> text <a href="/b">two {i}</a>' if i % 2 else "none"
    for part in range(2):
        ids = list(range(part * 20, part * 20 + 20))
        pq.write_table(pa.table({"page_id": pa.array(ids, pa.int64()), "html": [html(i) for i in ids], "url": ["u"] * 20}), f"{folder}/{part}.parquet", row_group_size=5)
    return folder, sorted((i, pos, href, label) for i in range(40) if i % 2 and i != 3 for pos, (href, label) in enumerate(((f"/é{i}", "one"), ("/b", f"two {i}"))))


def test_links(spark, pages):
    folder, expected = pages
    links = spark.read.format("quillon_links").option("path", f"file://{folder}").load()
    assert sorted(map(tuple, links.collect())) == expected
    assert links.rdd.getNumPartitions() == 8  # one for each row group


@pytest.mark.parametrize(
    "condition, groups, keep",
    [("page_id = 7", 1, lambda r: r[0] == 7), ("page_id >= 30 AND label = 'one'", 2, lambda r: r[0] >= 30 and r[3] == "one"), ("page_id IN (1, 39)", 2, lambda r: r[0] in (1, 39)), ("page_id < 0", 1, lambda r: False), ("page_id = 7 OR pos = 1", 8, lambda r: r[0] == 7 or r[1] == 1)],
)
def test_filters_reach_the_reader(spark, pages, condition, groups, keep):
    folder, expected = pages
    links = spark.read.format("quillon_links").option("path", folder).load().filter(condition)
    assert sorted(map(tuple, links.collect())) == [r for r in expected if keep(r)]
    assert links.rdd.getNumPartitions() == groups


def test_reader_takes_what_it_can_use(pages):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = connectors.LinkReader(pages[0])
    left = list(reader.pushFilters([GreaterThan(("page_id",), 34), EqualTo(("label",), "one")]))
    assert left == [EqualTo(("label",), "one")] and reader.conditions == [(">", 34)]
    assert [(p.path[-9:], p.group) for p in reader.partitions()] == [("1.parquet", 3)]


def test_jobs(spark, folder):
    connectors.register(spark)
    jobs = [[{"html": "a.html", "out": "x/one.png"}, {"html": "b.html", "out": "two.png", "width": 0, "dpr": 2}], [{"html": "c.html", "out": "x/three.png", "height": 5, "selector": ".s", "other": 1}, {"html": "d.html"}]]
    for i, part in enumerate(jobs):
        with open(f"{folder}/{i}.json", "w") as out:
            json.dump(part, out)
    rows = spark.read.format("quillon_jobs").option("path", folder).load()
    assert rows.rdd.getNumPartitions() == 2
    got = {r.html: (r.out, r.width, r.height, r.dpr, r.selector) for r in rows.collect()}
    assert got == {"a.html": ("x/one.png", 1000, 800, 1.0, None), "b.html": ("two.png", 1000, 800, 2.0, None), "c.html": ("x/three.png", 1000, 5, 1.0, ".s"), "d.html": (None, 1000, 800, 1.0, None)}
    some = rows.filter(F.contains("out", F.lit("x/")))
    assert sorted(r.html for r in some.collect()) == ["a.html", "c.html"]


def test_messages_resume(spark, folder):
    """Each run reads the files that have come since the one before, and messages are as Spark would write them."""
    connectors.register(spark)

    def write(number, rows):
        columns = zip(*rows)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64())
        pq.write_table(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["event_id", "event_type", "user_id", "value"]), f"{folder}/{number}.parquet", row_group_size=2)

    message = F.to_json(F.struct(F.col("event_type").alias("tipo"), F.col("user_id").alias("id"), (F.col("value") > 100).alias("ok")))
    parts = [[(1, "view", 7, 200.0), (2, 'qu"ote\\', 8, 5.0), (3, None, None, None)], [(4, "é", 9, 100.0)], [(5, "view", 1, 101.0)]]
    seen = 0
    for number, rows in enumerate(parts):
        write(number, rows)
        stream = spark.readStream.format("quillon_messages").option("path", folder).load()
        got = solved.append_all(stream, f"{folder}/out", f"{folder}/check")
        seen += len(rows)
        expected = spark.read.parquet(*[f"{folder}/{i}.parquet" for i in range(number + 1)]).select("event_id", message.alias("message"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())) and got.count() == seen
