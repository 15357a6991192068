"""Scans and scrapes (R01-R08) and what the sinks write (K01-K08), as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import escape_html
from ..operators.sequences import latest
from ..sources import connectors
from .registry import query, sql_query, table


@query("r01_catalogue", "SELECT r_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS pos, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def catalogue(spark, sf_dir):
    """A nested catalogue (regions with their nations) and its pieces listed again with their places."""
    nested = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("pieces"))
    stages = table(spark, sf_dir, "region").join(nested, F.col("r_regionkey") == F.col("n_regionkey"))
    return stages.select("r_name", F.posexplode("pieces").alias("pos", "p")).select("r_name", F.col("pos").cast("long").alias("pos"), "p.n_name")


@query("r02_inline_config", r"SELECT page_id, CAST(nullif(regexp_extract(html, '<script>.*?track\(([0-9]+)\);</script>', 1), '') AS BIGINT) AS track FROM pages WHERE html LIKE '%<script>%'")
def inline_config(spark, sf_dir):
    """A number set in a page's own script; pages without a script give no row."""
    found = F.regexp_extract("html", r"<script>.*?track\(([0-9]+)\);</script>", 1)
    return table(spark, sf_dir, "pages").filter(F.contains("html", F.lit("<script>"))).select("page_id", F.nullif(found, F.lit("")).cast("long").alias("track"))


@query("r03_jobs", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, coalesce(CAST(json_extract(props, '$.width') AS BIGINT), 1000) AS width FROM events")
def jobs(spark, sf_dir):
    """JSON objects with optional fields and defaults for those that are absent."""
    job = F.from_json("props", "k bigint, width bigint").alias("j")
    return table(spark, sf_dir, "events").select("event_id", job).select("event_id", F.coalesce("j.k", F.lit(0)).alias("k"), F.coalesce("j.width", F.lit(1000)).alias("width"))


_LINK = '<a href="([^"]*)">([^<]*)</a>'


@query(
    "r05_link_scrape",
    f"""
    WITH l AS (SELECT page_id, regexp_extract_all(html, '{_LINK}', 1) AS h, regexp_extract_all(html, '{_LINK}', 2) AS t FROM pages)
    SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS href, unnest(t) AS label FROM l
    """,
)
def link_scrape(spark, sf_dir):
    every = lambda group: F.regexp_extract_all("html", F.lit(_LINK), F.lit(group))
    rows = F.arrays_zip(every(1).alias("href"), every(2).alias("label"))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(rows).alias("pos", "l")).select("page_id", F.col("pos").cast("long").alias("pos"), "l.href", "l.label")


@query(
    "r05_link_source",
    f"""
    WITH l AS (SELECT page_id, regexp_extract_all(html, '{_LINK}', 1) AS h, regexp_extract_all(html, '{_LINK}', 2) AS t FROM pages)
    SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS href, unnest(t) AS label FROM l
    """,
)
def link_source(spark, sf_dir):
    """The links by a data source of one's own."""
    connectors.register(spark)
    return spark.read.format("quillon_links").option("path", f"{sf_dir}/pages.parquet").load()


@query(
    "r06_nested_scrape",
    """
    WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '<ul>(.*?)</ul>', 1)) AS block FROM pages)
    SELECT page_id, len(regexp_extract_all(block, '<li>(.*?)</li>', 1)) AS items FROM r
    """,
)
def nested_scrape(spark, sf_dir):
    """A match for each list of a page, and within it one for each item."""
    blocks = F.explode(F.regexp_extract_all("html", F.lit("<ul>(.*?)</ul>"), F.lit(1))).alias("block")
    items = F.size(F.regexp_extract_all("block", F.lit("<li>(.*?)</li>"), F.lit(1))).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", blocks).select("page_id", items.alias("items"))


@query(
    "r07_url_parameter",
    "SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), '1') AS page, coalesce(nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), ''), 'none') AS ref FROM pages",
)
def url_parameter(spark, sf_dir):
    value = lambda key, default: F.coalesce(F.nullif(F.try_parse_url("url", F.lit("QUERY"), F.lit(key)), F.lit("")), F.lit(default))
    return table(spark, sf_dir, "pages").select("page_id", value("page", "1").alias("page"), value("ref", "none").alias("ref"))


sql_query(
    "r08_lookup_or_null",
    "SELECT c.c_custkey, e.value FROM {customer} c LEFT JOIN (SELECT user_id, max(value) AS value FROM {events} WHERE event_type = 'purchase' GROUP BY user_id) e ON c.c_custkey = e.user_id",
)


@query(
    "k01_page_writer",
    """SELECT r_regionkey, '<!doctype html><title>' || replace(replace(r_name, '&', '&amp;'), '<', '&lt;') || '</title><script>var D=' || to_json({'r_regionkey': r_regionkey, 'r_name': r_name}) || '</script>' AS html FROM region""",
)
def page_writer(spark, sf_dir):
    """The text of a page with its configuration embedded; sources.sinks.write_pages stores one file for each."""
    data = F.to_json(F.struct("r_regionkey", "r_name"))
    html = F.concat(F.lit("<!doctype html><title>"), escape_html(F.col("r_name")), F.lit("</title><script>var D="), data, F.lit("</script>"))
    return table(spark, sf_dir, "region").select("r_regionkey", html.alias("html"))


@query("k02_catalogue_json", "SELECT n_regionkey, to_json(list({'id': n_nationkey, 'name': n_name} ORDER BY n_nationkey)) AS body FROM nation GROUP BY n_regionkey")
def catalogue_json(spark, sf_dir):
    pieces = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(pieces).alias("body"))


@query("k05_latest_by_key", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def latest_by_key(spark, sf_dir):
    return latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])


@query(
    "k05_reset",
    """
    WITH r AS (SELECT user_id, max((ts, event_id)) FILTER (event_type = 'error') AS reset_at FROM events GROUP BY user_id)
    SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events JOIN r USING (user_id)
    WHERE event_type <> 'error' AND (reset_at IS NULL OR (ts, event_id) > reset_at) GROUP BY user_id, event_type
    """,
)
def reset(spark, sf_dir):
    """Latest values after the last reset of each user."""
    events = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    resets = events.filter("event_type = 'error'").groupBy("user_id").agg(F.max("o").alias("at"))
    kept = events.filter("event_type <> 'error'").join(resets, "user_id", "left").filter("at is null or o > at")
    return latest(kept, ["user_id", "event_type"], ["ts", "event_id"], ["value"])


@query("k06_event_rows", """SELECT event_id, to_json({'tipo': event_type, 'id': user_id, 'ok': value > 100}) AS message FROM events""")
def event_rows(spark, sf_dir):
    message = F.to_json(F.struct(F.col("event_type").alias("tipo"), F.col("user_id").alias("id"), (F.col("value") > 100).alias("ok")))
    return table(spark, sf_dir, "events").select("event_id", message.alias("message"))


@query("k08_sidecar", "SELECT p_brand, to_json({'small': min(p_size), 'large': max(p_size), 'n': count(*)}) AS sidecar FROM part GROUP BY p_brand")
def sidecar(spark, sf_dir):
    facts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").alias("small"), F.max("p_size").alias("large"), F.count("*").alias("n"))
    return facts.select("p_brand", F.to_json(F.struct("small", "large", "n")).alias("sidecar"))


@query("m17_edges", "SELECT DISTINCT page_id, split_part(href, '/', 2) AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1)) AS href FROM pages)")
def edges(spark, sf_dir):
    """Edges from a page to what it refers to."""
    links = F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1))).alias("href")
    return table(spark, sf_dir, "pages").select("page_id", links).select("page_id", F.split_part("href", F.lit("/"), F.lit(2)).alias("target")).distinct()
