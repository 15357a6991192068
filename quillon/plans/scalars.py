"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from .registry import query, sql_query, table

sql_query(
    "r20_label_masking",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE coalesce(CASE WHEN o_totalprice > 250000 THEN concat('locked ', o_orderstatus) END, 'evidence') END AS label FROM {orders}""",
)


@query("r21_id_category", "SELECT s_suppkey, CASE WHEN starts_with(s_name, 'Supplier#') THEN 'supplier' ELSE 'other' END AS kind, CAST(split_part(s_name, '#', 2) AS BIGINT) AS number FROM supplier")
def id_category(spark, sf_dir):
    name = F.col("s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(name.startswith("Supplier#"), "supplier").otherwise("other").alias("kind"), F.substring_index(name, "#", -1).cast("long").alias("number"))


sql_query("r22_package_tag", "SELECT n_nationkey, CASE WHEN n_name IN ('NATION_0', 'NATION_3', 'NATION_7') THEN 'free' ELSE 'full' END AS package FROM {nation}")
sql_query("r23_type_filter", "SELECT event_id, value FROM {events} WHERE event_type = 'view'")


@query("r24_include_exclude", r"SELECT page_id FROM pages WHERE regexp_matches(url, '(?i)\.(html|php)|/EN/') AND NOT regexp_matches(url, 'spam-')")
def include_exclude(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").filter(url.rlike(r"(?i)\.(html|php)|/EN/") & ~url.rlike("spam-")).select("page_id")


sql_query("r25_substring_filter", "SELECT p_partkey FROM {part} WHERE contains(p_name, 'ring')")


@query("r26_defaults", "SELECT o_orderkey, coalesce(nullif(o_custkey % 3, 0), 9) AS width FROM orders")
def defaults(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.or_default(F.col("o_custkey") % 3, 9).cast("long").alias("width"))


sql_query(
    "r27_optional_parts",
    "SELECT conv_id, turn, concat_ws(' ', CASE WHEN role = 'user' THEN '>' END, role, CASE WHEN length(text) > 400 THEN 'long' END) AS line FROM {conversations}",
)


@query("r29_membership", "SELECT p_type, list_contains(list(p_brand), 'Brand#2') AS has_brand FROM part GROUP BY p_type")
def membership(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.bool_or(F.col("p_brand") == "Brand#2").alias("has_brand"))


@query("r30_noise_filter", "SELECT event_id FROM events WHERE NOT regexp_matches(event_type, 'error|abort')")
def noise_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(~F.col("event_type").rlike("error|abort")).select("event_id")


@query("r72_html_escape", "SELECT page_id, sha256(replace(replace(html, '&', '&amp;'), '<', '&lt;')) AS escaped_sha256 FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.escape_html(F.col("html")), 256).alias("escaped_sha256"))


@query("r73_emoji_wrapping", rf"SELECT doc_id, sha256(regexp_replace(text, '({T.pictographs()})', '<span>\1</span>', 'g')) AS wrapped_sha256 FROM documents")
def emoji_wrapping(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.wrap_pictographs(F.col("text"), "<span>", "</span>"), 256).alias("wrapped_sha256"))


#: Pictographs alone, with a selector, joined, with a skin tone; signs of old blocks; and what is none: a flag, a keycap, a letter.
_MARKS = ("\U0001f44d", "❤\ufe0f", "\U0001f469\u200d\U0001f4bb", "\U0001f44d\U0001f3fd", "©", "™\u231a", "\U0001f1ea\U0001f1f8", "1\ufe0f\u20e3", "é")


@query(
    "r73_pictographs",
    rf"""
    WITH m AS (SELECT event_id, 'x' || [{", ".join(f"'{m}'" for m in _MARKS)}][event_id % {len(_MARKS)} + 1] || [{", ".join(f"'{m}'" for m in _MARKS)}][user_id % {len(_MARKS)} + 1] || ' y' AS s FROM events)
    SELECT event_id, regexp_replace(s, '({T.pictographs()})', '<b>\1</b>', 'g') AS wrapped FROM m
    """,
)
def marked_messages(spark, sf_dir):
    """Messages made of events with two marks each, next to each other."""
    mark = lambda c: F.element_at(F.array(*[F.lit(m) for m in _MARKS]), (F.col(c) % len(_MARKS) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("x"), mark("event_id"), mark("user_id"), F.lit(" y")).alias("s"))
    return rows.select("event_id", T.wrap_pictographs(F.col("s"), "<b>", "</b>").alias("wrapped"))


_DATES = r"\b[0-9]{1,2}-[IVX]+-[0-9]{4}\b"


@query(
    "r74_roman_dates",
    rf"""
    WITH t AS (SELECT o_orderkey, 'due ' || day(o_orderdate) || '-' || ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII'][month(o_orderdate)] || '-' || year(o_orderdate) || ' at the latest' AS s FROM orders)
    SELECT o_orderkey, regexp_extract(s, '{_DATES}') AS found, instr(s, regexp_extract(s, '{_DATES}')) - 1 AS start FROM t
    """,
)
def roman_dates(spark, sf_dir):
    """Texts with a date of a Roman month are made from order dates; each match is given with where it starts."""
    months = F.array(*[F.lit(m) for m in "I II III IV V VI VII VIII IX X XI XII".split()])
    date = F.concat_ws("-", F.day("o_orderdate").cast("string"), F.element_at(months, F.month("o_orderdate")), F.year("o_orderdate").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("due "), date, F.lit(" at the latest")).alias("s"))
    return _spans(rows)


def _spans(rows):
    """A row for each match of a date in s."""
    return rows.select("o_orderkey", F.explode(T.match_spans(F.col("s"), _DATES)).alias("m")).select("o_orderkey", "m.found", F.col("m.start").cast("long").alias("start"))


@query(
    "r74_repeated_dates",
    rf"""
    WITH d AS (SELECT o_orderkey, o_custkey, day(o_orderdate) || '-' || ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII'][month(o_orderdate)] || '-' || year(o_orderdate) AS date FROM orders),
    t AS (SELECT o_orderkey, date || ' or 1' || date || ', no: 9' || date || '; ' || date || ' é ' || date AS s FROM d),
    m AS (SELECT o_orderkey, regexp_extract_all(s, '{_DATES}') AS found, string_split_regex(s, '{_DATES}') AS gaps FROM t),
    i AS (SELECT *, unnest(range(len(found))) AS i FROM m)
    SELECT o_orderkey, found[i + 1] AS found, CAST(list_sum(list_transform(gaps[1 : i + 1], lambda g: len(g))) + coalesce(list_sum(list_transform(found[1 : i], lambda f: len(f))), 0) AS BIGINT) AS start FROM i
    """,
)
def repeated_dates(spark, sf_dir):
    """Texts that hold one date several times, some of them with a digit before it, which may make another date of it or none."""
    months = F.array(*[F.lit(m) for m in "I II III IV V VI VII VIII IX X XI XII".split()])
    date = F.concat_ws("-", F.day("o_orderdate").cast("string"), F.element_at(months, F.month("o_orderdate")), F.year("o_orderdate").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", date.alias("d"))
    return _spans(rows.select("o_orderkey", F.concat("d", F.lit(" or 1"), "d", F.lit(", no: 9"), "d", F.lit("; "), "d", F.lit(" é "), "d").alias("s")))


@query("r75_clock", "SELECT event_id, CAST(floor(floor(greatest(value - 5, 0)) / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(greatest(value - 5, 0)) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS shown FROM events")
def clock(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.clock(F.col("value") - 5).alias("shown"))


sql_query("r76_substitutions", "SELECT p_partkey, replace(replace(replace(p_name, 'ring', 'rinn'), 'rinn', 'hoop'), 'small', 'tiny') AS said FROM {part}")


@query("r77_rename", r"SELECT doc_id, sha256(replace(regexp_replace(text, '(?m)^The ', 'A ', 'g'), 'tion', 'shun')) AS renamed_sha256 FROM documents")
def rename(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.replace(F.regexp_replace("text", "(?m)^The ", "A "), F.lit("tion"), F.lit("shun")), 256).alias("renamed_sha256"))


@query("r78_paths", "SELECT page_id, split_part(url, '/', 3) || '/' || split_part(url, '/', 4) AS path, split_part(url, '/', 3) AS second FROM pages")
def paths(spark, sf_dir):
    """The path host/x/../lang of each address, with what ".." takes back; and its first segment."""
    part = lambda i: F.split_part("url", F.lit("/"), F.lit(i))
    path = T.normalise_path(F.concat(part(3), F.lit("\\x//./../"), part(4)))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.split_part(path, F.lit("/"), F.lit(1)).alias("second"))


sql_query(
    "r79_template",
    "SELECT l_returnflag, replace(replace('{{n}} of {{t}}', '{{n}}', CAST(count_if(l_linestatus = 'F') AS STRING)), '{{t}}', CAST(count(*) AS STRING)) AS message FROM {lineitem} GROUP BY l_returnflag",
    "SELECT l_returnflag, CAST(count_if(l_linestatus = 'F') AS VARCHAR) || ' of ' || CAST(count(*) AS VARCHAR) AS message FROM lineitem GROUP BY l_returnflag",
)


def _imul(a: str, b: str) -> str:
    return f"((({a}) >> 16) * ({b}) % 65536 * 65536 + (({a}) & 65535) * ({b})) & 4294967295"


@query(
    "r80_mulberry32",
    f"""
    WITH a AS (SELECT o_orderkey, (o_orderkey + 1831565813) & 4294967295 AS a FROM orders),
    b AS (SELECT o_orderkey, {_imul("xor(a, a >> 15)", "a | 1")} AS t FROM a),
    c AS (SELECT o_orderkey, xor(t, (t + ({_imul("xor(t, t >> 7)", "t | 61")})) & 4294967295) AS t FROM b)
    SELECT o_orderkey, xor(t, t >> 14) / 4294967296.0::DOUBLE AS u FROM c
    """,
)
def mulberry32(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", N.mulberry32(F.col("o_orderkey")).alias("u"))


@query("r81_lcg", "SELECT c_custkey, (((c_custkey * 9301 + 49297) % 233280 * 9301 + 49297) % 233280 * 9301 + 49297) % 233280 AS state FROM customer")
def lcg(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", N.lcg(F.col("c_custkey"), 3).alias("state"))


@query("r82_sine_noise", "SELECT c_custkey, round(sin(c_custkey * 12.9898::DOUBLE) * 43758.5453::DOUBLE - trunc(sin(c_custkey * 12.9898::DOUBLE) * 43758.5453::DOUBLE), 5) AS noise FROM customer")
def sine_noise(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(N.sine_noise(F.col("c_custkey")), 5).alias("noise"))


sql_query("r83_pseudo_gaussian", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_discount + l_tax + l_quantity / 50 - 1.5D) / 1.5D, 6) AS g FROM {lineitem}", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_discount + l_tax + l_quantity / 50 - 1.5::DOUBLE) / 1.5::DOUBLE, 6) AS g FROM lineitem")


@query("r84_clamp", "SELECT event_id, greatest(20.5::DOUBLE, least(value, 300::DOUBLE)) AS inside FROM events")
def clamp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", N.clamp(F.col("value"), 20.5, 300.0).alias("inside"))


@query("r86_entries_text", "SELECT n_regionkey, string_agg(n_nationkey || ': ' || n_name, chr(10) ORDER BY n_nationkey) AS entries FROM nation GROUP BY n_regionkey")
def entries_text(spark, sf_dir):
    maps = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("m"))
    lines = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"].cast("string"), F.lit(": "), e["value"]))
    return maps.select("n_regionkey", F.array_join(lines, "\n").alias("entries"))


@query(
    "r87_first_equals",
    "SELECT page_id, CASE WHEN instr(url, '=') > 0 THEN url[: instr(url, '=') - 1] ELSE url END AS key, CASE WHEN instr(url, '=') > 0 THEN url[instr(url, '=') + 1 :] ELSE '' END AS rest FROM pages",
)
def first_equals(spark, sf_dir):
    key, rest = T.first_equals(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", key.alias("key"), rest.alias("rest"))


@query("r88_prefix", "SELECT c_custkey, CASE WHEN starts_with(c_name, 'Customer#') THEN substr(c_name, 10) END AS rest FROM customer")
def prefix(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(name.startswith("Customer#"), F.substring(name, 10, 1 << 30)).alias("rest"))


@query("r89_json", "SELECT doc_id, sha256(to_json({'doc_id': doc_id, 'lang': lang, 'source': source})) AS json_sha256 FROM documents")
def as_json(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.to_json(F.struct("doc_id", "lang", "source")), 256).alias("json_sha256"))


sql_query("r90_distance", "SELECT s_suppkey, round(sqrt(s_acctbal * s_acctbal + s_nationkey * s_nationkey), 4) AS distance, round(s_acctbal / (s_nationkey + 1), 4) AS ratio FROM {supplier}")
