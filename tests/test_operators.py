"""Boundary cases of operators, functions, sources and sinks."""

import hashlib
import json
import unicodedata

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import numbers as N
from quillon.functions import text as T
from quillon.operators import grading as G
from quillon.operators import sequences as S
from quillon.sources import files, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens_tolerate_case_accents_order_and_marks(spark):
    texts = ["¡Él está AQUÍ!", "niño\nß naïve", "", "  ,,  ", None, "Ça déjà vu 42"]

    def plain(t):
        if t is None:
            return None
        t = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not 0x300 <= ord(c) <= 0x36F)
        return "".join(c if c.isascii() and (c.isalnum() or c == " ") else " " for c in t).split()

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", T.tokens(F.col("t")).alias("x")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_digest_is_null_for_a_null_part(spark):
    assert one(spark, T.digest("s", F.lit("a"))) == hashlib.sha256(b"s|a").hexdigest()
    assert one(spark, T.digest("s", F.lit(None).cast("string"), F.lit("a"))) is None


def test_choices_have_three_values(spark):
    ok = F.array(F.lit("a"), F.lit("b"))
    none = F.lit(None).cast("string")
    assert [one(spark, G.single_choice(c, ok)) for c in (F.lit("a"), F.lit("z"), none)] == [True, False, None]
    empty = F.array().cast("array<string>")
    pick = lambda *x: F.array(*[F.lit(y) for y in x])
    assert [one(spark, G.multiple_choice(c, ok, F.lit(0))) for c in (pick("a"), pick("a", "z"), empty, F.lit(None).cast("array<string>"))] == [True, False, None, None]
    assert one(spark, G.multiple_choice(pick("a"), ok, F.lit(2))) is False
    groups = [[hashlib.sha256(f"s|tok|{w}".encode()).hexdigest() for w in g] for g in (["perro", "gato"], ["rojo"])]
    assert [one(spark, G.free_text(F.lit(t), groups, "s")) for t in ("el ROJO gató", "gato", "...", "")] == [True, False, None, None]


def test_unlock_needs_purchase_and_all_listed(spark):
    some = F.array(F.lit(True), F.lit(None).cast("boolean"))
    assert one(spark, G.unlocked(F.lit(False), F.lit(True), some)) is False
    assert one(spark, G.unlocked(F.lit(False), F.lit(True), F.array().cast("array<boolean>"))) is True
    assert one(spark, G.unlocked(F.lit(False), F.lit(False), F.array(F.lit(True)))) is False
    assert one(spark, G.unlocked(F.lit(True), F.lit(False), F.array(F.lit(False)))) is True


def trace(spark, moves, ends=None):
    m = F.array(*[F.struct(F.lit(c).alias("cell"), F.lit(k).alias("mark")) for c, k in moves]).cast("array<struct<cell:int,mark:string>>")
    e = F.lit(None).cast("array<int>") if ends is None else F.array(*[F.lit(x) for x in ends])
    return tuple(one(spark, G.game_trace(m, e)))


def test_game_traces(spark):
    win = [(0, "O"), (3, "X"), (1, "O"), (4, "X"), (2, "O")]
    assert trace(spark, win) == (True, "won by O")
    assert trace(spark, win, (0, 2)) == (True, "won by O")
    assert trace(spark, win, (0, 8)) == (False, "won by O")
    assert trace(spark, win + [(8, "X")]) == (False, "won by O")
    assert trace(spark, [(0, "O"), (0, "X")]) == (False, "in play")
    assert trace(spark, [(0, "O"), (1, "O")]) == (False, "in play")
    assert trace(spark, [(0, "O")], (0, 2)) == (False, "in play")
    draw = list(zip([0, 1, 2, 4, 3, 5, 7, 6, 8], "OXOXOXOXO"))
    assert trace(spark, draw) == (True, "draw")


def test_islands_at_exact_gap(spark):
    df = spark.createDataFrame([("a", 0), ("a", 3), ("a", 7), ("b", 1)], "k string, x int")
    got = sorted((r.k, r.x, r.island) for r in S.islands(df, ["k"], F.col("x"), F.lit(3), ["x"]).collect())
    assert got == [("a", 0, 1), ("a", 3, 1), ("a", 7, 2), ("b", 1, 1)]


def test_centred_mean_counts_missing_as_zero(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(4)], "i int, v double")
    got = [r.m for r in df.select("i", S.centred_mean(F.col("v"), Window.partitionBy(F.lit(1)).orderBy("i"), 5).alias("m")).orderBy("i").collect()]
    assert got == [3.0, 4.0, 4.0, 3.0]


def test_numbers(spark):
    def mulberry(a):
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ a >> 15) * (a | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return (t ^ t >> 14) / 4294967296

    got = {r.id: r.u for r in spark.range(0, 4_000_000_000, 40_000_003).select("id", N.mulberry32(F.col("id")).alias("u")).collect()}
    assert got == {i: mulberry(i) for i in got}
    assert one(spark, N.lcg(F.lit(7), 2)) == ((7 * 9301 + 49297) % 233280 * 9301 + 49297) % 233280
    assert one(spark, N.clamp(F.lit(9.0), 0.0, 3.5)) == 3.5


def test_text_functions(spark):
    assert one(spark, T.escape_html(F.lit("a<b && c>d"))) == "a&lt;b &amp;&amp; c>d"
    assert [one(spark, T.clock(F.lit(s))) for s in (-3.0, 59.9, 88.0, 3600.0)] == ["0:00", "0:59", "1:28", "60:00"]
    assert [one(spark, T.normalise_path(F.lit(p))) for p in ("a/../b//c/./d", "../x", "a\\b\\..", "")] == ["b/c/d", "x", "a", ""]
    for text, expected in (("a=b=c", ("a", "b=c")), ("abc", ("abc", "")), ("=x", ("", "x"))):
        key, rest = T.first_equals(F.lit(text))
        assert (one(spark, key), one(spark, rest)) == expected
    assert [one(spark, T.or_default(F.lit(x), 5)) for x in (0, 3)] == [5, 3]


def test_catalogue_source(spark, folder):
    piece = lambda i, lo, hi: {"id": i, "orden": 1, "duracion_estimada_min": [lo, hi], "miniatura": None, "dependencias": []}
    book = {
        "etapas": [
            {"id": "s0", "acceso": "gratis", "requiere": [], "piezas": ["p1", "p2"]},
            {"id": "s1", "acceso": "pago", "requiere": ["compra", "p1"], "piezas": ["p3"]},
            {"id": "s2", "acceso": "pago", "requiere": ["compra"], "piezas": []},
        ],
        "piezas": [piece("p1", 1, 2), piece("p2", 3, 5), piece("p3", 7, 8)],
    }
    with open(f"{folder}/c.json", "w") as f:
        json.dump(book, f, indent=1)
    stages, pieces = files.read_catalogue(spark, f"{folder}/c.json")
    assert sorted(tuple(r) for r in files.stage_minutes(stages, pieces).collect()) == [("s0", 4, 7), ("s1", 7, 8)]
    done = spark.createDataFrame([("p1",), ("p1",)], "id string")
    state = lambda bought, solved: {r.id: r.open for r in files.open_stages(stages, solved, bought).collect()}
    assert state(False, done) == {"s0": True, "s1": False, "s2": False}
    assert state(True, done) == {"s0": True, "s1": True, "s2": True}
    assert state(True, done.limit(0)) == {"s0": True, "s1": False, "s2": True}


def test_jobs_and_page_config(spark, folder):
    with open(f"{folder}/j.json", "w") as f:
        json.dump([{"html": "a", "out": "x/e1.png", "width": 0}, {"html": "b", "out": "y.png", "dpr": 2.0}], f)
    got = {r.out: (r.width, r.dpr) for r in files.read_jobs(spark, f"{folder}/j.json").collect()}
    assert got == {"x/e1.png": (1000, 1.0), "y.png": (1000, 2.0)}
    assert files.read_jobs(spark, f"{folder}/j.json", "e1").count() == 1
    pages = spark.createDataFrame([(1, '<script>window.D={"id":"q"};</script>'), (2, "<p>none</p>")], "i int, html string")
    assert {r.i: r.config and r.config.id for r in files.page_config(pages, "id string").collect()} == {1: "q", 2: None}


def test_sinks(spark, folder):
    pages = spark.createDataFrame([("a", "<p>ñ</p>"), ("b", "x")], "id string, html string")
    sinks.write_pages(pages, f"{folder}/p", "id", "html")
    assert {r.id: r.value for r in spark.read.text(f"{folder}/p").collect()} == {"a": "<p>ñ</p>", "b": "x"}
    sinks.write_json(pages, f"{folder}/j")
    assert sorted(r.html for r in spark.read.json(f"{folder}/j").collect()) == ["<p>ñ</p>", "x"]
    now = spark.createDataFrame([("a", 1, "ok"), ("b", 1, "ok")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 2, None), ("c", 2, "ok"), ("b", 0, "old")], "k string, t int, v string")
    assert sorted(tuple(r) for r in sinks.upsert(now, new, ["k"], ["t"], ["v"]).collect()) == [("b", 1, "ok"), ("c", 2, "ok")]


def test_streams_go_on_from_their_checkpoint(spark, folder):
    from quillon.streaming import solved

    def put(name, rows):
        spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{folder}/in")

    import datetime

    at = lambda h: datetime.datetime(2024, 1, 1, h)
    put("1", [(1, at(1), 1, "view", 200.0), (2, at(2), 1, "error", 1.0), (3, at(3), 1, "click", 5.0), (4, at(3), 2, "view", 300.0)])
    run = lambda: {r.user_id: r.n_solved for r in solved.with_resets(solved.read_events(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/c").collect()}
    assert run() == {1: 1, 2: 1}
    put("2", [(5, at(4), 1, "view", 200.0), (6, at(5), 2, "error", 1.0)])
    assert run() == {1: 2, 2: 0}
    flags = lambda: sorted(tuple(r) for r in solved.flags(solved.accepted(solved.read_events(spark, f"{folder}/in")), f"{folder}/o2", f"{folder}/c2").select("user_id", "event_type").collect())
    assert flags() == [(1, "view"), (2, "view")]
    assert flags() == [(1, "view"), (2, "view")]
