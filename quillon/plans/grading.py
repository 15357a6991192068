"""Answer grading."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import digest, fold, once, tokens
from ..operators import grading as G
from .registry import query, sql_query, table

SALT = "quillon"
_sha = lambda *parts: hashlib.sha256("|".join(parts).encode()).hexdigest()
#: A text passes if it names something of each group.
GROUPS = [["the", "der", "la", "le"], ["with", "und", "que", "para"]]
GROUP_DIGESTS = [[_sha(SALT, "tok", w) for w in g] for g in GROUPS]

_TOKENS = "list_filter(string_split(regexp_replace(strip_accents(lower(text)), '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query(
    "r61c_free_text",
    f"""
    WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
    d AS (SELECT doc_id, len(w) AS n, list_transform(list_distinct(w), lambda x: sha256('{SALT}|tok|' || x)) AS h FROM t)
    SELECT doc_id, n AS n_tokens, CASE WHEN n > 0 THEN {" AND ".join(f"list_has_any(h, {g})" for g in GROUP_DIGESTS)} END AS verdict FROM d
    """,
)
def free_text(spark, sf_dir):
    graded = lambda w: F.struct(F.size(w).cast("long").alias("n_tokens"), G.free_words(w, GROUP_DIGESTS, SALT).alias("verdict"))
    return table(spark, sf_dir, "documents").select("doc_id", once(tokens(F.col("text")), graded).alias("g")).select("doc_id", "g.n_tokens", "g.verdict")


@query("r70_tokens", f"SELECT doc_id, len({_TOKENS}) AS n_tokens, sha256(array_to_string({_TOKENS}, ' ')) AS tokens_sha256 FROM documents")
def token_digests(spark, sf_dir):
    digests = lambda w: F.struct(F.size(w).cast("long").alias("n_tokens"), F.sha2(F.array_join(w, " "), 256).alias("tokens_sha256"))
    return table(spark, sf_dir, "documents").select("doc_id", once(tokens(F.col("text")), digests).alias("d")).select("doc_id", "d.n_tokens", "d.tokens_sha256")


@query("r71_sha256", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def text_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("r60_choice_digest", f"SELECT o_orderkey, sha256('{SALT}|' || o_orderpriority || '|' || CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus) AS choice FROM orders")
def choice_digest(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", digest(SALT, F.col("o_orderpriority"), F.col("o_orderkey"), F.col("o_orderstatus")).alias("choice"))


_ACCEPTED = ("purchase", "signup", "view")


@query("r61a_single_choice", "SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type IN ('purchase', 'signup', 'view') END AS verdict FROM events")
def single_choice(spark, sf_dir):
    accepted = F.array(*[F.lit(_sha(SALT, "choice", a)) for a in _ACCEPTED])
    chosen = F.when(F.col("event_type") != "error", digest(SALT, "choice", F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", G.single_choice(chosen, accepted).alias("verdict"))


@query(
    "r61b_multiple_choice",
    """
    WITH s AS (
        SELECT user_id, count(DISTINCT event_type) FILTER (value > 200) AS n,
            count(DISTINCT event_type) FILTER (value > 200 AND event_type IN ('purchase', 'signup', 'view')) AS good
        FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN n > 0 THEN n = good AND n >= 2 END AS verdict FROM s
    """,
)
def multiple_choice(spark, sf_dir):
    chosen = F.collect_set(F.when(F.col("value") > 200, digest(SALT, "choice", F.col("event_type"))))  # five kinds at most
    accepted = F.array(*[F.lit(_sha(SALT, "choice", a)) for a in _ACCEPTED])
    sets = table(spark, sf_dir, "events").groupBy("user_id").agg(chosen.alias("chosen"))
    return sets.select("user_id", G.multiple_choice(F.col("chosen"), accepted, F.lit(2)).alias("verdict"))


@query(
    "r61d_by_kind",
    """
    SELECT event_id, CASE event_type WHEN 'view' THEN (CASE WHEN value > 50 THEN value > 100 END) WHEN 'click' THEN value > 100
        WHEN 'purchase' THEN (CASE WHEN value > 250 THEN TRUE END) ELSE FALSE END AS verdict FROM events
    """,
)
def by_kind(spark, sf_dir):
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "unica", "click", "multiple", "purchase", "texto")]), F.col("event_type"))
    high = F.col("value") > 100
    verdict = G.graded(F.coalesce(kind, F.lit("?")), F.when(F.col("value") > 50, high), high, F.when(F.col("value") > 250, F.lit(True)))
    return table(spark, sf_dir, "events").select("event_id", verdict.alias("verdict"))


_FORM = "count_if(quality = 1) AS good, count_if(quality IS NULL) AS blanks, count(*) AS total"


@query(
    "r61e_form_outcome",
    f"""
    WITH f AS (SELECT source, {_FORM} FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
    SELECT source, CASE WHEN good = total THEN 'solved' WHEN blanks > 0 THEN 'blank: ' || blanks ELSE good || ' of ' || total END AS outcome FROM f
    """,
)
def form_outcome(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    form = rows.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality").isNull()).alias("blanks"), F.count("*").alias("total"))
    return form.select("source", G.outcome(F.col("good"), F.col("blanks"), F.col("total")).alias("outcome"))


@query(
    "r62_ordering_check",
    """
    WITH p AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
    SELECT conv_id, CAST(count_if((role = 'user') = (pos % 2 = 0)) AS BIGINT) AS placed, count(*) AS total, bool_and((role = 'user') = (pos % 2 = 0)) AS solved
    FROM p GROUP BY conv_id
    """,
)
def ordering_check(spark, sf_dir):
    """Digests of (role at even or odd place) are accepted; a conversation is in order if all its turns are."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    side = F.when(F.col("role") == "user", F.lit("u")).otherwise(F.lit("o"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", digest(SALT, "ord", side, (place % 2)).alias("h"))
    good = F.col("h").isin(_sha(SALT, "ord", "u", "0"), _sha(SALT, "ord", "o", "1"))
    return rows.groupBy("conv_id").agg(F.count_if(good).alias("placed"), F.count("*").alias("total"), F.bool_and(good).alias("solved"))


_WON = " OR ".join(f"(mine & {sum(1 << c for c in line)}) = {sum(1 << c for c in line)}" for line in G.LINES)


@query(
    "r63_game_trace",
    f"""
    WITH RECURSIVE m AS (
        SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(1 << (event_id % 9) AS BIGINT) AS cell, event_type IN ('view', 'click') AS round,
            row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS n
        FROM events
    ), g(user_id, day, i, o, x, last, winner, good) AS (
        SELECT user_id, day, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', '', TRUE FROM m WHERE i = 1
        UNION ALL
        SELECT user_id, day, i, CASE WHEN round THEN mine ELSE o END, CASE WHEN round THEN x ELSE mine END, mark,
            CASE WHEN {_WON} THEN mark ELSE winner END, good AND winner = '' AND ((o | x) & cell) = 0 AND mark <> last
        FROM (
            SELECT m.user_id, m.day, m.i, m.round, m.cell, g.o, g.x, g.last, g.winner, g.good,
                CASE WHEN m.round THEN 'O' ELSE 'X' END AS mark, (CASE WHEN m.round THEN g.o ELSE g.x END) | m.cell AS mine
            FROM g JOIN m ON m.user_id = g.user_id AND m.day = g.day AND m.i = g.i + 1)
    )
    SELECT user_id, day, n AS n_moves, good AS valid, CASE WHEN winner <> '' THEN 'won by ' || winner WHEN n = 9 THEN 'draw' ELSE 'in play' END AS label
    FROM g JOIN (SELECT DISTINCT user_id, day, n FROM m) USING (user_id, day) WHERE i = n
    """,
)
def game_trace(spark, sf_dir):
    """Each user's events of a day as moves: the cell from the event's number, the mark from its kind."""
    cell = (F.col("event_id") % 9).cast("int").alias("cell")
    mark = F.when(F.col("event_type").isin("view", "click"), "O").otherwise("X").alias("mark")
    moves = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", cell, mark))).alias("m"))
    trace = G.game_trace(F.transform("m", lambda m: F.struct(m["cell"].alias("cell"), m["mark"].alias("mark"))))
    return moves.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.size("m").cast("long").alias("n_moves"), trace.alias("t")).select("user_id", "day", "n_moves", "t.valid", "t.label")


@query(
    "r64_unlock",
    """
    WITH r AS (SELECT o_custkey, count_if(o_orderstatus = 'F') AS solved, count(*) AS n, max(o_totalprice) > 400000 AS bought FROM orders GROUP BY o_custkey)
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN TRUE ELSE coalesce(bought, FALSE) AND coalesce(solved = n, TRUE) END AS unlocked
    FROM customer LEFT JOIN r ON c_custkey = o_custkey
    """,
)
def unlock(spark, sf_dir):
    """A customer is a stage, the orders are its requirements: free for one segment, else bought and all solved."""
    needs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.max("o_totalprice") > 400000).alias("bought"), F.bool_and(F.col("o_orderstatus") == "F").alias("solved"))
    rows = table(spark, sf_dir, "customer").join(needs, F.col("c_custkey") == F.col("o_custkey"), "left")
    listed = F.filter(F.array("solved"), lambda s: s.isNotNull())
    return rows.select("c_custkey", G.unlocked(F.col("c_mktsegment") == "BUILDING", F.coalesce("bought", F.lit(False)), listed).alias("unlocked"))


sql_query(
    "r65_opaque_id",
    "SELECT c_custkey, concat('n', lpad(CAST((ascii(c_mktsegment) * 7919) % 997 AS STRING), 3, '0')) AS opaque FROM {customer}",
    "SELECT c_custkey, 'n' || lpad(CAST((ascii(c_mktsegment) * 7919) % 997 AS VARCHAR), 3, '0') AS opaque FROM customer",
)
sql_query("r66_hint_level", "SELECT user_id, event_type, least(count(*), 3) AS level, count(*) >= 3 AS ended FROM {events} GROUP BY user_id, event_type")


@query(
    "r67_term_lint",
    r"""SELECT doc_id, regexp_matches(text, '(?i)\b(password|token|secret)\b') AS found FROM documents""",
)
def term_lint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(r"(?i)\b(password|token|secret)\b").alias("found"))


@query("r28_status", "SELECT doc_id, CASE WHEN quality IS NULL THEN 'not answered' WHEN quality = 1 THEN 'right' ELSE 'wrong' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def status(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("quality").isNull(), "not answered").when(F.col("quality") == 1, "right").otherwise("wrong").alias("status"))


@query("r70_folded", "SELECT doc_id, sha256(strip_accents(lower(text))) AS folded_sha256 FROM documents")
def folded(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(fold(F.col("text")), 256).alias("folded_sha256"))
