"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chunk_dedup, combinations, exact_dedup, knn, merkle, mixing, quality, sampling, simhash, sstable, store, suffix_dedup, toxicity, whitening


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    target = store.fresh_path(spark, "token-shards")
    sstable.write_shards(docs, target, public_tokenizers.path("byte_bpe_50k.json"))
    return sstable.read_shards(spark, target).drop("ids")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "source", "text")
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return mixing.mix(mixing.sized(docs)).select("doc_id", "size", "source_size", "target", taken)


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeats(_read(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.removed(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return groups.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    ids = byte_bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    labels = _read(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.train(docs, labels.filter(sampling.fold(5) != 0))
    score = F.col("toxic_score")
    return toxicity.scored(docs, model).select(
        "doc_id", (sampling.fold(5) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted")
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return exact_dedup.exact_groups(docs).withColumnRenamed("digest", "text_sha256")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = knn.quantised(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return knn.top_k(vectors, F.col("vec_id") % 50 == 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    labels = _read(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.train(docs, labels.filter(sampling.fold(3) != 1))
    score = F.col("quality_score")
    return quality.scored(docs, model).select(
        "doc_id", (sampling.fold(3) == 1).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted")
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = _read(spark, sf_dir, "documents", *columns)
    lowered = F.when(F.col("text").isNotNull(), exact_dedup.normalised(F.col("text")))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf(*[F.col(c) for c in columns[:-1]], lowered))
    return merkle.proofs(docs, columns, "source", "doc_id", tampered).withColumnRenamed("id", "doc_id")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, whole = _read(spark, sf_dir, "embeddings", "vec_id", "embedding"), {"scale": 1024.0, "shift": 100_000}
    rows = whitening.whitened(vectors, whitening.fitted(vectors, **whole), **whole)
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combinations.similar_groups(_read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {
    "op1_token_shards": op1_token_shards,
    "op2_mixing": op2_mixing,
    "op3_chunk_dedup": op3_chunk_dedup,
    "op4_suffix_array": op4_suffix_array,
    "op5_simhash": op5_simhash,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_top_k": op9_top_k,
    "op10_quality": op10_quality,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_whitening": op12_whitening,
    "op13_jaccard_join": op13_jaccard_join,
}

def _merkle_sql(levels: int = 6) -> str:
    """DuckDB SQL for op11: as many levels of runs, in the sources and above them, so for 16^levels rows of a source. A tree of
    one node stays as it is from level to level."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32: bit by bit, over the digits of doc_id.
    turn = "list_reduce(list_concat([xor(c, b)], range(8)), lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {turn}), 4294967295)"
    parts = [
        f"x AS (SELECT *, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS shown FROM documents)",
        "d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM x)",
        "n0 AS (SELECT tree, place, leaf AS h FROM d)",
        "pn0 AS (SELECT doc_id, leaf, tree, place AS own, place, shown, '' AS proof FROM d)",
    ]
    for k in "nt":
        if k == "t":
            parts.append(f"t0 AS (SELECT 0 AS tree, tree AS place, h FROM n{levels})")
            parts.append(f"pt0 AS (SELECT doc_id, leaf, 0 AS tree, tree AS own, tree AS place, shown, proof FROM pn{levels})")
        for i in range(levels):
            parts.append(f"g{k}{i} AS (SELECT tree, place // 16 AS run, list(h ORDER BY place) AS hs, any_value(n) AS n FROM {k}{i} JOIN (SELECT tree, count(*) AS n FROM {k}{i} GROUP BY tree) USING (tree) GROUP BY tree, place // 16)")
            parts.append(f"{k}{i + 1} AS (SELECT tree, run AS place, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM g{k}{i})")
            sides = [f"CASE WHEN n = 1 THEN '' ELSE coalesce(array_to_string(hs[{cut}], ''), '') END" for cut in ("1 : place % 16", "place % 16 + 2 : 16")]
            parts.append(
                f"p{k}{i + 1} AS (SELECT doc_id, leaf, tree, own, run AS place, CASE WHEN n = 1 THEN shown ELSE sha256(before || shown || behind) END AS shown, proof || before || behind AS proof "
                f"FROM (SELECT p.*, g.run, g.n, {sides[0]} AS before, {sides[1]} AS behind FROM p{k}{i} p JOIN g{k}{i} g ON p.tree = g.tree AND p.place // 16 = g.run))"
            )
    final = f"SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, shown AS folded_root, shown = r.h AS verified FROM pt{levels} p JOIN n{levels} s ON s.tree = p.own JOIN t{levels} r ON r.tree = 0"
    return f"WITH {', '.join(parts)} {final}"


ORACLES = {
    "op11_merkle_manifest": _merkle_sql(),
    "op8_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents
        ), g AS (
            SELECT *, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) AS place
            FROM t WINDOW same AS (PARTITION BY norm)
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g
    """,
    "op9_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op13_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS shingles
            FROM w
        ), n AS (SELECT doc_id, len(shingles) AS n FROM s), u AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        e AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 80 * (i.n + j.n - c)),
        l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        r(doc_id, near) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.near = l.x)
        SELECT n.doc_id, n.n AS n_shingles, min(r.near) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
    """,
}
