"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, clusters, decontam, exact, htmltext, lexical, packing, quality, simhash, substring, tokenfile, topk, toxicity
from .common import table, vocabulary


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), kind="word", end_id=1, size=2048)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_numbers(table(spark, sf_dir, "embeddings"), scale=256.0)
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.write_and_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), kind="byte", end_id=0)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), n_words=4, seed=42, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return cut.select("doc_id", "n_words", lost.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(documents, quality.train(documents))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.5).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    named = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    return named.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    formatted = chat.format_chats(chat.transcripts(conversations), chat.learn(conversations))
    turns = formatted.select("conv_id", "first_turn", F.posexplode("turns").alias("at", "x"))
    return turns.select("conv_id", (F.col("first_turn") + F.col("at")).alias("position"), F.col("x.role").alias("role"), F.sha2("x.text", 256).alias("text_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark(table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = clusters.whole_vectors(table(spark, sf_dir, "embeddings"), dim=64, scale=256.0)
    first = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    return clusters.with_inertia(*clusters.cluster(vectors, first, k=40, dim=64, rounds=5))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_topk": op3_topk,
    "op4_token_orc": op4_token_orc,
    "op5_simhash": op5_simhash,
    "op6_substring": op6_substring,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_html_text": op9_html_text,
    "op10_chat_format": op10_chat_format,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_lexical": op12_lexical,
    "op13_clusters": op13_clusters,
}

OP3_SQL = """
WITH n AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP10_SQL = """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role, sha256(coalesce(text, '')) AS text_sha256
FROM conversations
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents),
r AS (
  SELECT doc_id, k, count(*) OVER (PARTITION BY k) AS group_size, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS n
  FROM d WINDOW w AS (PARTITION BY k ORDER BY length(t) DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(k) AS text_sha256 FROM r
"""

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"unnest(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
t AS (SELECT r, doc_id, {_TERMS} FROM d), b AS (SELECT item_id, {_TERMS} FROM (SELECT DISTINCT item_id, text FROM benchmark)),
c AS (SELECT count(DISTINCT r) AS n_docs, count(*) AS n_words FROM t),
l AS (SELECT r, count(*) AS n FROM t GROUP BY r),
f AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
s AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_words))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN l USING (r), c GROUP BY item_id, r),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10
"""


def _op13_sql(k: int, dim: int, rounds: int) -> str:
    """Each round's centroids and assignment stand below each other; a distance is |v|^2 - 2 vc + |c|^2 in doubles, whose whole numbers are exact here."""
    to_double = "list_dot_product(v::DOUBLE[], v::DOUBLE[])"
    parts = [
        f"""WITH n AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR) NULLS LAST, vec_id NULLS LAST, v) - 1 AS c, v FROM n QUALIFY c < {k})"""
    ]
    for n in range(rounds + 1):
        way = f"{to_double} - 2 * list_dot_product(v::DOUBLE[], w::DOUBLE[]) + list_dot_product(w::DOUBLE[], w::DOUBLE[])"
        parts.append(f"""a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, ({way})::BIGINT AS d FROM n, (SELECT c, v AS w FROM c{n})) GROUP BY r)""")
        if n < rounds:
            parts.append(
                f"""m{n} AS (SELECT c, list(x ORDER BY i) AS v FROM (SELECT c, i, floor(sum(v[i]) / count(*))::BIGINT AS x FROM a{n} JOIN n USING (r), (SELECT unnest(range(1, {dim + 1})) AS i) GROUP BY c, i) GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} ON m{n}.c = c{n}.c)"""
            )
    return ",\n".join(parts) + f"""
SELECT vec_id, a.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN n USING (r) JOIN c{rounds} f ON f.c = a.c
"""


ORACLE_SQL: dict[str, str] = {"op3_topk": OP3_SQL, "op10_chat_format": OP10_SQL, "op11_exact_dedup": OP11_SQL, "op12_lexical": OP12_SQL, "op13_clusters": _op13_sql(40, 64, 5)}
