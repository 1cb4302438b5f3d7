"""One query per training-data operator, with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.exact_dedup import exact_duplicates
from locusflow.llm.hard_negatives import hard_negatives
from locusflow.llm.html_text import main_text
from locusflow.llm.near_dup import near_duplicates
from locusflow.llm.packing import pack_documents
from locusflow.llm.quality import score_quality, train_quality
from locusflow.llm.substring_dedup import repeated_passages
from locusflow.llm.topk import exact_top_k
from locusflow.llm.sentencepiece import encode_pieces
from locusflow.llm.token_counts import section_tokens
from locusflow.llm.toxicity import predict, train
from locusflow.llm.warc import capture_histories
from locusflow.session import table


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; the same on every machine of a cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Pages carry no time of capture; a second for each id stands for it.
    captured = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    out = capture_histories(table(spark, sf_dir, "pages"), captured)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM k
"""


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, len(g) AS n FROM s),
x AS MATERIALIZED (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n s ON s.doc_id = a JOIN n t ON t.doc_id = b WHERE 5 * c >= 4 * (s.n + t.n - c)
  UNION ALL SELECT s.doc_id, t.doc_id FROM n s JOIN n t ON s.n = 0 AND t.n = 0 AND s.doc_id < t.doc_id),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.a, r.root FROM r JOIN e ON e.b = r.doc_id),
m AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT m.doc_id, class_id, coalesce(n_links, 0) AS n_links, count(*) OVER (PARTITION BY class_id) AS class_size,
  m.doc_id = class_id AS kept FROM m LEFT JOIN k ON k.doc_id = m.doc_id
"""


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "class_size", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs, table(spark, sf_dir, "labels")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "removed_words", F.size("spans").alias("n_spans"), "spans", F.length("clean_text").cast("long").alias("clean_chars"), F.md5(F.col("clean_text").cast("binary")).alias("clean_md5"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")).select("doc_id", "n_pieces", "ids_crc32", "decoded_md5", "round_trip")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (given + 1) % 10).otherwise(given)
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
         CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER k AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW k AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER k <= 5
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_html_text,
        op3_exact_dedup,
        op4_topk,
        op5_toxicity,
        op6_packing,
        op7_jaccard_join,
        op8_token_counts,
        op9_substring_dedup,
        op10_sentencepiece,
        op11_quality,
        op12_hard_negatives,
    )
}
ORACLES = {"op1_warc": OP1_SQL, "op4_topk": OP4_SQL, "op3_exact_dedup": OP3_SQL, "op7_jaccard_join": OP7_SQL, "op12_hard_negatives": OP12_SQL}
