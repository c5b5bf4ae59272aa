"""Queries of this subpackage and their SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import chat, exact_dedup, html_text, mixing, near_dedup, packing, quality, secret_scan, tiff, token_counts
from strandlake.plans.session import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    s = quality.score(docs, model, cut=0.3)
    return s.select("doc.doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", F.col("span_list").alias("spans"), "n_crf", "n_tagged")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.texts_as_tiff(table(spark, sf_dir, "documents"))
    pages = tiff.tiff_pages(stored, keep=["doc_id", "n_bytes_text", "media_bytes", "media_sha256"])
    return pages.select("doc_id", F.col("n_bytes_text").alias("n_bytes"), F.col("n_bytes").alias("payload_bytes"), F.col("pixels_sha256").alias("payload_sha256"), F.col("tail_crc32"), "media_bytes", "media_sha256", "feature", "compression", "page")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return m.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.examples(turns.unionByName(extra)))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after its e-mail addresses are replaced."""
    c = token_counts.count_with_edits(table(spark, sf_dir, "documents"), token_counts.mail_edits)
    return c.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_secrets": op2_secrets,
    "op3_near_dedup": op3_near_dedup,
    "op4_html": op4_html,
    "op5_tiff": op5_tiff,
    "op6_packing": op6_packing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mixing": op8_mixing,
    "op9_chat": op9_chat,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL = {
    "op7_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
""",
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3.0::DOUBLE AS cap FROM t),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)
  AS left_over, (sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weights FROM r),
v AS (SELECT left_over / weights AS level FROM l WHERE left_over / weights <= ratio ORDER BY ratio, source ASC NULLS LAST LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(cap, level * weight) END AS target FROM l, v),
j AS (SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
  ('0x' || substr(sha256('8:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM j
""",
    "op9_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(text, '\', '\0') AS t0, replace(role, '\', '\0') AS r0 FROM c),
f AS (SELECT *,
  replace(replace(replace(replace(replace(replace(replace(t0, '<|', '\1|'), '<s>', '\1s>'), '</s>', '\1/s>'), '<<SYS>>', '\1<SYS>>'), '<</SYS>>', '\1</SYS>>'), '[INST]', '\2INST]'), '[/INST]', '\2/INST]') AS body,
  replace(replace(replace(replace(replace(replace(replace(replace(r0, '<|', '\1|'), '<s>', '\1s>'), '</s>', '\1/s>'), '<<SYS>>', '\1<SYS>>'), '<</SYS>>', '\1</SYS>>'), '[INST]', '\2INST]'), '[/INST]', '\2/INST]'), chr(10), '\3') AS head FROM e),
p AS (SELECT *, sum(length(head) + length(body) + 18) OVER w AS upto,
  row_number() OVER w = count(*) OVER (PARTITION BY conv_id) OR role = 'assistant' AS shown FROM f
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (shown))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
""",
}
