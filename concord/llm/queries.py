"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import bpe, decontamination, html_text, media, ngram_join, quality, sharding, token_table, urls, warc
from concord.llm.shared import shared_dir, table

WORD_BPE, BYTE_BPE, END = "word_bpe_49k.json", "byte_bpe_50k.json", 2


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.with_shard(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    warc.archive_pages(table(spark, sf_dir, "pages"), folder)
    return warc.page_records(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_loss=True)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.with_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op6_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    token_table.write_token_tables(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(BYTE_BPE), END)
    return token_table.read_token_tables(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "media")
    media.write_media(table(spark, sf_dir, "documents"), folder)
    return media.media_digests(spark, folder)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = F.col("quality_score")
    return quality.with_score(docs, model).select("doc_id", quality.held_out().alias("held_out"), score.alias("score"), (score >= quality.THRESHOLD).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_warc, op3_decontamination, op4_bpe, op5_html_text, op6_token_table, op7_url_filter, op8_media, op9_ngram_join, op10_quality)}


WARC_SQL = """
WITH rows AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS size, sha1(coalesce(html, '')) AS digest FROM pages),
groups AS (SELECT digest, max(page_id) AS first FROM rows WHERE size >= 1000 GROUP BY digest)
SELECT page_id, size AS payload_bytes, r.digest AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM rows r LEFT JOIN groups g ON g.digest = r.digest AND size >= 1000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": sharding.ORACLE.format(key="doc_id", columns="d.doc_id", table="documents", shards=len(sharding.SHARDS), slots=sharding.SLOTS),
        "op2_warc": WARC_SQL,
        "op7_url_filter": urls.oracle_sql(),
    }
