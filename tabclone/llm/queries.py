"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, bpe, kd_shards, language_id, line_dedup, ngram_join, packing, quality_rules, rp_forest, token_files, url_filter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    return Path(public_tokenizers.path(name)).read_text()


def language_model(docs: DataFrame) -> language_id.Model:
    """Learnt from documents with an id that are not held out."""
    return language_id.train(docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out()))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    told = language_id.label(docs.select("doc_id", "text"), language_model(docs.select("doc_id", "text", "lang")))
    return told.select("doc_id", language_id.held_out().alias("held_out"), "language.lang_pred", "language.score", "language.n_spans")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = base.place(spark, "token-files")
    token_files.write(_documents(spark, sf_dir), path, tokenizer("byte_bpe_50k.json"), end_id=0)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: The stated rules of the url query: verdict, host and path.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules, default="allow")


OP4_SQL = """
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
judged AS (SELECT c.*, (SELECT arg_max(r.host || r.path || ' ' || r.verdict, length(r.host || r.path)) FROM rules r WHERE (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)) AS won FROM cut c)
SELECT page_id, host, path, split_part(won, ' ', 1) AS rule, coalesce(split_part(won, ' ', 2), 'allow') AS verdict FROM judged
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=1, longest=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_documents(spark, sf_dir)).select("doc_id", "class_id", "copies", "n_links")


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard(_documents(spark, sf_dir), 24)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_documents(spark, sf_dir).select("doc_id", "text"), into="removed_chars")


def op9_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return rp_forest.nearest(rows, F.col("vec_id") % 100 == 0, k=10)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    rules = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(docs.select("doc_id", "text"), rules, into="q").select("doc_id", *(f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_bpe_round_trip, op3_token_files, op4_url_filter, op5_packing, op6_ngram_jaccard, op7_kd_shards, op8_line_dedup, op9_rp_forest, op10_quality_rules)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": OP4_SQL}
