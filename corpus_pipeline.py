"""The corpus pipeline: five stages, each one operator of tabclone.llm over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs; all but the last return the columns of documents.  Null or empty texts, repeated rows and null ids are defined by the
operators; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabclone.llm import base, language_id, line_dedup, ngram_join, packing, quality_rules, queries

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language go."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    told = language_id.label(docs.select(*COLUMNS), queries.language_model(source), into="_language")
    return told.where(F.col("_language.lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the base rule or the learned list rejects go."""
    rules = quality_rules.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(docs.select(*COLUMNS), rules, into="_quality").where("_quality.kept").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated chunks of lines go from the texts; n_chars follows."""
    done = line_dedup.dedup(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each class stays."""
    return ngram_join.keep_one(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all documents, with their ids."""
    return packing.pack(docs, queries.tokenizer("byte_bpe_50k.json"), end_id=1, longest=2048)


STAGES = [("language_id", identify), ("quality_rules", judge), ("line_dedup", dedup_lines), ("ngram_jaccard", join_ngrams), ("packing", pack)]
#: No stage's model, tokenizer or sketch can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = base.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
