"""From raw documents to token ids: quality rules, near duplicates, secrets, source mixture, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysheaf.llm import bpe, mixing, near, quality, secret_scan
from paysheaf.llm.shared import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Near duplicates and exact token ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    """The table's columns; its ``source`` plays the issuing company."""
    return docs.select(*COLUMNS).withColumnRenamed("source", "company")


def _table(docs: DataFrame) -> DataFrame:
    return docs.withColumnRenamed("company", "source").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither their own rules nor their source's verdict reject."""
    kept = quality.judged(_documents(docs), carry=True).where("kept")
    return _table(kept.select("doc_id", "company", "text", "row.lang", "row.n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 0.8 of the five-word shingles."""
    return _table(near.first_of_groups(_documents(docs)))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and ``n_chars`` counted anew where the text changed."""
    versions = _documents(docs).withColumns({"attempts": F.lit(1), "before": F.length("text")})
    out = secret_scan.cleaned(versions)
    n_chars = F.when(F.length("text") == F.col("before"), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))
    return _table(out.withColumn("n_chars", n_chars))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target shares of its source want it."""
    return _table(mixing.repeated(_documents(docs)))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, the digest of the text that they decode to, and their number."""
    coded = bpe.encoded(_documents(docs), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secrets),
    ("source_mixture", source_mixture),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table ``documents``; every stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
