"""A training corpus from ``documents``: language, boilerplate lines, near copies, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspindle.llm import decontaminate, jaccard, langid, lines, packing
from logspindle.llm.shared import discard, settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; learned from the labelled ones among them that aren't held out."""
    return langid.keep_identified(docs.select(*COLUMNS), langid.train(docs.where(~langid.held_out())))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; those of which nothing is left go."""
    out = lines.dedup_lines(docs.select(*COLUMNS))
    gone = (F.col("n_dropped") > 0) & (F.trim(F.regexp_replace("text", r"\s+", "")) == "")
    cut = out.where(~F.coalesce(gone, F.lit(False)))
    return cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of linked ones, and those that link with none."""
    return jaccard.keep_one(docs.select(*COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item, word for word or with up to ``decontaminate.SLOP`` words between."""
    return decontaminate.keep_clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packed),
]

#: Compression sizes, sketches and tokens are beyond SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, settle(stage(spark, docs, sf_dir))
        discard(before)
    return docs
