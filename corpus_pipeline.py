"""Corpus pipeline: quality rules, line dedup, MinHash near-dedup, substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and decides by itself.
All but the last return the columns of ``documents`` with ``n_chars`` brought up to date; ``run``
writes each stage's result as Parquet and rereads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import line_dedup, minhash, packing, quality, substring_dedup
from latticework.llm._common import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the posterior keeps; the rest go."""
    return quality.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that recur over documents; documents stay, also those without a line left."""
    return _documents(line_dedup.dedup_lines(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more."""
    return minhash.dedup_near(docs.select(*COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages that an earlier document has."""
    return _documents(substring_dedup.dedup_substrings(docs.select(*COLUMNS)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece, with its sequence and place."""
    return packing.best_fit_packing(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("substring_dedup", substrings), ("best_fit_packing", packed)]

#: Expectation maximisation and a tokenizer are not SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k:
            scratch.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
