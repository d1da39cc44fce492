"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, documents with benchmark passages go, and what is left is encoded.

Each stage reads what the one before wrote. Near-duplicates are found on shingles of five words, at a similarity of 0.8 or more.

Defined cases, in all stages: a null or empty text isn't toxic, is no copy of another and holds no benchmark passage, so it stays and has no tokens; rows with a null id are judged by their text like others, but have no
labels; of repeated rows, and of copies, the one with the smallest id stays; texts of any length are taken whole, each by one task; further columns pass
through all stages but the last; empty tables give empty tables with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import bpe, decontam, minhash, toxicity
from loomspan.llm.shared import read, stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove(docs, read(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_table(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("bpe", encoded),
]

#: A fitted classifier, hashed signatures and merges aren't SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
