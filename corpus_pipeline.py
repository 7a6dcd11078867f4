"""The corpus pipeline: filters and deduplicates documents, then packs them into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevier.llm.common import held_out, new_folder
from brevier.llm.decontaminate import decontaminate
from brevier.llm.language_id import UNKNOWN, identify, train
from brevier.llm.near_copies import drop_near_copies
from brevier.llm.packing import pack_documents
from brevier.llm.queries import tokenizer_path
from brevier.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter, and so without a language, go."""
    trees = train(docs, ~held_out("doc_id", 3, 1))
    known = identify(docs.select(*COLUMNS), trees, keep=tuple(COLUMNS)).where(F.col("lang_pred") != UNKNOWN)
    return known.select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Near copies have 5-word shingle sets of Jaccard similarity 0.8 or more: ball hashing of several short SimHashes
    brings them together, their sets tell.
    """
    return drop_near_copies(docs, shingle=5, threshold=0.8).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that also start earlier; untouched texts stay as they are.

    What is left of a changed text is its kept words, joined by one space, and n_chars is counted anew.
    """
    kept = substring_dedup(docs, keep=("lang", "source", "n_chars"), verbatim=True)
    return kept.select(
        F.col("id").alias("doc_id"),
        F.col("kept_text").alias("text"),
        "lang",
        "source",
        F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 4096 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substrings),
    ("benchmark decontamination", benchmarks),
    ("best-fit packing", packing),
]

#: Code lengths, tokens and the packing plan have no SQL form; tests hold the whole pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's result but the last's is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = new_folder(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
