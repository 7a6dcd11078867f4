"""Thin queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevier.llm.chat import TURN_ROW, canonical_turns, format_chats, read_loss, read_turns, turn_rows
from brevier.llm.common import held_out, spread
from brevier.llm.decontaminate import contaminated_pairs
from brevier.llm.language_id import identify, train
from brevier.llm.licenses import license_matches
from brevier.llm.line_quality import quality_rules
from brevier.llm.merkle import fold, leaf_digest, manifest
from brevier.llm.oracles import ORACLE_SQL as ORACLE_SQL
from brevier.llm.packing import pack_documents
from brevier.llm.simhash import near_duplicate_groups
from brevier.llm.spelling import count_words, spelling_variants
from brevier.llm.substring_dedup import substring_dedup
from brevier.llm.toxicity import score, train as train_toxicity
from brevier.llm.url_filter import filter_urls
from brevier.llm.warc import read_records, write_archives

URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
TOXIC_FROM = 0.3
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is read; one of fewer files than cores is dealt over these."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept after removal of repeated 20-word windows, as counts and a digest."""
    kept = substring_dedup(table(spark, sf_dir, "documents"), window=20)
    return kept.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learnt from the two thirds whose remainder is not 1."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs, ~held_out("doc_id", 3, 1)))
    return found.select(
        F.col("id").alias("doc_id"), held_out("id", 3, 1).alias("held_out"), "lang_pred", "score", "bits"
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, whole or in reordered parts."""
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and whether it is kept once its host's frequent lines are gone."""
    return quality_rules(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back, by byte ranges, from the archives that it was written to."""
    index = write_archives(table(spark, sf_dir, "pages"))
    return read_records(index, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=3, seed=42, max_bits=2)
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in each document."""
    return license_matches(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learnt from the labels whose remainder is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out("id", 4, 2))
    return score(docs, model).select(
        F.col("id").alias("doc_id"),
        held_out("id", 4, 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0).alias("predicted"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and root of every document, and the root that its leaf leads to after some were tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = F.col("n_chars") + F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, 1).otherwise(0)
    tampered = docs.withColumn("now", leaf_digest(*[more if c == "n_chars" else F.col(c) for c in LEAF_FIELDS]))
    rows = fold(manifest(tampered, fields=LEAF_FIELDS, keep=("now",)), leaf="now")
    return rows.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2("proof", 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold control strings, formatted and read back, as digests."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*own.columns).union(own)
    chats = format_chats(canonical_turns(turn_rows(rows), (TURN_ROW,)))
    read = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learnt"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some damaged on the way, with the common form that each may stand for."""
    words = count_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=7, damage=31)
    return spelling_variants(words, least=7, least_count=2, ratio=10).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_simhash": op8_simhash,
    "op9_license_scan": op9_license_scan,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_chat_format": op12_chat_format,
    "op13_spelling_variants": op13_spelling_variants,
}
