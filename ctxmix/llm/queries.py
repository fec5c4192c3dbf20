"""The operators on the given tables, as registered queries."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxmix.llm import bpe, chat_format, cover_tree, fingerprint, importance, language_id, license_scan, oracles, packing, quality, repair, simhash, token_counts, toxicity
from ctxmix.llm.tables import fold, read


def _file(name: str) -> bytes:
    """A vocabulary file (at most some MB), read by the driver; tasks get it as a broadcast."""
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; learnt from the four fifths that are not held out."""
    docs = read(spark, sf_dir, "documents")
    found = language_id.language_id(docs.select("doc_id", "text"), *language_id.fit(docs))
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors linked at a cosine of 0.95 or more."""
    return cover_tree.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the bytes they decode to, as digests."""
    return bpe.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), _file("byte_bpe_multi_50k.tiktoken"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text."""
    return token_counts.token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), _file("word_bpe_49k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 3-word shingles, linked at 2 bits or fewer."""
    return simhash.simhash(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole text and the verdict of the weighed rules."""
    return quality.quality(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), _file("byte_bpe_50k.json"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings, formatted and read back."""
    marks = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(chat_format.format_turns(given.unionByName(extra)))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every whole text."""
    return license_scan.license_scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; learnt from labelled rows outside the held-out third."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn by how much their words look like those of the benchmark."""
    return importance.resample(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op12_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of each edited with the next one, and how alike they are."""
    return fingerprint.edited_neighbours(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and then repaired by the cheapest edits."""
    return repair.repair(repair.damage(read(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_embedding_dedup, op3_bpe, op4_token_counts, op5_simhash, op6_quality, op7_packing, op8_chat, op9_licenses, op10_toxicity, op11_importance, op12_fingerprint, op13_repair)}
ORACLE = {"op2_embedding_dedup": oracles.OP2, "op8_chat": oracles.OP8, "op9_licenses": oracles.op9(), "op11_importance": oracles.op11(), "op13_repair": oracles.op13()}
