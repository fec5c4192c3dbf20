"""Corpus pipeline: toxicity, language, SimHash near-duplicates, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
``run`` writes every stage as Parquet in the shared checkpoint folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ctxmix.llm import language_id, packing, queries, simhash, toxicity
from ctxmix.llm.tables import read
from ctxmix.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go. The model is learnt from the labelled rows of the tables."""
    model = toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (``und``) go, and those whose best language scores below ``language_id.LEAST``."""
    return language_id.keep_known(docs, *language_id.fit(read(spark, sf_dir, "documents")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints of 3-word shingles within 2 bits, the smallest id stays."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 1024 tokens."""
    return packing.pack(docs, queries._file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("simhash", drop_near_duplicates),
    ("packing", pack),
]

#: Learnt scores and evolved packings are beyond SQL; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
