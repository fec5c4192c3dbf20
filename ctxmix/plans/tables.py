"""Readers for the driver's test tables and the views the fixture queries build on them.

Roles the driver tables play (all derived by Spark from whole tables):

* questions and corpus for retrieval: every ``embeddings`` row is both a question
  (``qid = vec_id``) and a passage (``doc_id = vec_id``); a question never retrieves
  itself. Gold passages of a question are the ones with the same ``label``.
* passage text: ``documents`` joined on ``doc_id = vec_id``; titles from ``part``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """``documents`` for per-row text work (normalization, hashing, substring scans):
    spread over all cores when the file has fewer splits than the cluster has cores."""
    d = table(spark, sf_dir, "documents")
    return spread(d.select(*cols) if cols else d)


def retrieval_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(qid, embedding, q_label)`` - every embedding row asks one question."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("qid"), "embedding", F.col("label").alias("q_label"))


def retrieval_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, embedding, d_label)`` - every embedding row is one passage vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("d_label"))


def doc_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, title, text)`` from ``documents``; the title is the document source."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("title"),
                    F.coalesce(F.col("text"), F.lit("")).alias("text"))


def sparse_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as passages under twice their id, so that half of the vectors' ids are unknown."""
    return doc_passages(spark, sf_dir).withColumn("doc_id", F.col("doc_id") * 2)


def part_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, title, text)`` from ``part``: title ``p_name``, text brand + type."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("doc_id"),
                    F.coalesce(F.col("p_name"), F.lit("")).alias("title"),
                    F.concat_ws(" ", "p_brand", "p_type").alias("text"))
