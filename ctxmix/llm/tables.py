"""Reading the given tables, spread over the cores that there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it lies there. One with fewer files than cores (a small one) is dealt out,
    so that Python stages run on all cores; larger tables are never shuffled for this."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) * 2 >= cores else df.repartition(cores)


def fold(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % k


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hash_sample(ids: DataFrame, key: str, n: int, by: str) -> DataFrame:
    """At most ``n`` different keys for each value of ``by``, always the same ones: those with the smallest hashes.

    Values of ``by`` are few (classes). They are counted first, and a cut on the hash leaves about twice
    as many rows as wanted, whatever the size of the table; only these are ranked.
    """
    scale, ids = 1 << 40, ids.select(key, by).distinct()
    total = ids.groupBy(by).count().select(by, F.least(F.lit(scale), F.ceil(F.lit(2 * n + 100) * F.lit(scale) / F.col("count"))).alias("__cut"))
    few = ids.join(F.broadcast(total), by).where(F.pmod(F.xxhash64(key), F.lit(scale)) < F.col("__cut")).drop("__cut")
    w = Window.partitionBy(by).orderBy(F.pmod(F.xxhash64(key), F.lit(scale)), key)
    return few.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
