"""Importance resampling towards a target distribution, on hashed word n-grams.

Both corpora shrink to counts by bucket; a bucket's gain is the log ratio of its smoothed shares.
A document's weight is the mean gain of its n-grams, and adding Gumbel noise that depends on its
id alone to the weights makes the highest scores a sample without replacement by weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxmix.llm import batches as B
from ctxmix.llm import grams
from ctxmix.operators.sampling import dense_index
from ctxmix.session import materialize, ship_code

#: Text bytes interned at a time: the table of such a slice stays in a core's cache.
_SLICE = 1 << 20


def count_buckets(texts: DataFrame, buckets: int, longest: int = 1, column: str = "text") -> DataFrame:
    """(bucket, n) over all texts; a task sends at most ``buckets`` rows."""
    ship_code(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in B.slices(batch, "text", _SLICE):
                total += grams.bucket_counts(part.column(0), buckets, 1, longest)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    return texts.select(texts[column].alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int, longest: int = 1) -> np.ndarray:
    """The gain of every bucket (whole thousandths, floored), a vector of ``buckets`` numbers."""
    spark = documents.sparkSession
    both = materialize(count_buckets(documents, buckets, longest).withColumn("own", F.lit(True))
                       .unionByName(count_buckets(target, buckets, longest).withColumn("own", F.lit(False))), "bucket_counts")
    own, wanted = (F.sum(F.when(F.col("own") == side, F.col("n")).otherwise(0)) for side in (True, False))
    total = both.agg(F.coalesce(own, F.lit(0)).alias("s"), F.coalesce(wanted, F.lit(0)).alias("t")).first()
    counts = (spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left")
              .groupBy("bucket").agg(own.cast("double").alias("s"), wanted.cast("double").alias("t")))
    ratio = (F.col("t") + 1) * F.lit(float(total["s"] + buckets)) / ((F.col("s") + 1) * F.lit(float(total["t"] + buckets)))
    out = np.zeros(buckets, np.int64)
    for r in counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():  # `buckets` rows
        out[r["bucket"]] = r["gain"]
    return out


def weigh(documents: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; weight is the floored mean gain, 0 without a feature."""
    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    gain_of = documents.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def factory():
        by_bucket = gain_of.value

        def weights(texts: pa.Array) -> list:
            found = grams.spans(texts, 1, longest)
            table = grams.intern(found, len(by_bucket))
            by_slot = by_bucket[table.bucket]
            n = np.diff(found.bounds)
            return [found.n_words, n, B.sums(by_slot[table.slot], found.bounds) // np.maximum(n, 1)]
        return weights

    return B.add_columns(documents, "text", ["doc_id"], fields, factory, _SLICE)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in whole thousandths, from SHA-256 of ``seed:doc_id`` (nothing after the colon for a null id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(documents: DataFrame, target: DataFrame, *, longest: int = 1, buckets: int = 10_000,
             percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row, all long.

    Drawn are ``floor(percent * N / 100)`` of the N rows with at least ``min_words`` words, highest scores
    first, ties to the smaller doc_id (null ids first, then fewer features). Null, empty and wordless texts
    weigh 0 and are never drawn. Rows that share an id share its noise; each is a row of its own, and which
    of rows alike in all columns gets the smaller rank makes no difference. Without documents the
    result is empty; without a target text every bucket's t is 0. Other columns are not read.

    The text is read twice (counting, weighing). Ranking sorts rows of a few numbers by range, so
    ranks come from the sizes of the sorted partitions, not from one task.
    """
    gain = gains(documents, target, buckets, longest)
    scored = materialize(
        weigh(documents, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    drawn = percent * scored.where(F.col("n_words") >= min_words).count() // 100
    order = scored.select("*", (F.col("n_words") < min_words).alias("short"), (-F.col("score")).alias("below"),
                          F.monotonically_increasing_id().alias("row"))
    placed, _ = dense_index(order, ["short", "below", "doc_id", "n_features", "row"])
    rank = F.when(F.col("idx") < drawn, F.col("idx") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
