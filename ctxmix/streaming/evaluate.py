"""Incremental scoring of prediction files as they land in a folder.

The batch evaluator scores every result file of a results folder; this is the same
work as a Structured Streaming query: a file source over JSON-lines prediction
files, the native EM/CEM expressions, and a running aggregate per
``(experiment, variant)``. State is one row per run, so it stays tiny, and the
checkpoint location (on shared storage) makes the query restartable after a
failure without double counting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import score_answers

PREDICTION_LINE_SCHEMA = T.StructType([
    T.StructField("experiment", T.StringType()),
    T.StructField("variant", T.StringType()),
    T.StructField("qid", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("gold_answer", T.StringType()),
    T.StructField("prediction", T.StringType()),
])


def prediction_stream(spark: SparkSession, folder: str,
                      schema: T.StructType = PREDICTION_LINE_SCHEMA,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming rows of the JSON-lines prediction files in ``folder``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(folder)


def scored_stream(stream: DataFrame) -> DataFrame:
    """EM / CEM per prediction row; a missing gold answer counts as ''."""
    s = stream.withColumn("has_gold", F.col("gold_answer").isNotNull())
    return score_answers(s)


def running_metrics(scored: DataFrame, keys: Sequence[str] = ("experiment", "variant")) -> DataFrame:
    """Running count, mean EM and mean CEM per run (streaming aggregation)."""
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.avg(F.col("exact_match").cast("double")).alias("exact_match"),
        F.avg(F.col("cover_exact_match").cast("double")).alias("cover_exact_match"),
        F.count_if(~F.col("has_gold")).alias("n_missing_gold"))


def start_incremental_evaluation(spark: SparkSession, folder: str, checkpoint_location: str,
                                 query_name: str = "run_metrics", sink: str = "memory",
                                 trigger_available_now: bool = False) -> StreamingQuery:
    """Start the streaming evaluator; metrics are kept complete (one row per run)."""
    metrics = running_metrics(scored_stream(prediction_stream(spark, folder)))
    w = (metrics.writeStream.outputMode("complete").format(sink).queryName(query_name)
         .option("checkpointLocation", checkpoint_location))
    if trigger_available_now:
        w = w.trigger(availableNow=True)
    return w.start()
