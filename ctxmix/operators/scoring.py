"""Answer scoring and per-variant metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cover_exact_match, exact_match


def score_answers(df: DataFrame, prediction: str = "prediction",
                  gold: str = "gold_answer") -> DataFrame:
    """F8: add ``exact_match`` and ``cover_exact_match`` (0/1 ints) to prediction rows."""
    return (df.withColumn("exact_match", exact_match(prediction, gold))
            .withColumn("cover_exact_match", cover_exact_match(prediction, gold)))


def evaluate(scored: DataFrame, keys: Sequence[str] = ("experiment", "variant"),
             variants: DataFrame | None = None) -> DataFrame:
    """A2: rows, mean EM and mean CEM per run (0 when a run has no rows).

    Also reports ``n_missing_gold`` (when ``has_gold`` exists) and ``n_failed`` (when
    an ``error`` column exists). ``variants`` lists runs that must appear even if empty: each enters as a row
    that is not counted, so no join is needed. Partial aggregation sums hot runs map-side.
    """
    keys = list(keys)
    extra = [c for c in ("has_gold", "error") if c in scored.columns]
    rows = scored.select(*keys, "exact_match", "cover_exact_match", *extra, F.lit(True).alias("_row"))
    if variants is not None:
        rows = rows.unionByName(variants.select(*keys, F.lit(False).alias("_row")), allowMissingColumns=True)
    mean = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c)
    aggs = [F.count_if("_row").alias("num_samples"), mean("exact_match"), mean("cover_exact_match")]
    if "has_gold" in extra:
        aggs.append(F.count_if(~F.col("has_gold")).alias("n_missing_gold"))
    if "error" in extra:
        aggs.append(F.count_if(F.col("error").isNotNull()).alias("n_failed"))
    return rows.groupBy(*keys).agg(*aggs)


def summary(metrics: DataFrame, experiment_order: Sequence[str] = (),
            experiment: str = "experiment", variant: str = "variant") -> DataFrame:
    """One row per run, EM and CEM in percent, fixed experiment order then name."""
    order = F.lit(len(experiment_order))
    for i, name in reversed(list(enumerate(experiment_order))):
        order = F.when(F.col(experiment) == name, F.lit(i)).otherwise(order)
    return (metrics
            .withColumn("em_pct", F.round(F.col("exact_match") * 100, 2))
            .withColumn("cem_pct", F.round(F.col("cover_exact_match") * 100, 2))
            .withColumn("experiment_order", order)
            .orderBy("experiment_order", experiment, variant))
