"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxmix.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Alternates large-star and small-star rounds. Each round only takes minima by node
    (partial aggregation) and joins them back, and is written to the shared checkpoint
    folder. It ends when a round changes nothing; self-links and nulls are left out.
    """
    edges = materialize(
        links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where("hi > lo").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    state = None
    for _ in range(max_rounds):
        # large-star: each node's larger neighbours move to the smallest of its neighbourhood
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u").select(
            F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small-star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi")
        edges = materialize(
            moved.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi > lo")
            .unionAll(least.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        state = now
    raise RuntimeError(f"links still change after {max_rounds} rounds")
