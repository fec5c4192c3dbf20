"""Lookups that survive a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, facts: DataFrame, key: str, size: str, share: int = 1000) -> DataFrame:
    """``rows`` left-joined to ``facts``, which has one row per ``key`` and in ``size`` the rows of it.

    Keys that hold over 1/``share`` of all rows number at most ``share``: they are broadcast, so
    no task gets all rows of one of them. The rest is shuffled. ``size`` is dropped.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    hot = facts.where(F.col(size) > max(total // share, 1000))
    names = hot.select(F.col(key), F.lit(True).alias("__hot"))
    marked = rows.join(F.broadcast(names), key, "left")
    one = marked.where("__hot").drop("__hot").join(F.broadcast(hot.drop(size)), key, "left")
    rest = marked.where("__hot is null").drop("__hot").join(facts.drop(size), key, "left")
    return one.unionByName(rest)


def salted_join(many: DataFrame, few: DataFrame, key: str, spread_by: str, salts: int = 16, shuffled: bool = False) -> DataFrame:
    """Inner join on ``key`` where both sides may have many rows of one key: ``many`` is dealt by the hash
    of ``spread_by`` over ``salts`` parts of a key, and ``few`` is repeated for each part.

    Spark sizes the repeated rows like the one they come from. With ``shuffled`` they are never broadcast, whatever that estimate is."""
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    repeated = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    repeated = repeated.hint("merge") if shuffled else repeated
    return many.withColumn("__salt", salt).join(repeated, [key, "__salt"]).drop("__salt")
