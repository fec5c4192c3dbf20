"""Results of a costly model kept in a shared table under the hash of what was asked.

Asking works on distinct keys. What the table has is not asked again; the rest is dealt into tasks of bounded
size, and each task's results enter the table when the task ends, not when the job does (version 2 of the
file output committer). A job that dies, or a driver that is killed, leaves the results of all tasks that
had ended, and the next call asks for the remainder only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import parallelism

#: Keys that a task asks for, and so the results that a lost task loses.
PER_TASK = 2000


class Stored(NamedTuple):
    """A model factory whose results are kept in the table at ``path``; accepted wherever a factory is."""
    factory: Callable
    path: str
    per_task: int = PER_TASK


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether any result file is there (folders of unfinished tasks do not count)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/*.parquet")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_store(spark: SparkSession, path: str, schema: T.StructType, key: str, good: str = "true") -> DataFrame:
    """One result for each key. Where several were stored (a task was lost after it had ended, or a failure was asked
    again), one that is ``good`` comes first."""
    table = spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    rest = [c for c in schema.names if c != key]
    best = F.min_by(F.struct(*rest), F.struct((~F.expr(good)).alias("bad"), F.xxhash64(*rest).alias("h")))
    return table.groupBy(key).agg(best.alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def remember(asked: DataFrame, key: str, ask: Callable[[DataFrame], DataFrame], path: str, schema: T.StructType, *,
             good: str = "true", per_task: int = PER_TASK, like: Sequence[str] = (),
             deal: Callable[[DataFrame, int], DataFrame] = lambda d, tasks: d.repartition(tasks)) -> DataFrame:
    """Results for all rows of ``asked`` (unique by ``key``), read from the table at ``path`` after asking for those it lacks.

    ``ask`` maps rows of ``asked`` to results of ``schema``, row by row. Results that are not ``good`` (an SQL
    condition) are asked again. Tasks get rows alike in ``like`` (columns), else as ``deal`` has it: evenly, by default.
    """
    spark = asked.sparkSession
    known = read_store(spark, path, schema, key, good).where(good).select(key)
    lacking = asked.join(known, key, "left_anti")
    tasks = max(parallelism(spark), -(-lacking.count() // per_task))
    dealt = lacking.repartitionByRange(tasks, *like, key).sortWithinPartitions(*like, key) if like else deal(lacking, tasks)
    (ask(dealt).select(*schema.names).write.mode("append")
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path))
    return read_store(spark, path, schema, key, good).join(asked.select(key), key, "left_semi")
