"""Session helpers: a tuned local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "ctxmix") -> SparkSession:
    """Session used by tests and bench.py. On a cluster, pass your own session instead."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CTXMIX_DRIVER_MEMORY", "16g"))
        .config("spark.python.worker.reuse", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and points at shared storage; without it
    this raises, because other machines would not see a local folder. Only a ``local``
    master (tests) gets a fresh folder of its own when the setting is unset.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ctxmix-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder for written tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/tables/{name}-{uuid.uuid4().hex[:12]}"


def drop_tables(spark: SparkSession) -> bool:
    """Delete every table that this application has written by :func:`materialize` or to a
    :func:`scratch_path`. Call it when results that read them have been stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark).rstrip('/')}/tables")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "stage", codec: str = "snappy", by: Sequence[str] = ()) -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared checkpoint folder and
    read it back. One job (a reliable ``checkpoint()`` recomputes its last stage to
    write), and the result survives executor loss.

    With ``by`` the table lies in :func:`parallelism` buckets of these columns: a join on them reads it where it lies, a task for each
    bucket, and shuffles the other side only. It enters the session's catalog for that and leaves it at once; its files stay."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    if by:
        table = f"ctxmix_{uuid.uuid4().hex}"
        (df.write.format("parquet").option("compression", codec).option("path", path)
         .bucketBy(min(parallelism(spark), 10000), *by).saveAsTable(table))
        try:
            return spark.table(table)
        finally:
            spark.sql(f"DROP TABLE {table}")
    df.write.mode("overwrite").parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism,
               int(spark.conf.get("spark.sql.shuffle.partitions", "1")))


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal a CPU-heavy stage's input (Python models, long-text scans) over the cores.

    With ``partitions`` it is repartitioned to that number, which AQE never merges. Without,
    only a scan of fewer files than there are cores is dealt out; everything else
    stays as it is. Nothing upstream is executed to find out.
    """
    if partitions:
        return df.repartition(partitions)
    files = len(df.inputFiles())
    return df.repartition(parallelism(df.sparkSession)) if 0 < files < parallelism(df.sparkSession) else df


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Make ``ctxmix`` importable in the Python workers (like ``--py-files``).

    Operators that run Python on executors (scoring cells, encoders, generators) call
    this once per application; the zipped package is distributed by Spark itself.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="ctxmix-py-"), "ctxmix.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
