"""Session construction and lineage helpers.

Everything in the package takes an existing ``SparkSession``; this module
only offers a sensible builder for local runs and tests, and the checkpoint
helper used where an expensive intermediate is read twice.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "catalign", driver_memory: str = "8g") -> SparkSession:
    """Session with AQE, skew-join splitting and Arrow transfer switched on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": driver_memory,
        "spark.ui.showConsoleProgress": "false",
        # a checkpoint's files go when nothing refers to it any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster must name a shared folder; only a local-mode session without
    one (tests, laptops) gets a fresh temporary folder, removed at exit.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    path = tempfile.mkdtemp(prefix="catalign-ckpt-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (cuts lineage, survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def over_cores(df: DataFrame) -> DataFrame:
    """Deals the rows of a scan or a materialised table over the cores where it
    has fewer partitions; those are known beforehand, so no job runs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table's scan.  ``spread`` deals the rows of a file that Spark cannot
    split (one large row group) over the cores, for CPU-heavy row work; only
    the scan's own splits are looked at, so no job runs, and a table of many
    files is left as it is."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return over_cores(df) if spread else df
