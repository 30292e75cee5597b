"""Session helpers: UTC, repeated JSON keys, the shared folder."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """Dates are UTC dates everywhere."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def keep_last_key(spark: SparkSession) -> SparkSession:
    """Of equal keys in a JSON object the last counts; Spark would refuse the whole text."""
    if spark.conf.get("spark.sql.variant.allowDuplicateKeys") != "true":
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """The settings that results depend on, once per session."""
    return keep_last_key(use_utc(spark))


def local_session(cpus: int | str = "*", app: str = "demandweave") -> SparkSession:
    """A session for tests and benchmarks on one machine. Clusters bring their own."""
    n = 8 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@functools.cache
def _local_folder() -> tempfile.TemporaryDirectory:
    """One temporary folder per process, removed when the process ends."""
    return tempfile.TemporaryDirectory(prefix="demandweave-", ignore_cleanup_errors=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session may go without that setting (tests): it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_folder().name
    return f"{root.rstrip('/')}/demandweave-{uuid.uuid4().hex}"


def stage(df: DataFrame, folder: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """A function that stores a frame as a table in the shared folder, by name, and reads it back.

    ``key``, ``buckets``: cut the table into buckets of the key, so that it joins without an exchange.
    The tables go when the block ends; they are Spark's own (managed) tables of a database.
    """
    database = f"demandweave_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{shared_folder(spark)}'")

    def keep(df: DataFrame, name: str, key: Sequence[str] = (), buckets: int = 0) -> DataFrame:
        out = df.repartition(buckets, *key).write.bucketBy(buckets, *key) if key else df.write
        out.saveAsTable(f"{database}.{name}")
        return spark.table(f"{database}.{name}")

    try:
        yield keep
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Hand the rows of a scan with too few splits to all cores, for work heavy on the CPU.

    A table of many files has more splits than there are cores and is left alone. Only for
    scans: counting the partitions of a shuffled frame would run it.
    """
    slots, splits = scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    return scan if splits >= slots else scan.repartition(min(slots, 8 * splits), key)
