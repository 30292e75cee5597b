"""Intermediate tables, written once to the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from demandweave.session import shared_folder

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` and read it back: its lineage ends there, so a lost executor costs no more
    than the tasks at hand. The shuffle files of the write are freed as soon as it is done.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    try:
        before = spark.conf.get(_CLEANUP)
    except PySparkException:  # a Spark without this setting frees them later
        before = None
    if before is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(folder)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many _ behind it as it takes to be none of ``taken`` (in any case)."""
    held = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out
