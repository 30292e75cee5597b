"""One row per key, safe for keys that hold a large part of all rows.

``row_number() = 1`` lets Spark drop all but one row per key and task before the shuffle
(WindowGroupLimit), so a hot key sends at most one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def first_per_key(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order, which must be total within a key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def representatives(active_jobs: DataFrame) -> DataFrame:
    """The posting with the smallest job_id for each content hash."""
    return first_per_key(active_jobs, ["dedup_hash"], "job_id")
