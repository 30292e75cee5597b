"""Silver reconciliation: fetched postings against the jobs on record.

The rules read like a loop over arrivals, but each is a set operation:

* of equal (source, source_job_id) the first arrival counts;
* a known key is refreshed;
* a new key is skipped if its content hash belongs to another source. The owner of a hash is
  the source of the last known key that arrived before with this hash, else of the active job
  on record, else of the first arrival. (A new key never changes the owner's source: it is
  accepted only if it has that source, or if there was none.)
* an active job that its successfully read board no longer lists is deactivated.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from demandweave.functions.text import dedup_hash, make_job_id
from demandweave.operators.dedup import first_per_key

KEY = ["source", "source_job_id"]

# Arrival numbers of postings inside payloads: payload number * this + place in the payload.
# A payload is one string of less than 2 GiB and a posting takes 9 characters or more.
POSTINGS_PER_PAYLOAD = 1 << 28

# Arrival numbers which one task takes of one hash: the postings of 4096 payloads.
ARRIVALS_PER_TASK = 4096 * POSTINGS_PER_PAYLOAD

FIELDS = [
    "board_token", "company", "title", "location", "is_remote", "description", "apply_url",
    "posted_at", "dedup_hash",
]


def run_dedup(fetched: DataFrame) -> DataFrame:
    """The first arrival of each (source, source_job_id)."""
    return first_per_key(fetched, KEY, "seq")


def with_hash(fetched: DataFrame) -> DataFrame:
    """The postings with their content hash; postings that were stored with it keep it."""
    if "dedup_hash" in fetched.columns:
        return fetched
    return fetched.withColumn(
        "dedup_hash", dedup_hash(F.col("company"), F.col("title"), F.col("location"))
    )


def hash_owners(existing: DataFrame) -> DataFrame:
    """Source of the active job with the smallest job_id, per hash."""
    return existing.filter("is_active").groupBy("dedup_hash").agg(F.min_by("source", "job_id").alias("source"))


def decide(arrivals: DataFrame, existing: DataFrame, arrivals_per_task: int = ARRIVALS_PER_TASK) -> DataFrame:
    """A decision (update, insert or skip) per arrival.

    ``arrivals``: source, source_job_id, seq, dedup_hash, one row per key. A hash may hold any
    share of them, so it is never processed as a whole: its arrivals are cut into chunks of
    ``arrivals_per_task`` numbers. Each chunk first yields one summary row; a window over the
    summaries finds the owner at the start of each chunk; that owner enters the chunk as a row
    before its first arrival.
    """
    known = existing.select(*KEY, F.lit(True).alias("known"))
    rows = arrivals.select(*KEY, "seq", "dedup_hash").join(known, KEY, "left")
    rows = rows.select(
        *KEY, "seq", "dedup_hash", F.coalesce("known", F.lit(False)).alias("known"),
        F.expr(f"seq div {int(arrivals_per_task)}L").alias("chunk"),
    )
    summary = rows.groupBy("dedup_hash", "chunk").agg(
        F.max(F.when(F.col("known"), F.struct("seq", "source"))).getField("source").alias("last_known"),
        F.min(F.struct("seq", "source")).getField("source").alias("first"),
    )
    # The job on record is an owner before all arrivals: it stands in a chunk below the others.
    on_record = hash_owners(existing).select(
        "dedup_hash", F.lit(-1).cast("long").alias("chunk"),
        F.col("source").alias("last_known"), F.col("source").alias("first"),
    )
    summary = summary.unionByName(on_record)
    earlier = Window.partitionBy("dedup_hash").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    entering = (
        summary.withColumn(
            "source",
            F.coalesce(F.last("last_known", ignorenulls=True).over(earlier), F.first("first").over(earlier)),
        )
        .filter("source is not null and chunk >= 0")
        .select("dedup_hash", "chunk", F.lit(-1).cast("long").alias("seq"), "source", F.lit(True).alias("known"))
    )
    within = Window.partitionBy("dedup_hash", "chunk").orderBy("seq")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    owner = F.coalesce(
        F.last(F.when(F.col("known"), F.col("source")), ignorenulls=True).over(before),
        F.first("source").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    decided = rows.unionByName(entering, allowMissingColumns=True).withColumn("owner", owner)
    return decided.filter("seq >= 0").select(
        *KEY, "seq", "dedup_hash",
        F.when(F.col("known"), "update").when(F.col("owner") == F.col("source"), "insert")
        .otherwise("skip").alias("decision"),
    )


def plan_actions(
    existing: DataFrame, fetched: DataFrame, succeeded_boards: DataFrame, arrivals_per_task: int = ARRIVALS_PER_TASK,
) -> DataFrame:
    """(source, source_job_id, job_id, action) for each key that a run touches: insert, update, skip or
    deactivate. Of the jobs on record only keys, hashes and flags are read, no texts."""
    narrow = with_hash(fetched).select(*KEY, "seq", "dedup_hash")  # hashed before the exchange, which then moves no titles
    decided = decide(run_dedup(narrow), existing, arrivals_per_task).select(*KEY, F.col("decision").alias("action"))
    boards = succeeded_boards.select("source", "board_token").distinct()
    listed = existing.filter("is_active").select(*KEY, "board_token").join(boards, ["source", "board_token"], "left_semi")
    gone = listed.join(decided, KEY, "left_anti").select(*KEY, F.lit("deactivate").alias("action"))
    ids = existing.select(*KEY, "job_id")
    return decided.unionByName(gone).join(ids, KEY, "left").select(
        *KEY, F.coalesce("job_id", make_job_id(F.col("source"), F.col("source_job_id"))).alias("job_id"), "action")


def apply_actions(
    existing: DataFrame, fetched: DataFrame, actions: DataFrame, now: datetime | Column, slots: int | None = None,
) -> DataFrame:
    """New state of the jobs in ``existing`` and of those that ``actions`` (``plan_actions``) brings.

    Each side meets the actions before both are joined, so nothing is exchanged after that join.
    ``slots``: deal the fetched postings out by key into so many partitions, as ``existing`` is stored.
    """
    at = now if isinstance(now, Column) else F.lit(now)
    arrivals = fetched if slots is None else fetched.repartition(slots, *KEY)
    seen = with_hash(run_dedup(arrivals)).select(*KEY, *FIELDS).join(
        actions.filter("action <> 'deactivate'").select(*KEY, "job_id", F.col("action").alias("decision")), KEY).alias("f")
    gone_keys = actions.filter("action = 'deactivate'").select(*KEY, F.lit(True).alias("gone"))
    old = existing.join(gone_keys, KEY, "left").alias("e")
    both = old.join(seen, KEY, "full")

    on_record, fetched_now = F.col("e.job_id").isNotNull(), F.col("f.decision").isNotNull()
    gone = ~fetched_now & F.coalesce(F.col("gone"), F.lit(False))
    action = (
        F.when(fetched_now, F.col("f.decision")).when(gone, F.lit("deactivate")).otherwise(F.lit("keep"))
    )
    blank = {"is_remote": F.lit(False), "description": F.lit(""), "apply_url": F.lit("")}

    def field(name: str) -> Column:
        new = F.coalesce(F.col(f"f.{name}"), blank[name]) if name in blank else F.col(f"f.{name}")
        return F.when(fetched_now, new).otherwise(F.col(f"e.{name}")).alias(name)

    f = {name: field(name) for name in FIELDS}
    return both.select(
        F.when(on_record, F.col("e.job_id")).otherwise(F.col("f.job_id")).alias("job_id"),
        "source", "source_job_id", f["board_token"], f["company"], f["title"], f["location"],
        f["is_remote"], f["description"], f["apply_url"], f["posted_at"], f["dedup_hash"],
        F.when(on_record, F.col("e.first_seen_at")).otherwise(at).alias("first_seen_at"),
        F.when(fetched_now, at).otherwise(F.col("e.last_seen_at")).alias("last_seen_at"),
        F.when(fetched_now, F.lit(True)).when(gone, F.lit(False))
        .otherwise(F.col("e.is_active")).alias("is_active"),
        action.alias("action"),
    )


def reconcile(
    existing: DataFrame,
    fetched: DataFrame,
    succeeded_boards: DataFrame,
    now: datetime | Column,
    arrivals_per_task: int = ARRIVALS_PER_TASK,
) -> DataFrame:
    """New state of every job with the action that led to it, in one plan.

    Columns: those of jobs, and ``action``: insert, update, deactivate, keep, or skip (fetched
    but not accepted: not part of the new state; see ``jobs_of``).
    """
    actions = plan_actions(existing, fetched, succeeded_boards, arrivals_per_task)
    return apply_actions(existing, fetched, actions, now)


def jobs_of(reconciled: DataFrame) -> DataFrame:
    """The new jobs table."""
    return reconciled.filter("action <> 'skip'").drop("action")


def touched(reconciled: DataFrame) -> DataFrame:
    """The jobs inserted or refreshed in this run."""
    return reconciled.filter(F.col("action").isin("insert", "update"))


def action_counts(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("action").agg(F.count(F.lit(1)).alias("jobs"))
