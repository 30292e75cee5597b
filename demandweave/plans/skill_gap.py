"""The gap between the skills of users and the demand of their target roles, many users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from demandweave.fixed_values import GAP_PLAN_LIMIT
from demandweave.functions.text import fold_name
from demandweave.plans.read_model import last_day


def leaders(demand: DataFrame, role_totals: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` skills of each role in the last snapshot, with the postings of the role.

    ``role_totals``: role, role_total. ``share`` is 0 for a role without postings.
    """
    last = demand.filter(F.col("snapshot_date") == last_day(demand))
    order = [F.desc("job_count"), F.col("skill"), F.asc_nulls_last("category")]
    rank = F.row_number().over(Window.partitionBy("role").orderBy(*order))
    top = last.select("role", "skill", "category", "job_count", rank.alias("place"))
    top = top.filter(F.col("place") <= top_n).join(role_totals, "role", "left")
    total = F.coalesce("role_total", F.lit(0).cast("long"))
    share = F.when(total > 0, F.col("job_count") / total).otherwise(F.lit(0.0))
    return top.select(
        "role", "skill", "category", "job_count", total.alias("role_total"), share.alias("share"),
        fold_name(F.col("skill")).alias("name"),
    )


def skill_gap(user_skills: DataFrame, top: DataFrame) -> DataFrame:
    """One row per user, role and leading skill of the role, with ``have``.

    ``user_skills``: user_id, role, skill (NULL for a user without skills). ``top``: as from
    ``leaders``; it is at most a few rows per role. Skills that the role does not ask for are
    dropped before anything is grouped, so a user's group holds no more than the leaders.
    """
    wanted = top.select("role", "name", F.col("name").alias("wanted")).dropDuplicates(["role", "name"])
    named = user_skills.select("user_id", "role", fold_name(F.col("skill")).alias("name"))
    users = (
        named.join(wanted, ["role", "name"], "left")
        .groupBy("user_id", "role").agg(F.collect_set("wanted").alias("owned"))
    )
    return users.join(top, "role").select(
        "user_id", "role", "role_total", "skill", "category", "job_count", "share",
        F.array_contains("owned", F.col("name")).alias("have"),
    )


def coverage(user_skills: DataFrame, top: DataFrame) -> DataFrame:
    """Per user and role: how many leading skills are there, and the share of demand they cover.

    The leaders of a role are one list of (name, job_count), a few entries; a user meets it as a whole,
    and the sums are taken over the list. No row is made per user and skill.
    """
    lists = top.groupBy("role").agg(
        F.max("role_total").alias("role_total"), F.collect_list(F.struct("name", "job_count")).alias("leaders"))
    named = user_skills.select("user_id", "role", fold_name(F.col("skill")).alias("name"))
    wanted = top.select("role", "name").distinct().withColumn("wanted", F.col("name"))
    owned = named.join(wanted, ["role", "name"], "left").groupBy("user_id", "role").agg(F.collect_set("wanted").alias("owned"))

    def total(entries: Column) -> Column:
        return F.aggregate(entries, F.lit(0).cast("long"), lambda s, x: s + x["job_count"])

    held = F.filter("leaders", lambda x: F.array_contains("owned", x["name"]))
    weight = total(F.col("leaders"))
    return owned.join(lists, "role").select(
        "user_id", "role", "role_total", F.size(held).cast("long").alias("have"),
        (F.size("leaders") - F.size(held)).cast("long").alias("missing"),
        F.when(weight > 0, total(held) / weight).otherwise(F.lit(0.0)).alias("coverage"))


def plan_list(gap: DataFrame, limit: int = GAP_PLAN_LIMIT) -> DataFrame:
    """The first missing skills of each user by demand, with the share as a percentage text."""
    order = [F.desc("job_count"), F.col("skill"), F.asc_nulls_last("category")]
    place = F.row_number().over(Window.partitionBy("user_id", "role").orderBy(*order))
    missing = gap.filter(~F.col("have")).withColumn("place", place).filter(F.col("place") <= limit)
    percent = F.format_string("%.0f%%", F.bround(F.col("share") * 100, 0))
    return missing.select("user_id", "role", "place", "skill", "job_count", percent.alias("share"))
