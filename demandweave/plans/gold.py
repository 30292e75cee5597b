"""Star schema and demand marts over the Silver tables.

Each model is a function from DataFrames to a DataFrame; nothing is materialised here.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandweave.functions.text import surrogate_key
from demandweave.operators.dedup import representatives
from demandweave.operators.roles import RolePatterns, posting_roles, roles_of

DATE_BUFFER_DAYS = 2


def stg_jobs(jobs: DataFrame) -> DataFrame:
    """Postings without the long description, with a lower-cased title."""
    return jobs.select(
        "job_id", "source", "source_job_id", "board_token", "company", "title",
        F.lower("title").alias("title_lower"), "location", "is_remote", "apply_url", "posted_at",
        "dedup_hash", "first_seen_at", "last_seen_at", "is_active",
    )


def stg_job_skills(job_skills: DataFrame) -> DataFrame:
    """Distinct (job_id, skill) with the smallest category; NULL only if there is no other."""
    return job_skills.groupBy("job_id", "skill").agg(F.min("category").alias("category"))


def fact_job_posting(jobs: DataFrame) -> DataFrame:
    """One row per content hash of the active postings."""
    kept = representatives(stg_jobs(jobs).filter("is_active"))
    return kept.select(
        "job_id", "dedup_hash",
        surrogate_key(F.col("company")).alias("company_key"),
        F.to_date(F.coalesce("posted_at", "first_seen_at")).alias("posted_date_key"),
        F.to_date("first_seen_at").alias("first_seen_date_key"),
        "source", "board_token", "company", "title", "title_lower", "location", "is_remote",
        "apply_url", "posted_at", "first_seen_at", "last_seen_at",
        F.lit(1).alias("posting_count"),
    )


def fact_job_skill(postings: DataFrame, skills: DataFrame) -> DataFrame:
    """One row per deduplicated posting and skill. ``skills`` as from ``stg_job_skills``."""
    joined = postings.select("job_id", "dedup_hash", "company_key", "posted_date_key").join(skills, "job_id")
    return joined.select(
        surrogate_key(F.col("job_id"), F.col("skill")).alias("job_skill_key"),
        "job_id", "dedup_hash",
        surrogate_key(F.col("skill")).alias("skill_key"),
        "skill", "category", "company_key", "posted_date_key",
    )


def dim_company(jobs: DataFrame) -> DataFrame:
    """Companies with active postings."""
    grouped = jobs.filter("is_active").groupBy("company").agg(
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.countDistinct("dedup_hash").alias("active_postings"),
        # Four sources at most: a second distinct count would multiply the rows.
        F.size(F.collect_set("source")).cast("long").alias("source_count"),
    )
    return grouped.withColumn("company_key", surrogate_key(F.col("company"))).select(
        "company_key", "company", "first_seen_at", "last_seen_at", "active_postings", "source_count"
    )


def dim_skill(jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """Skills mentioned by active postings. ``skills`` as from ``stg_job_skills``.

    (job_id, skill) is unique there, so distinct postings are plain counts. They are formed
    per skill and category first, which keeps the large step a hash aggregate.
    """
    active = jobs.filter("is_active").select("job_id", "first_seen_at", "last_seen_at")
    by_category = skills.join(active, "job_id").groupBy("skill", "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
    )
    grouped = by_category.groupBy("skill").agg(
        F.min("category").alias("category"),
        F.sum("n").alias("active_postings"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
    )
    return grouped.withColumn("skill_key", surrogate_key(F.col("skill"))).select(
        "skill_key", "skill", "category", "active_postings", "first_seen_at", "last_seen_at"
    )


def dim_role(roles: DataFrame) -> DataFrame:
    return roles.select("role").distinct().select(surrogate_key(F.col("role")).alias("role_key"), "role")


def dim_date(jobs: DataFrame, as_of: dt.datetime | Column) -> DataFrame:
    """Every day from the first date of the postings to the last, or ``as_of``, and two more."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    seen = jobs.agg(
        F.min("first_seen_at").alias("first_seen"), F.max("last_seen_at").alias("last_seen"),
        F.min("posted_at").alias("first_posted"), F.max("posted_at").alias("last_posted"),
    )
    # least and greatest skip NULLs; without any posting there are no days.
    bounds = seen.filter("first_seen is not null").select(
        F.to_date(F.least("first_seen", "first_posted")).alias("start_date"),
        F.date_add(F.to_date(F.greatest("last_seen", "last_posted", now)), DATE_BUFFER_DAYS).alias("end_date"),
    )
    day = F.col("date_key")
    weekday = F.weekday(day) + 1
    return bounds.select(F.explode(F.sequence("start_date", "end_date")).alias("date_key")).select(
        day,
        F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("day"),
        weekday.alias("iso_day_of_week"),
        F.date_format(day, "yyyy-MM").alias("year_month"),
        (weekday >= 6).alias("is_weekend"),
    )


def skill_demand(
    jobs: DataFrame, job_skills: DataFrame, roles: RolePatterns | DataFrame, day: dt.date | Column
) -> DataFrame:
    """Postings per role, skill and category: the headline mart, for one day.

    Postings are deduplicated by content hash and links by (job_id, skill), so counting rows
    counts distinct postings, and the last aggregate moves only one row per group and task.
    """
    active = jobs.filter("is_active").select("job_id", "dedup_hash", F.lower("title").alias("title_lower"))
    if not isinstance(roles, DataFrame):  # applied row by row: the roles are shuffled in place of the titles
        active = active.select("job_id", "dedup_hash", roles_of(F.col("title_lower"), roles).alias("roles"))
    classified = posting_roles(representatives(active), roles)
    counted = classified.join(stg_job_skills(job_skills), "job_id").groupBy("role", "skill", "category").agg(
        F.count(F.lit(1)).cast("long").alias("job_count")
    )
    return counted.withColumn("snapshot_date", day if isinstance(day, Column) else F.lit(day))


def skill_trends(demand: DataFrame) -> DataFrame:
    """Every snapshot's counts per role and skill."""
    return demand.select("role", "skill", "snapshot_date", "job_count")
