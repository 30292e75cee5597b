"""Data checks. Each returns rows (check, column, failures); 0 failures pass."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandweave.fixed_values import (
    CATEGORIES, FRESHNESS_ERROR_DAYS, FRESHNESS_WARN_DAYS, ROLE_PATTERNS, SOURCES,
)

# The checks declared for the models of the star schema.
NOT_NULL = {
    "stg_jobs": ["job_id", "source", "dedup_hash", "is_active"],
    "stg_job_skills": ["job_id", "skill"],
    "dim_date": ["date_key"],
    "dim_company": ["company_key", "company"],
    "dim_skill": ["skill_key", "skill", "category"],
    "dim_role": ["role_key", "role"],
    "fact_job_posting": ["job_id", "dedup_hash", "company_key", "first_seen_date_key"],
    "fact_job_skill": ["job_skill_key", "job_id", "skill_key", "category"],
    "skill_demand": ["role", "skill", "category", "job_count", "snapshot_date"],
    "skill_trends": ["role", "skill", "job_count", "snapshot_date"],
    "seed_roles": ["role", "pattern"],
}
UNIQUE = {
    "stg_jobs": ["job_id"],
    "dim_date": ["date_key"],
    "dim_company": ["company_key", "company"],
    "dim_skill": ["skill_key", "skill"],
    "dim_role": ["role_key", "role"],
    "fact_job_posting": ["job_id", "dedup_hash"],
    "fact_job_skill": ["job_skill_key"],
    "seed_roles": ["pattern"],
}
UNIQUE_COMBINATION = {
    "stg_job_skills": ["job_id", "skill"],
    "skill_demand": ["role", "skill", "category", "snapshot_date"],
    "skill_trends": ["role", "skill", "snapshot_date"],
}
ACCEPTED = {
    "stg_jobs": ("source", SOURCES),
    "dim_skill": ("category", CATEGORIES),
    "dim_role": ("role", sorted({role for role, _ in ROLE_PATTERNS})),
}
RELATIONSHIPS = [
    ("fact_job_posting", "company_key", "dim_company", "company_key"),
    ("fact_job_posting", "first_seen_date_key", "dim_date", "date_key"),
    ("fact_job_posting", "posted_date_key", "dim_date", "date_key"),
    ("fact_job_skill", "job_id", "fact_job_posting", "job_id"),
    ("fact_job_skill", "skill_key", "dim_skill", "skill_key"),
    ("skill_demand", "role", "dim_role", "role"),
]


def _rows(one: DataFrame, check: str, columns: Sequence[str]) -> DataFrame:
    """Turn one row with a count per column into one row per column."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias("failures"))
        for c in columns
    ])
    return one.select(F.explode(pairs).alias("r")).select(F.lit(check).alias("check"), "r.column", "r.failures")


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs per column, in one pass over the table."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return _rows(one, "not_null", columns)


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once; NULL is no value."""
    values = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    one = values.agg(F.count_if(F.col("n") > 1).alias(column))
    return _rows(one, "unique", [column])


def unique_combination(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Combinations that occur more than once; NULL counts as a value."""
    label = ", ".join(columns)
    combos = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    one = combos.agg(F.count_if(F.col("n") > 1).alias(label))
    return one.select(
        F.lit("unique_combination").alias("check"), F.lit(label).alias("column"),
        F.col(f"`{label}`").alias("failures"),
    )


def accepted_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Distinct values outside of the accepted ones; NULL passes."""
    odd = df.filter(~F.col(column).isin(list(values)))
    one = odd.agg(F.countDistinct(column).alias(column))
    return _rows(one, "accepted_values", [column])


def relationships(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Child rows without a parent; a NULL reference passes."""
    references = child.filter(F.col(column).isNotNull()).select(F.col(column).alias("ref"))
    # References are counted per value first, so a hot value is one row in the join.
    counted = references.groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
    orphans = counted.join(parent.select(F.col(field).alias("ref")), "ref", "left_anti")
    return _rows(orphans.agg(F.sum("n").alias(column)), "relationships", [column])


def freshness(
    df: DataFrame, column: str, as_of: dt.datetime | Column,
    warn_days: int = FRESHNESS_WARN_DAYS, error_days: int = FRESHNESS_ERROR_DAYS,
) -> DataFrame:
    """One row: last load, its age in seconds and pass, warn or error. An empty table is an error."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_loaded_at").cast("timestamp"))
    status = (
        F.when(F.col("last_loaded_at").isNull() | (age > error_days * 86_400), F.lit("error"))
        .when(age > warn_days * 86_400, F.lit("warn")).otherwise(F.lit("pass"))
    )
    return df.agg(F.max(column).alias("last_loaded_at")).select(
        "last_loaded_at", age.alias("age_seconds"), status.alias("status")
    )


def _row_checks(df: DataFrame, name: str) -> DataFrame | None:
    """not_null and accepted_values of a model, in one pass over it."""
    columns = NOT_NULL.get(name, [])
    counts = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]
    named = [("not_null", c, f"n{i}") for i, c in enumerate(columns)]
    if name in ACCEPTED:
        column, values = ACCEPTED[name]
        counts.append(F.count_distinct(F.when(~F.col(column).isin(list(values)), F.col(column))).alias("odd"))
        named.append(("accepted_values", column, "odd"))
    return _named(df.agg(*counts), named) if counts else None


def _named(one: DataFrame, named: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row of counts as one row (check, column, failures) for each (check, column, count)."""
    rows = F.array(*[
        F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"), F.coalesce(F.col(n).cast("long"), F.lit(0).cast("long")).alias("failures"))
        for check, column, n in named])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def key_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): how often each value of the columns stands, for all of them in one pass and one
    exchange. Values are compared as text; NULL is no value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).filter("p.value IS NOT NULL").groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))


def check_models(models: dict[str, DataFrame]) -> DataFrame:
    """All declared checks of the models that are given: (model, check, column, failures).

    A model is read once for its row checks and once, for the columns with keys, to count values;
    that count serves uniqueness and the relationships on both their sides.
    """
    keys: dict[str, list[str]] = {name: list(UNIQUE.get(name, [])) for name in models}
    relations = [r for r in RELATIONSHIPS if r[0] in models and r[2] in models]
    for child, column, parent, field in relations:
        for name, c in ((child, column), (parent, field)):
            if c not in keys[name]:
                keys[name].append(c)
    values = {name: key_values(models[name], columns) for name, columns in keys.items() if columns}
    results: list[tuple[str, DataFrame]] = []
    for name, df in models.items():
        if (rows := _row_checks(df, name)) is not None:
            results.append((name, rows))
        if unique_columns := UNIQUE.get(name, []):
            one = values[name].agg(*[
                F.count_if((F.col("column") == c) & (F.col("n") > 1)).alias(f"n{i}") for i, c in enumerate(unique_columns)])
            results.append((name, _named(one, [("unique", c, f"n{i}") for i, c in enumerate(unique_columns)])))
        if name in UNIQUE_COMBINATION:
            results.append((name, unique_combination(df, UNIQUE_COMBINATION[name])))
    for child, column, parent, field in relations:
        references = values[child].filter(F.col("column") == column).select("value", "n")
        there = values[parent].filter(F.col("column") == field).select("value")
        orphans = references.join(there, "value", "left_anti").agg(F.sum("n").alias("n"))
        results.append((child, _named(orphans, [("relationships", column, "n")])))
    rows = [df.select(F.lit(name).alias("model"), "check", "column", "failures") for name, df in results]
    return functools.reduce(DataFrame.unionByName, rows)
