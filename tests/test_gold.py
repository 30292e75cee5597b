from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandweave import schemas
from demandweave.fixed_values import ROLE_PATTERNS
from demandweave.operators.roles import posting_roles
from demandweave.plans import gold
from demandweave.sources.catalogs import default_roles

T0 = dt.datetime(2026, 6, 20, 12, tzinfo=dt.UTC)
DAY = dt.date(2026, 6, 22)


def jobs(spark, rows):
    """rows: (job_id, source, company, title, hash, active)."""
    full = [(i, s, i, "b", c, t, None, False, "", "u", T0, h, T0, T0, a) for i, s, c, t, h, a in rows]
    return spark.createDataFrame(full, schemas.JOBS)


@pytest.fixture(scope="module")
def silver(spark):
    """Near-duplicates with other skills, an inactive posting, rows not in job_id order."""
    j = jobs(spark, [
        ("d-2", "lever", "Acme", "Senior Data Engineer", "H1", True), ("d-1", "greenhouse", "Acme", "Senior Data Engineer", "H1", True),
        ("d-3", "greenhouse", "Acme", "DATA ENGINEER", "H2", True), ("b-1", "greenhouse", "Globex", "Backend Engineer", "H3", True),
        ("b-2", "lever", "Globex", "Backend Engineer", "H3", True), ("f-1", "greenhouse", "Initech", "Frontend Engineer", "H4", True),
        ("x-1", "greenhouse", "Acme", "Data Engineer", "H5", False)])
    links = spark.createDataFrame([
        ("d-1", "Python", "Language"), ("d-1", "Airflow", "Data"), ("d-2", "Python", "Language"), ("d-2", "Spark", "Data"),
        ("d-3", "Python", "Language"), ("b-1", "Go", "Language"), ("b-2", "Go", "Language"), ("f-1", "React", None),
        ("f-1", "React", "Frontend"), ("f-1", "React", "Zeta"), ("x-1", "Python", "Language")], schemas.JOB_SKILLS)
    return j, links


def test_demand_counts_one_posting_per_hash(spark, silver):
    rows = gold.skill_demand(*silver, ROLE_PATTERNS, DAY).collect()
    assert {(r.role, r.skill, r.category, r.job_count) for r in rows} == {
        ("Data Engineer", "Python", "Language", 2), ("Data Engineer", "Airflow", "Data", 1),
        ("Backend Engineer", "Go", "Language", 1), ("Frontend Engineer", "React", "Frontend", 1)}
    assert {r.snapshot_date for r in rows} == {DAY} and rows[0].job_count.__class__ is int


def test_titles_are_not_shuffled_for_a_list_of_patterns(spark, silver, capsys):
    """Each posting has its roles before one of each hash is chosen."""
    gold.skill_demand(*silver, ROLE_PATTERNS, DAY).explain("formatted")
    plan = capsys.readouterr().out
    exchanges = [block for block in plan.split("\n\n") if "Exchange" in block.splitlines()[0]]
    assert exchanges and not any("title" in block for block in exchanges)


def test_demand_equals_the_star_schema(spark, silver):
    j, links = silver
    facts = gold.fact_job_posting(j)
    bridge = gold.fact_job_skill(facts, gold.stg_job_skills(links))
    counted = posting_roles(facts, ROLE_PATTERNS).join(bridge, "job_id").groupBy("role", "skill", "category").agg(
        F.countDistinct("job_id").alias("n"))
    want = {(r.role, r.skill, r.category, r.n) for r in counted.collect()}
    got = {(r.role, r.skill, r.category, r.job_count) for r in gold.skill_demand(j, links, ROLE_PATTERNS, DAY).collect()}
    assert got == want


def test_role_table_and_pattern_list_agree(spark, silver):
    facts = gold.fact_job_posting(silver[0])
    as_list = sorted(map(tuple, posting_roles(facts, ROLE_PATTERNS).collect()))
    as_table = sorted(map(tuple, posting_roles(facts, default_roles(spark)).collect()))
    assert as_list == as_table and ("d-3", "Data Engineer") in as_list


def test_large_role_table(spark):
    """More patterns than an expression could hold; short ones, repeats, NULLs and an empty one."""
    seed = [(f"r{i % 50}", f"{i:x}") for i in range(900)] + [("one", "7"), ("one", "7"), (None, "a"), ("none", None), ("all", "")]
    titles = [(f"j{i}", f"title {i * 37:x}") for i in range(200)] + [("j0", "title 0"), ("n", None), ("e", "")]
    df = posting_roles(spark.createDataFrame(titles, "job_id string, title_lower string"), spark.createDataFrame(seed, "role string, pattern string"))
    want = {(j, r) for j, t in titles for r, p in seed if None not in (t, r, p) and p in t}
    got = df.collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = df.select("role").distinct()._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_a_title_meets_only_patterns_it_contains(spark):
    """However many patterns begin alike: the join yields the hits, not all patterns with the first characters."""
    seed = spark.range(3_000).selectExpr("'r' || id % 7 as role", "'abc' || id as pattern").union(spark.createDataFrame([("z", "é😀x"), ("z", "abc")], "role string, pattern string"))
    titles = spark.createDataFrame([("a", "xabc2999"), ("b", "abcd"), ("c", "éé😀xabc17 abc17"), ("c", "abc8"), ("d", "ab")], "job_id string, title_lower string")
    df = posting_roles(titles, seed)
    rows = [tuple(r) for r in df.collect()]
    want = {(t.job_id, s.role) for t in titles.collect() for s in seed.collect() if s.pattern in t.title_lower}
    assert len(rows) == len(set(rows)) and set(rows) == want
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Contains(" not in text and "contains(" not in text


def test_dimensions(spark, silver):
    j, links = silver
    companies = {r.company: (r.active_postings, r.source_count) for r in gold.dim_company(j).collect()}
    assert companies == {"Acme": (2, 2), "Globex": (1, 2), "Initech": (1, 1)}
    skills = {r.skill: (r.category, r.active_postings) for r in gold.dim_skill(j, gold.stg_job_skills(links)).collect()}
    assert skills["Python"] == ("Language", 3) and skills["React"] == ("Frontend", 1) and "Spark" in skills
    assert gold.dim_role(default_roles(spark)).count() == 8


def test_dates(spark, silver):
    days = sorted(gold.dim_date(silver[0], dt.datetime(2026, 6, 22, 1, tzinfo=dt.UTC)).collect())
    assert [str(d.date_key) for d in days] == [f"2026-06-{n}" for n in range(20, 25)]
    assert [(d.iso_day_of_week, d.is_weekend) for d in days] == [(6, True), (7, True), (1, False), (2, False), (3, False)]
    assert days[0].year_month == "2026-06"
    assert gold.dim_date(silver[0].filter("false"), T0).count() == 0


def test_trends_follow_demand(spark, silver):
    demand = gold.skill_demand(*silver, ROLE_PATTERNS, DAY)
    assert gold.skill_trends(demand).columns == ["role", "skill", "snapshot_date", "job_count"]
