from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandweave import schemas
from demandweave.fixed_values import ROLE_PATTERNS
from demandweave.operators.matcher import SkillMatcher, Term
from demandweave.plans import quality, read_model as M, skill_gap
from demandweave.plans.read_model import has_part

T0 = dt.datetime(2026, 6, 20, tzinfo=dt.UTC)
D1, D2 = dt.date(2026, 6, 1), dt.date(2026, 6, 2)


@pytest.fixture(scope="module")
def tables(spark):
    def job(i, company, title, location, remote, day, active=True, source="lever", h=None):
        posted = None if day is None else T0 + dt.timedelta(days=day)
        return (i, source, i, "b", company, title, location, remote, "", "u", posted, h or i, T0, T0, active)

    jobs = spark.createDataFrame([
        job("1", "Acme", "Data Engineer", "Berlin", False, 1), job("2", "Acme", "Data Engineer", "Berlin", False, 1),
        job("3", "Beta_x", "Data Engineer II", None, True, None, source="ashby", h="3"), job("4", "Beta", "Chef", "Rome", True, 3),
        job("5", "Gone", "Data Engineer", "Rome", True, 9, active=False)], schemas.JOBS)
    links = spark.createDataFrame([
        ("1", "SQL", "L"), ("1", "Python", "L"), ("2", "SQL", "L"), ("3", "Python", "L"), ("5", "Old", "L")], schemas.JOB_SKILLS)
    demand = spark.createDataFrame([
        ("Data Engineer", "Python", "L", 30, D2), ("Data Engineer", "SQL", "L", 20, D2), ("Data Engineer", "Go", None, 20, D2),
        ("Data Engineer", "Python", "L", 5, D1), ("Data Engineer", "Old", "L", 50, D1), ("Data Scientist", "R", "L", 1, D1)],
        schemas.SKILL_DEMAND)
    return jobs, links, demand


def test_jobs_page_merges_equal_postings(tables):
    jobs, links, _ = tables
    rows = M.jobs_page(jobs, links).collect()
    assert [(r.company, r.title, r.skills) for r in rows] == [
        ("Beta", "Chef", None), ("Acme", "Data Engineer", "Python, SQL, SQL"), ("Beta_x", "Data Engineer II", "Python")]
    assert [r.company for r in M.jobs_page(jobs, links, limit=1, offset=1).collect()] == ["Acme"]
    for i, row in enumerate(rows):  # from each entry on
        last = {c: row[c] for c in M.DISPLAY}
        assert M.jobs_page(jobs, links, after=last).collect() == rows[i + 1 :]
    assert M.page_offset(0, 1) == (1, 0) and M.page_offset(51, 3) == (3, 50)


def test_filters(tables):
    jobs, links, _ = tables
    count = lambda *conditions, skill=None: M.job_count(jobs, links, *conditions, skill=skill).first().n
    remote = F.col("is_remote")
    assert count() == 4 and count(skill="SQL") == 2 and count(F.col("source") == "ashby") == 1
    assert count(has_part("company", "beta")) == 2 and count(has_part("company", "beta_")) == 1
    assert count(has_part("location", "ER")) == 2 and count(has_part("title", "engineer")) == 3
    assert count(remote) == 2 and count(~remote) == 2 and count(remote, has_part("title", "II"), skill="Python") == 1


def test_find_jobs_and_companies(tables):
    jobs, links, _ = tables
    rows = M.find_jobs(jobs, links, has_part("title", "data")).collect()
    assert [(r.total_matches, r.company) for r in rows] == [(3, "Acme"), (3, "Beta_x")]
    assert M.find_jobs(jobs, links, has_part("title", "none")).collect() == []
    assert M.find_jobs(jobs, links, limit=1).count() == 1 and M.find_jobs(jobs, links, limit=40).count() == 3
    assert [tuple(r) for r in M.companies_hiring(jobs, links).collect()] == [("Acme", 2), ("Beta", 1), ("Beta_x", 1)]
    assert [tuple(r) for r in M.companies_hiring(jobs, links, "Python", 1).collect()] == [("Acme", 1)]


def test_demand_queries(tables):
    jobs, links, demand = tables
    assert [r.skill for r in M.demand(demand, "Data Engineer", 2).collect()] == ["Python", "Go"]
    assert M.demand(demand, "Data Scientist", 5).count() == 0  # not in the last snapshot
    assert [r.role for r in M.roles_latest(demand).collect()] == ["Data Engineer"]
    trend = M.trends(demand.drop("category"), "Data Engineer", 1).collect()
    assert [(r.snapshot_date, r.job_count) for r in trend] == [(D1, 5), (D2, 30)]
    assert [r.skill for r in M.trends(demand, "Data Scientist", 5).collect()] == ["R"]
    assert M.trend_days(demand, "Data Engineer", 1).first().snapshots == 2
    assert M.role_total(jobs, "Data Engineer", ROLE_PATTERNS).first().role_total == 3
    assert M.role_total(jobs, "Nobody", ROLE_PATTERNS).first().role_total == 0
    rows = M.top_skills(demand, jobs, "Data Engineer", ROLE_PATTERNS, 2).collect()
    assert [(r.role_total, r.share_pct) for r in rows] == [(3, 1000.0), (3, 666.7)]


def test_overview(spark, tables):
    jobs, links, _ = tables
    runs = spark.createDataFrame([("r", "m", T0, T0 + dt.timedelta(minutes=5), "ok", 1, 1, 1, 1, 0, None)], schemas.INGESTION_RUNS)
    assert tuple(M.market_overview(jobs, links, runs).first()) == (4, 3, "2026-06-20 00:05")
    assert tuple(M.market_overview(jobs, links, runs.filter("false")).first()) == (4, 3, None)


def test_resolve(spark, tables):
    assert [r.skill for r in M.resolve_skill(tables[1], "L").collect()] == ["Old", "SQL"]
    matcher = SkillMatcher([Term("k8s", 1, "Kubernetes", ""), Term("ml", 2, "Machine Learning", "")], [])
    asked = spark.createDataFrame([("ML on k8s?",), ("none",)], "query string")
    assert [r.matches for r in M.resolve_by_dictionary(asked, matcher).collect()] == [["Kubernetes", "Machine Learning"], []]


def test_skill_gap(spark):
    demand = spark.createDataFrame(
        [("DE", "Python", "L", 80, D1), ("DE", "SQL", "L", 60, D1), ("DE", "Spark", "D", 40, D1), ("DE", "Go", "L", 20, D1), ("Empty", "X", "L", 1, D1)],
        schemas.SKILL_DEMAND)
    totals = spark.createDataFrame([("DE", 100)], "role string, role_total long")
    users = spark.createDataFrame(
        [(1, "DE", " python "), (1, "DE", "SQL"), (1, "DE", "Cobol"), (2, "DE", None), (3, "Empty", "x")], "user_id long, role string, skill string")
    top = skill_gap.leaders(demand, totals, 25)
    gap = skill_gap.skill_gap(users, top)
    one = {r.skill: (r.have, r.share) for r in gap.filter("user_id = 1").collect()}
    assert one == {"Python": (True, 0.8), "SQL": (True, 0.6), "Spark": (False, 0.4), "Go": (False, 0.2)}
    cover = {r.user_id: (r.have, r.missing, r.coverage) for r in skill_gap.coverage(users, top).collect()}
    assert cover == {1: (2, 2, 0.7), 2: (0, 4, 0.0), 3: (1, 0, 1.0)}
    assert gap.filter("user_id = 3").first().share == 0.0  # a role without postings
    text = skill_gap.coverage(users, top)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text  # a user meets the leaders of a role as one list
    plan = sorted(skill_gap.plan_list(gap, 1).collect())
    assert [(r.user_id, r.skill, r.share) for r in plan] == [(1, "Spark", "40%"), (2, "Python", "80%")]


def test_quality(spark, tables):
    jobs, links, _ = tables
    fails = lambda df: {r["column"]: r.failures for r in df.collect()}
    assert fails(quality.not_null(jobs, ["job_id", "posted_at"])) == {"job_id": 0, "posted_at": 1}
    assert fails(quality.unique(links, "skill")) == {"skill": 2}
    assert fails(quality.unique_combination(links, ["job_id", "skill"])) == {"job_id, skill": 0}
    assert fails(quality.accepted_values(jobs, "source", ["lever"])) == {"source": 1}
    assert fails(quality.relationships(links, "job_id", jobs.filter("is_active"), "job_id")) == {"job_id": 1}
    status = lambda days: quality.freshness(jobs, "last_seen_at", T0 + dt.timedelta(days=days)).first().status
    assert [status(d) for d in (3, 4, 14, 15)] == ["pass", "warn", "warn", "error"]
    assert quality.freshness(jobs.filter("false"), "last_seen_at", T0).first().status == "error"


def test_an_entry_with_very_many_links(spark, tables):
    jobs, links, _ = tables
    one = jobs.filter("is_active").limit(1)
    job_id = one.first().job_id
    many = spark.range(150_000).select(F.lit(job_id).alias("job_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("skill"), F.lit("c").alias("category"))
    tally = M.page_tallies(one, many).first().tally
    assert [(t.skill, t.n) for t in tally] == [("s0", 50_000), ("s1", 50_000), ("s2", 50_000)]
    shown = M.jobs_page(one, many).first().skills.split(", ")
    assert len(shown) == 150_000 and shown == sorted(shown)


def test_declared_checks_read_a_model_once(spark, tables):
    """Row checks in one pass; values of all keys in one pass and one exchange."""
    jobs = tables[0]
    facts = jobs.select("job_id", "dedup_hash", F.md5("company").alias("company_key"), F.to_date("first_seen_at").alias("first_seen_date_key"))
    companies = jobs.select(F.md5("company").alias("company_key"), "company").distinct().filter("company <> 'Acme'")
    checked = quality.check_models({"fact_job_posting": facts.unionByName(facts.limit(1)), "dim_company": companies})
    got = {(r.model, r.check, r["column"]): r.failures for r in checked.collect()}
    orphans = facts.join(companies, "company_key", "left_anti").count()
    assert got["fact_job_posting", "unique", "job_id"] == 1 and got["fact_job_posting", "not_null", "job_id"] == 0
    assert got["fact_job_posting", "relationships", "company_key"] in (orphans, orphans + 1) and got["dim_company", "unique", "company"] == 0
    values = quality.key_values(facts, ["job_id", "dedup_hash", "company_key"])
    assert values._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
