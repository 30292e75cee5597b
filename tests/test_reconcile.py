from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from demandweave import schemas
from demandweave.operators import reconcile as R

OLD = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
NOW = dt.datetime(2024, 6, 1, tzinfo=dt.UTC)
FETCHED = (
    "seq long, source string, source_job_id string, board_token string, company string, title string, location string, "
    "is_remote boolean, description string, apply_url string, posted_at timestamp"
)


def posting(seq, source, key, title="Dev", board="b", company="Acme"):
    return (seq, source, key, board, company, title, None, None, None, None, None)


def state(spark, rows):
    """rows: (job_id, source, key, title, active[, board])."""
    full = [
        (r[0], r[1], r[2], r[5] if len(r) > 5 else "b", "Acme", r[3], None, False, "", "", None, "", OLD, OLD, r[4]) for r in rows
    ]
    df = spark.createDataFrame(full, schemas.JOBS)
    return df.withColumn("dedup_hash", R.dedup_hash(F.col("company"), F.col("title"), F.col("location")))


def run(spark, existing, fetched, boards=(("lever", "b"), ("ashby", "b"), ("greenhouse", "b")), chunk=2):
    ok = spark.createDataFrame(list(boards) or [], "source string, board_token string")
    out = R.reconcile(existing, spark.createDataFrame(fetched, FETCHED), ok, NOW, chunk)
    return {(r.source, r.source_job_id): r for r in out.collect()}


def test_insert_refresh_and_reactivate(spark):
    old = state(spark, [("j1", "lever", "1", "Dev", True), ("j2", "lever", "2", "Ops", False)])
    got = run(spark, old, [posting(1, "lever", "1", "Dev II"), posting(2, "lever", "2", "Ops"), posting(3, "lever", "3", "QA")])
    assert {k[1]: r.action for k, r in got.items()} == {"1": "update", "2": "update", "3": "insert"}
    one, two, three = (got[("lever", k)] for k in "123")
    assert (one.job_id, one.title, one.is_active) == ("j1", "Dev II", True)
    assert one.first_seen_at.replace(tzinfo=dt.UTC) == OLD and one.last_seen_at.replace(tzinfo=dt.UTC) == NOW
    assert two.is_active and two.job_id == "j2"
    assert three.is_active and three.description == "" and three.apply_url == "" and three.is_remote is False
    assert three.first_seen_at == three.last_seen_at


def test_cross_source_duplicate_is_skipped_and_same_source_kept(spark):
    got = run(spark, state(spark, []), [posting(1, "lever", "1"), posting(2, "ashby", "9"), posting(3, "lever", "2")])
    assert {k: r.action for k, r in got.items()} == {
        ("lever", "1"): "insert", ("ashby", "9"): "skip", ("lever", "2"): "insert"}


def test_repeats_within_a_run_count_once(spark):
    got = run(spark, state(spark, []), [posting(5, "lever", "1", "Second"), posting(1, "lever", "1", "First")])
    assert [r.title for r in got.values()] == ["First"]


def test_lifecycle(spark):
    old = state(spark, [("j1", "lever", "1", "A", True), ("j2", "ashby", "2", "B", True, "other"), ("j3", "lever", "3", "C", False)])
    gone = run(spark, old, [], boards=[("lever", "b")])
    assert {r.job_id: (r.action, r.is_active) for r in gone.values()} == {
        "j1": ("deactivate", False), "j2": ("keep", True), "j3": ("keep", False)}
    assert gone[("lever", "1")].last_seen_at.replace(tzinfo=dt.UTC) == OLD
    failed = run(spark, old, [], boards=[])
    assert {r.action for r in failed.values()} == {"keep"}


def test_a_skipped_known_key_is_not_deactivated(spark):
    old = state(spark, [("j1", "lever", "1", "Dev", True), ("j2", "ashby", "2", "Dev", False)])
    got = run(spark, old, [posting(1, "lever", "1"), posting(2, "ashby", "2")])
    assert {r.job_id: r.action for r in got.values()} == {"j1": "update", "j2": "update"}


def plain_loop(existing, arrivals):
    """Decision per arrival, one after the other, with a table of owners."""
    owner = {}
    for job_id, source, _, h, active in sorted(existing):
        if active:
            owner.setdefault(h, source)
    known = {(e[1], e[2]) for e in existing}
    decisions, seen = {}, set()
    for seq, source, key, h in sorted(arrivals):
        if (source, key) in seen:
            continue
        seen.add((source, key))
        if (source, key) in known:
            decisions[(source, key)] = "update"
        elif owner.get(h, source) != source:
            decisions[(source, key)] = "skip"
            continue
        else:
            decisions[(source, key)] = "insert"
        owner[h] = source
    return decisions


@pytest.mark.parametrize("chunk", [1, 3, 17, 10**6])
def test_decisions_against_a_plain_loop(spark, chunk):
    rng = random.Random(chunk)
    old_rows, new_rows, want = [], [], {}
    for trial in range(150):
        sources = ["lever", "ashby", "greenhouse", "arbeitnow"][: rng.randint(2, 4)]
        hashes = [f"{trial}-{i}" for i in range(rng.randint(1, 3))]
        keys = list({(rng.choice(sources), f"{trial}-{rng.randint(0, 9)}") for _ in range(8)})
        existing = [(f"j{trial}-{i}", *k, rng.choice(hashes), rng.random() < 0.7) for i, k in enumerate(keys[: rng.randint(0, len(keys))])]
        arrivals = [(trial * 100 + rng.randint(0, 40) * 2 + i * 0, *rng.choice(keys), rng.choice(hashes)) for i in range(rng.randint(1, 14))]
        arrivals = list({a[0]: a for a in arrivals}.values())
        old_rows += existing
        new_rows += arrivals
        want |= plain_loop(existing, arrivals)
    old = spark.createDataFrame(old_rows, "job_id string, source string, source_job_id string, dedup_hash string, is_active boolean")
    new = spark.createDataFrame(new_rows, "seq long, source string, source_job_id string, dedup_hash string")
    got = {(r.source, r.source_job_id): r.decision for r in R.decide(R.run_dedup(new), old, chunk).collect()}
    assert got == want and len(set(want.values())) == 3


def test_one_hash_with_most_arrivals_is_split(spark):
    """All arrivals share a hash: no task of the owner windows gets more than its chunk."""
    n, chunk = 20_000, 1_000
    new = spark.range(n).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "lever").otherwise("ashby").alias("source"),
        F.col("id").cast("string").alias("source_job_id"), F.lit("H").alias("dedup_hash"))
    none = spark.createDataFrame([], "job_id string, source string, source_job_id string, dedup_hash string, is_active boolean")
    counts = {r.decision: r.n for r in R.decide(new, none, chunk).groupBy("decision").agg(F.count("*").alias("n")).collect()}
    assert counts == {"insert": n // 2, "skip": n // 2}
