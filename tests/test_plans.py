"""Plans that have to hold at scale: what is pushed down, what is shuffled, what is not joined."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from demandweave.checks.standins import DAY, PART_ROLES, StandIns
from demandweave.operators import reconcile
from demandweave.operators.matcher import replace_links
from demandweave.plans import gold, read_model, run
from demandweave.plans.read_model import has_part
from demandweave.session import scratch
from demandweave.sources.warehouse import Warehouse


def plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def _exchanges_above(text: str, table: str) -> int:
    """Exchanges between the scan of a stored table and the result."""
    lines = text.splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and table in line)
    depth, found = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789")), 0
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if own < depth:
            depth, found = own, found + ("Exchange" in line)
    return found


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Silver and Gold as stored tables."""
    s = StandIns(spark, "/root/testdata/sf0.001")
    warehouse = Warehouse(spark, str(tmp_path_factory.mktemp("wh")))
    warehouse.replace("jobs", s.jobs)
    warehouse.replace("job_skills", s.job_skills)
    s.demand.write.partitionBy("snapshot_date").parquet(f"{warehouse.root}/skill_demand")
    return warehouse


@pytest.fixture(autouse=True)
def large_tables(spark):
    """Plan as if no table were small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_active_filter_and_columns_reach_the_scan(stored):
    text = plan(read_model.active_jobs(stored.read("jobs")))
    assert "PushedFilters: [IsNotNull(is_active), EqualTo(is_active,true)]" in text
    assert "ReadSchema: struct<job_id:string,title:string,dedup_hash:string,is_active:boolean>" in text


def test_demand_does_not_read_descriptions_and_shuffles_little(stored):
    text = plan(gold.skill_demand(stored.read("jobs"), stored.read("job_skills"), PART_ROLES, DAY))
    assert "description" not in text and "NestedLoop" not in text and "Cartesian" not in text
    assert text.count("WindowGroupLimit") == 2  # before and after the shuffle on the hash
    assert text.count("partial_count(1)") == 1  # counted before the last shuffle
    assert text.count("Exchange") == 3 and _exchanges_above(text, "job_skills") == 1  # the last one, of counts


def test_one_row_per_key_drops_rows_before_the_shuffle(stored):
    jobs = stored.read("jobs").withColumn("seq", F.monotonically_increasing_id())
    text = plan(reconcile.run_dedup(jobs))
    assert text.count("WindowGroupLimit") == 1 and "Exchange" not in text  # cut by that key already
    plain = StandIns(stored.spark, "/root/testdata/sf0.001").fetched
    assert plan(reconcile.run_dedup(plain)).count("WindowGroupLimit") == 2


def test_jobs_are_reconciled_where_they_are_stored(stored):
    """Neither the jobs nor the stored postings are exchanged, and only touched slots are read."""
    fetched = StandIns(stored.spark, "/root/testdata/sf0.001").fetched
    boards = fetched.select("source", "board_token").distinct()
    with scratch(stored.spark) as keep:
        postings = keep(fetched, "postings", reconcile.KEY, stored.slots)
        planned = reconcile.plan_actions(stored.read("jobs"), postings, boards)
        assert "description" not in plan(planned)
        actions = keep(planned, "actions", reconcile.KEY, stored.slots)
        text = plan(reconcile.apply_actions(stored.read("jobs", [3, 5]), postings, actions, DAY))
        assert "description" in text and "Exchange" not in text and "PartitionFilters: [slot" in text


def test_links_are_replaced_where_they_are_stored(stored):
    with scratch(stored.spark) as keep:
        ids = keep(stored.read("jobs").select("job_id"), "ids", ["job_id"], stored.slots)
        fresh = keep(ids.select("job_id", F.lit("x").alias("skill"), F.lit("y").alias("category")), "fresh", ["job_id"], stored.slots)
        text = plan(replace_links(stored.read("job_skills", [1, 2]), ids, fresh))
        assert "Exchange" not in text and "PartitionFilters: [slot" in text


def test_last_snapshot_prunes_partitions(stored):
    text = plan(read_model.demand(stored.read("skill_demand"), "click", 5))
    assert "PartitionFilters: [isnotnull(snapshot_date" in text and "TakeOrderedAndProject" in text


def test_owner_windows_are_cut_by_chunk(stored):
    s = StandIns(stored.spark, "/root/testdata/sf0.001")
    text = plan(reconcile.decide(reconcile.with_hash(reconcile.run_dedup(s.fetched)), s.existing, 10))
    windows = [line for line in text.splitlines() if "Window [" in line]
    by_hash_alone = [w for w in windows if "[dedup_hash" in w and "chunk" not in w.split("windowspecdefinition(")[1].split("ASC")[0]]
    assert by_hash_alone == [] and "Cartesian" not in text


def test_job_list_joins_links_by_key_only(stored):
    text = plan(read_model.jobs_page(stored.read("jobs"), stored.read("job_skills"), has_part("title", "ring")))
    assert "NestedLoop" not in text and "Cartesian" not in text and "TakeOrderedAndProject" in text


def test_postings_are_hashed_once(stored):
    """No title is hashed or exchanged for the plan of a run; stored postings keep their hash in every step."""
    fetched = StandIns(stored.spark, "/root/testdata/sf0.001").fetched
    boards = fetched.select("source", "board_token").distinct()
    with_texts = [line for line in plan(reconcile.plan_actions(stored.read("jobs"), fetched, boards)).splitlines() if "Exchange" in line and "title" in line]
    assert with_texts == []
    with scratch(stored.spark) as keep:
        postings = keep(reconcile.with_hash(fetched), "postings", reconcile.KEY, stored.slots)
        planned = reconcile.plan_actions(stored.read("jobs"), postings, boards)
        actions = keep(planned, "actions", reconcile.KEY, stored.slots)
        applied = reconcile.apply_actions(stored.read("jobs"), postings, actions, DAY)
        assert "upper(sha2" not in plan(planned) + plan(applied) and "title" not in plan(planned)
    assert "regexp_replace" not in plan(run.blank_keys(fetched)).split("Filter")[-1]
