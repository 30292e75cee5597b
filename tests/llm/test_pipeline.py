from __future__ import annotations

import re

import corpus_pipeline
from demandweave.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = corpus_pipeline.settle(stage(spark, docs, FOLDER))
        kept[name] = (before, docs.count())
        if name != "best_fit_packing":
            assert docs.columns == columns
            assert docs.filter("n_chars <> length(text)").isEmpty()
    assert kept["quality_rules"][1] < kept["quality_rules"][0]
    assert kept["line_dedup"][1] == kept["line_dedup"][0]
    assert kept["near_duplicates"][1] < kept["near_duplicates"][0]
    assert kept["decontamination"][1] <= kept["decontamination"][0]
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(rows) == sorted(docs.collect()) and len({r.doc_id for r in rows}) == kept["best_fit_packing"][0]


def test_clean_documents_stay(spark):
    """What no rule speaks against comes out whole."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = docs.join(spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1"), "doc_id").select(docs.columns)
    judged = corpus_pipeline.quality(spark, good, FOLDER)
    lost = good.join(judged, "doc_id", "left_anti").collect()
    assert len(lost) < 0.1 * good.count() and all(len(r.text.split()) < 10 or re.search(r"(\S+ \S+ \S+ \S+ \S+)[\s\S]*\1", r.text) for r in lost)


def test_one_query_for_each_operator():
    numbers = [int(name[2:].split("_")[0]) for name in queries()]
    assert numbers == list(range(1, 14))
