"""A training corpus from raw documents: rules, line dedup, near dedup, decontamination, packing.

Each stage reads what the one before has written and returns the columns of documents; the last
returns the pieces of documents and the bins they are packed in. An empty table stays empty in each.
Columns may have any name; those of documents stay as they are, but for text and n_chars after line
dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandweave.llm import decontamination, line_dedup, order_minhash, packing, quality_rules
from demandweave.llm.staging import settle


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all rules. NULL and empty texts have no words and go; repeated rows are judged alike."""
    return _columns(quality_rules.judge(docs).filter("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that another document keeps; n_chars follows the text.

    Of documents with a common line the one with the largest doc_id keeps it (rows of that doc_id all
    do; NULL comes before all others). A document that loses all its lines stays, with an empty text.
    """
    kept = line_dedup.dedup_lines(docs).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("long"))
    return _columns(kept, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the row with the smallest doc_id (NULL last), and of
    several texts under it the one with the smallest hash; of rows that repeat it any one. Empty texts
    are one class."""
    return order_minhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. NULL and empty texts and items hold and match nothing;
    repeated rows are judged alike."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _columns(decontamination.with_leaks(docs, items).filter(F.size("leaks") == 0), docs)


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins of 2048 words. Texts without words have a row without a bin; repeated
    rows are packed each, apart from one another; a NULL source conflicts with none."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_copies),
    ("decontamination", benchmark_leaks), ("best_fit_packing", bins),
]

# Near-duplicates and packing can't be stated in SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
