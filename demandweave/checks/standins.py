"""The engine's tables, derived from the given ones. ``oracle.CTES`` says the same in SQL."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandweave.fixed_values import SOURCES
from demandweave.functions.text import dedup_hash
from demandweave.operators.matcher import SkillMatcher, Term
from demandweave.session import shared_folder, spread, stage

AS_OF = dt.datetime(2025, 3, 1, 12, 0, 0, tzinfo=dt.UTC)
DAY = dt.date(2025, 3, 1)
EPOCH = 1_704_067_200  # 2024-01-01

# Several patterns per role and several roles per title.
PART_ROLES = [
    ("Red", "red"), ("Fastener", "bolt"), ("Fastener", "rod"), ("Ring", "ring"), ("Widget", "widget"),
]
DOCUMENT_ROLES = [("Determiner", "the"), ("Determiner", "les"), ("Relation", "of"), ("Relation", "der")]

# Word dictionary for the document texts: id, name, category, terms.
WORDS = [
    (1, "The", "Article", ["the", "le", "der", "el"]),
    (2, "Of", "Relation", ["of", "von"]),
    (3, "Of The", "Relation", ["of the"]),
    (4, "And", "Joint", ["and", "et", "und"]),
    (5, "Is", "Verb", ["is", "est"]),
    (6, "To Be", "Verb", ["to be"]),
    (7, "R", "Letter", ["r"]),
]
WORD_TERMS = [Term(t, i, name, cat) for i, name, cat, terms in WORDS for t in terms]
# Guards that the texts do trip: "the" right before a comma, "is" right after "that".
WORD_GUARDS = [("the", None, ","), ("is", r"\bthat ", None)]


def _source(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (n % 4 + 1).cast("int"))


def _at(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH) + seconds)


class StandIns:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def documents(self) -> DataFrame:
        """The texts, one row group of which may hold them all."""
        return spread(self.table("documents"), "doc_id")

    def stored(self, df: DataFrame) -> DataFrame:
        """As a stored table, like the Silver and Gold tables that the queries read in use."""
        return stage(df, shared_folder(self.spark))

    # --- postings and links ---------------------------------------------------------

    @cached_property
    def jobs(self) -> DataFrame:
        part = self.table("part")
        key, size = F.col("p_partkey"), F.col("p_size")
        posted = _at((key % 400) * 86_400 + (key % 24) * 3_600)
        return part.select(
            key.cast("string").alias("job_id"),
            _source(size).alias("source"),
            F.concat(F.lit("p"), key).alias("source_job_id"),
            F.lower("p_brand").alias("board_token"),
            F.col("p_brand").alias("company"),
            F.col("p_name").alias("title"),
            F.col("p_type").alias("location"),
            (key % 3 == 0).alias("is_remote"),
            F.concat("p_name", F.lit(" "), "p_type").alias("description"),
            F.concat(F.lit("https://jobs.example/"), F.lower("p_brand")).alias("apply_url"),
            F.when(size % 7 != 0, posted).alias("posted_at"),
            dedup_hash(F.col("p_brand"), F.col("p_name"), F.col("p_type")).alias("dedup_hash"),
            _at((key % 90) * 86_400).alias("first_seen_at"),
            _at((key % 90 + size) * 86_400).alias("last_seen_at"),
            (size > 5).alias("is_active"),
        )

    @cached_property
    def _lines(self) -> DataFrame:
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        sellers = self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            "s_suppkey", "n_name", "r_name"
        )
        return self.table("lineitem").join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))

    @cached_property
    def raw_links(self) -> DataFrame:
        """Links with repeats and several categories per pair, some NULL."""
        return self._lines.select(
            F.col("l_partkey").cast("string").alias("job_id"), F.col("n_name").alias("skill"),
            F.when(F.col("l_linenumber") % 3 != 0, F.concat("r_name", "l_returnflag")).alias("category"),
        )

    @cached_property
    def job_skills(self) -> DataFrame:
        return self._lines.select(
            F.col("l_partkey").cast("string").alias("job_id"), F.col("n_name").alias("skill"),
            F.col("r_name").alias("category"),
        ).distinct()

    # --- snapshots and runs ---------------------------------------------------------

    @cached_property
    def demand(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        events = self.table("events").select(
            F.col("event_type").alias("role"), F.concat(F.lit("k"), k).alias("skill"),
            F.when(k % 5 != 0, F.concat(F.lit("c"), k % 5)).alias("category"),
            F.to_date("ts").alias("snapshot_date"),
        )
        return events.groupBy("role", "skill", "category", "snapshot_date").agg(
            F.count(F.lit(1)).cast("long").alias("job_count")
        )

    @cached_property
    def runs(self) -> DataFrame:
        return self.table("events").groupBy(F.to_date("ts").cast("string").alias("run_id")).agg(
            F.min("ts").cast("timestamp").alias("started_at"), F.max("ts").cast("timestamp").alias("finished_at")
        )

    @cached_property
    def daily_boards(self) -> DataFrame:
        return self.boards_by_day(20)

    def boards_by_day(self, errors: int) -> DataFrame:
        """Status of 36 boards per day; a board failed if it had so many error events."""
        board = F.concat(F.lit("b"), F.col("user_id") % 36)
        failed = F.count_if(F.col("event_type") == "error")
        return (
            self.table("events").groupBy(F.to_date("ts").cast("string").alias("run_id"), board.alias("board_token"))
            .agg(failed.alias("n"))
            .select(
                "run_id", F.lit("greenhouse").alias("source"), "board_token", (F.col("n") < errors).alias("ok"),
                F.when(F.col("n") >= errors, F.concat("board_token", F.lit(": "), "n")).alias("error"),
            )
        )

    @cached_property
    def user_skills(self) -> DataFrame:
        """A user's own nation as skill, written carelessly; none for a negative balance."""
        nation = self.table("nation").select("n_nationkey", "n_name")
        role = F.element_at(
            F.array(*[F.lit(r) for r in ("Red", "Fastener", "Ring", "Widget")]),
            (F.col("c_custkey") % 4 + 1).cast("int"),
        )
        skill = F.concat(F.lit(" "), F.lower("n_name"), F.lit("\t"))
        return self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("user_id"), role.alias("role"),
            F.when(F.col("c_acctbal") >= 0, skill).alias("skill"),
        )

    # --- texts ----------------------------------------------------------------------

    @cached_property
    def texts(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").cast("string").alias("job_id"), F.substring("text", 1, 60).alias("title"),
            F.col("text").alias("description"),
        )

    @property
    def words(self) -> SkillMatcher:
        return SkillMatcher(WORD_TERMS, [])

    @property
    def guarded_words(self) -> SkillMatcher:
        return SkillMatcher(WORD_TERMS, WORD_GUARDS)

    # --- reconciliation -------------------------------------------------------------

    def _documents_as_jobs(self) -> DataFrame:
        number = F.substring("source", 4, 3).cast("int")
        return self.documents.select(
            F.col("doc_id").alias("seq"), _source(number).alias("source"),
            F.col("doc_id").cast("string").alias("source_job_id"),
            F.col("lang").alias("board_token"), F.col("lang").alias("company"), F.col("text").alias("title"),
            F.lit(None).cast("string").alias("location"), (F.col("doc_id") % 2 == 0).alias("is_remote"),
            F.col("text").alias("description"),
            F.lit(None).cast("string").alias("apply_url"), _at(F.col("doc_id")).alias("posted_at"), F.col("source").alias("origin"),
        )

    @cached_property
    def existing(self) -> DataFrame:
        """Two sources are not on record yet; some documents of the others are no longer active."""
        old = self._documents_as_jobs().filter("origin not in ('src3', 'src7')")
        return old.select(
            F.concat(F.lit("j"), "seq").alias("job_id"), "source", "source_job_id", "board_token", "company",
            "title", "location", "is_remote", "description", F.lit("").alias("apply_url"), "posted_at",
            dedup_hash(F.col("company"), F.col("title"), F.col("location")).alias("dedup_hash"),
            _at(F.lit(0)).alias("first_seen_at"), _at(F.lit(86_400)).alias("last_seen_at"),
            (F.col("seq") % 11 != 0).alias("is_active"),
        )

    @cached_property
    def fetched(self) -> DataFrame:
        """Two sources are no longer listed, some titles have changed; one language arrives twice."""
        title = F.when(F.col("seq") % 7 == 0, F.concat("title", F.lit(" ii"))).otherwise(F.col("title"))
        new = self._documents_as_jobs().filter("origin not in ('src5', 'src11')").drop("origin").withColumn("title", title)
        again = new.filter("board_token = 'es'").withColumn("seq", F.col("seq") + 1_000_000_000).withColumn(
            "title", F.lit("again")
        )
        return new.unionByName(again)

    @cached_property
    def succeeded_boards(self) -> DataFrame:
        boards = self._documents_as_jobs().select("source", "board_token").distinct()
        return boards.filter("not (source = 'lever' and board_token = 'fr')")
