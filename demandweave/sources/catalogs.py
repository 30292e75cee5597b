"""Configuration inputs: board catalog, skill dictionary, role seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandweave.fixed_values import ROLE_PATTERNS, SOURCES
from demandweave.functions.text import OUTER_SPACES, not_empty
from demandweave.schemas import ROLES

_BOARDS = "struct<boards: array<struct<source: string, token: string, company: string>>>"
_SKILLS = "struct<skills: array<struct<name: string, category: string, aliases: array<string>>>>"


def boards_of(documents: DataFrame, text: Column, *scope: str) -> DataFrame:
    """Boards listed in catalog documents; unknown sources and empty tokens are left out."""
    entries = documents.select(*scope, F.explode(F.from_json(text, _BOARDS)["boards"]).alias("b"))
    source = F.lower(F.regexp_replace("b.source", OUTER_SPACES, ""))
    return (
        entries.select(*scope, source.alias("source"), F.col("b.token").alias("board_token"), "b.company")
        .filter(F.col("source").isin(SOURCES) & not_empty(F.col("board_token")).isNotNull())
    )


def read_boards(spark: SparkSession, path: str) -> DataFrame:
    """Board catalog file: {"boards": [{"source", "token", "company"}, ..]}."""
    return boards_of(spark.read.text(path, wholetext=True), F.col("value"))


def dictionary_of(documents: DataFrame, text: Column, *scope: str) -> DataFrame:
    """Skills of dictionary documents; skill_id is the 1-based place in the document."""
    entries = documents.select(*scope, F.posexplode(F.from_json(text, _SKILLS)["skills"]).alias("pos", "s"))
    return entries.select(
        *scope, (F.col("pos") + 1).alias("skill_id"), "s.name",
        F.coalesce("s.category", F.lit("")).alias("category"),
        F.coalesce("s.aliases", F.array().cast("array<string>")).alias("aliases"),
    )


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Skill dictionary file: {"skills": [{"name", "category", "aliases"}, ..]}."""
    return dictionary_of(spark.read.text(path, wholetext=True), F.col("value"))


def read_roles(spark: SparkSession, path: str) -> DataFrame:
    """Role seed: CSV with the header role,pattern."""
    return spark.read.csv(path, header=True, schema=ROLES)


def default_roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROLE_PATTERNS, ROLES)
