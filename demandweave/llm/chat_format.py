"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

Turns stay rows: a conversation is never gathered, so its length does not matter. The common
prefix is the part before the first turn that the two sides do not share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandweave.llm.staging import settle

PROMPT, CHOSEN, REJECTED = "prompt", "chosen", "rejected"


def rendered(role: Column, text: Column) -> Column:
    """One turn as training text; NULLs count as ''."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def first_differences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, turn) of the first turn that is not the same on both sides; pairs that agree are left out.

    Turns are compared by role and text, through 128 bits of hash, so only narrow rows move.
    """
    def keyed(df: DataFrame, side: int) -> DataFrame:
        content = [F.struct("role", "text")]
        return df.select("pair_id", "turn", F.xxhash64(*content).alias("h1"), F.xxhash64(F.lit(1), *content).alias("h2"),
                         F.isnull("text").alias("no_text"), F.isnull("role").alias("no_role"), F.lit(side).alias("side"))

    both = keyed(chosen, 0).unionByName(keyed(rejected, 1))
    met = both.groupBy("pair_id", "turn", "h1", "h2", "no_text", "no_role").agg(F.min("side").alias("a"), F.max("side").alias("b"))
    return met.filter("a = b").groupBy("pair_id").agg(F.min(_place()).alias("split"))


def _place() -> Column:
    """Order of turns: by number, those without one behind all others."""
    return F.struct(F.isnull("turn").alias("last"), F.col("turn").alias("turn"))


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Segments (pair_id, part, turn, role, rendered, loss) of training examples.

    ``chosen``, ``rejected``: pair_id, turn, role, text. part is prompt (turns before the first
    difference, rendered once), chosen or rejected. ``loss`` is true for assistant turns of a
    completion; all else is masked. Sorted by turn, prompt + chosen and prompt + rejected are the
    two examples of a pair.

    * The prefix is compared turn number by turn number; a turn that one side lacks is a difference.
    * Turns without a number (NULL) stand behind all others, as one turn.
    * A turn that stands in several rows is compared as a set and rendered as often as it stands.
    * Sides that agree throughout are a prompt only; a pair that one side lacks has no prompt.
    * NULL text or role differs from '', and is rendered like it. A NULL pair_id is a pair like others.
    * Other columns are ignored.
    """
    split = first_differences(chosen, rejected).withColumnsRenamed({"pair_id": "of"})

    def side(df: DataFrame, part: str) -> DataFrame:
        rows = df.select("pair_id", "turn", "role", "text").join(split, F.col("pair_id").eqNullSafe(F.col("of")), "left")
        behind = F.col("split").isNotNull() & (_place() >= F.col("split"))
        return rows.withColumn("part", F.when(behind, F.lit(part)).otherwise(F.lit(PROMPT)))

    rows = side(chosen, CHOSEN).unionByName(side(rejected, REJECTED).filter(F.col("part") == REJECTED))
    loss = (F.col("part") != PROMPT) & F.coalesce(F.col("role") == "assistant", F.lit(False))
    return rows.select("pair_id", "part", "turn", "role", rendered(F.col("role"), F.col("text")).alias("rendered"), loss.alias("loss"))


def swapped_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from plain conversations (conv_id, turn, role, text): chosen and rejected turns.

    A conversation up to its last reply is chosen; rejected is the same with the last reply of its
    neighbour in that place: the next conversation, by conv_id, that has a reply, and for the last of
    them the first. Conversations without a reply make no pair, nor does one that is alone. Of several
    last replies the largest text counts.
    """
    last = turns.filter("role = 'assistant' and conv_id is not null and turn is not null").groupBy("conv_id").agg(
        F.max(F.struct("turn", "text")).alias("r")).select("conv_id", F.col("r.turn").alias("last"), F.col("r.text").alias("reply"))
    # Ranges of conv_id in order; each knows its own neighbours, and one row a range tells what comes behind it.
    ranges = settle(last.repartitionByRange("conv_id").withColumn("range", F.spark_partition_id()))
    ends = ranges.groupBy("range").agg(F.min(F.struct("conv_id", "reply")).alias("first"), F.max("conv_id").alias("end"))
    in_order = Window.orderBy("range")  # one row a range
    least = F.first("first").over(in_order)
    behind = ends.select("end", F.coalesce(F.lead("first").over(in_order), least).alias("behind"))
    near = Window.partitionBy("range").orderBy("conv_id")
    own = F.struct("conv_id", "reply")
    others = ranges.withColumn("next", F.lead(own).over(near)).join(behind, F.col("conv_id") == F.col("end"), "left")
    pairs = others.withColumn("next", F.coalesce("next", "behind")).filter("next.conv_id <> conv_id").select(
        "conv_id", "last", F.col("next.reply").alias("other"))
    upto = turns.join(pairs.select("conv_id", "last"), "conv_id").filter("turn <= last").select(
        F.col("conv_id").alias("pair_id"), "turn", "role", "text", "last")
    chosen = upto.drop("last")
    instead = pairs.select(F.col("conv_id").alias("pair_id"), F.col("last").alias("turn"), F.lit("assistant").alias("role"), F.col("other").alias("text"))
    return chosen, upto.filter("turn < last").drop("last").unionByName(instead)
