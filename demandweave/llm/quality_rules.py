"""Quality rules: a table of thresholds, compiled into one Spark projection over the text.

Measures are counts of a text; a rule bounds the ratio of two of them. Nothing but Spark's own
functions takes part, and no rows are exchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandweave.llm.staging import free_names

SHINGLE = 5


class Rule(NamedTuple):
    """``least <= 100 * part / whole <= most``; None: no bound. A text without ``whole`` passes.

    ``alone``: breaking this rule is enough to reject a text; else it is only reported, as with words
    that short texts and other languages may lack.
    """

    name: str
    part: str
    whole: str
    least: int | None
    most: int | None
    alone: bool = True


# Percentages.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("exclamations", "n_exclamations", "n_words", None, 30),
    Rule("capitals", "n_capitals", "word_chars", None, 40),
    Rule("stop_words", "n_stop_words", "n_words", 5, None, alone=False),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
)

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it was on with as be by this are at or an from have not "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine im dem es auch an als "
    "le la les de des du et est en un une que qui dans pour pas sur au avec par ce il "
    "el los las y es una por con para del se no su lo como más al"
).split()

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _how_many(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once. A column that a lambda refers to may otherwise
    be put in its place by the optimizer, and then be worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(places: Column, width: int) -> Column:
    """How many words the windows of ``width`` words that start at ``places`` (sorted) cover."""
    steps = F.transform(places, lambda p, i: F.when(i == 0, width).otherwise(F.least(F.lit(width), p - F.get(places, i - 1))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)


def _repeat_words(words: Column) -> Column:
    """Words in windows of SHINGLE words that the text has twice or more. Windows are compared by
    a 64-bit hash, within one text only."""
    windows = F.when(F.size(words) >= SHINGLE, F.transform(
        F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)])))

    def twice(order: Column) -> Column:
        def place(x: Column, i: Column) -> Column:
            near = [F.coalesce(F.get(order, j).getField("h") == x.getField("h"), F.lit(False)) for j in (i - 1, i + 1)]
            return F.when(near[0] | near[1], x.getField("i"))

        return F.sort_array(F.array_compact(F.transform(order, place)))

    def repeated(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        some = let(let(order, twice), lambda places: _covered(places, SHINGLE))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), some).otherwise(F.lit(0).cast("long"))

    return F.coalesce(let(windows, repeated), F.lit(0).cast("long"))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that rules refer to: n_words, word_chars, n_symbols, n_exclamations, n_capitals,
    n_stop_words, n_lines (with a word), n_dup_lines, n_repeat_words. Columns of these names are replaced.
    """
    stop = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    of_words = let(F.array_remove(F.split(content, f"[{_SPACE}]+"), ""), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), F.size(F.filter(w, lambda x: x.isin(stop))).cast("long").alias("stop"),
        _repeat_words(w).alias("again")))
    of_lines = let(F.filter(F.split(content, "\n", -1), lambda x: F.length(F.translate(x, _SPACE, "")) > 0), lambda x: F.struct(
        F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in COUNTS]
    words, lines = free_names([*docs.columns, *COUNTS], "words", "lines")
    counted = docs.select(
        *own, F.length(F.translate(content, _SPACE, "")).cast("long").alias("word_chars"),
        _how_many(content, _SYMBOLS).cast("long").alias("n_symbols"), _how_many(content, "!").cast("long").alias("n_exclamations"),
        _how_many(content, _CAPITALS).cast("long").alias("n_capitals"), of_words.alias(words), of_lines.alias(lines))
    return counted.select(
        *own, F.col(f"{words}.n").alias("n_words"), "word_chars", "n_symbols", "n_exclamations", "n_capitals",
        F.col(f"{words}.stop").alias("n_stop_words"), F.col(f"{lines}.n").alias("n_lines"),
        F.col(f"{lines}.dup").alias("n_dup_lines"), F.col(f"{words}.again").alias("n_repeat_words"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_exclamations", "n_capitals", "n_stop_words", "n_lines",
          "n_dup_lines", "n_repeat_words")


def broken(rule: Rule) -> Column:
    part, whole = F.col(rule.part) * 100, F.col(rule.whole)
    out = F.lit(False)
    if rule.least is not None:
        out = out | (part < whole * rule.least)
    if rule.most is not None:
        out = out | (part > whole * rule.most)
    return out & (whole > 0)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Add the counts of ``measures`` and: base_failed, broken_rules (names in the order of the
    table, comma-joined), kept (base passed, and no rule broken that rejects alone).

    * ``base_failed``: fewer than ten words, or more than 20 % of the words repeated.
    * NULL and '' have no words, so they fail. Lengths count code points.
    * One row per row of ``docs``; its other columns stay, but for those named like a result.
    """
    counted = measures(docs.drop("base_failed", "broken_rules", "kept"), text)
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    names = [F.when(broken(r), F.lit(r.name)) for r in rules]
    judged = counted.withColumn("base_failed", base).withColumn("broken_rules", F.concat_ws(",", *names) if names else F.lit(""))
    rejected = reduce(or_, [broken(r) for r in rules if r.alone], F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~rejected)
