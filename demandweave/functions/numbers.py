"""Rounding as a reader of the printed number expects it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_tenth(value: Column) -> Column:
    """A double >= 0 to one decimal, by its exact binary value, ties to even.

    Spark's ``bround`` rounds the printed digits: it takes 0.35 for a tie, while the double is
    a little less. Here 20 * value is split into a whole part and a rest without any rounding
    error; the rest alone tells which side of a half the value lies on.
    """
    four = value * F.lit(4.0)
    five_rest = (four - F.floor(four).cast("double")) * F.lit(5.0)
    twentieths = F.floor(four) * F.lit(5) + F.floor(five_rest)
    exact = five_rest == F.floor(five_rest).cast("double")
    below = F.floor(twentieths / F.lit(2.0))
    tie_down = exact & (below % 2 == 0)
    tenths = F.when((twentieths % 2 == 0) | tie_down, below).otherwise(below + 1)
    return tenths.cast("double") / F.lit(10.0)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one decimal; 0.0 if there is no whole."""
    return F.when(whole > 0, round_tenth(F.lit(100.0) * part / whole)).otherwise(F.lit(0.0))
