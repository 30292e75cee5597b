"""Interaction of filters: what each removes alone, in each order, and as its Shapley share.

A document fails a set of filters, so a part of the corpus is no more than 32 counts. The removals
of all 32 coalitions of filters follow from them. Step counts of any order are differences of two
coalitions. The Shapley shares are the exact solution of a least-squares problem: weighted by the
Shapley kernel, the shares of a coalition's members come as near as can be to its removals, under
the condition that all shares add up to what all filters remove. The normal equations are solved in
rational numbers, once, for every right-hand side; what is left per part is a sum of 32 products.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandweave.llm.quality_rules import let
from demandweave.llm.staging import settle

COPY = "E"
_SPACE = " \t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D on a text that is not NULL."""
    words = F.array_remove(F.split(text, f"[{_SPACE}]+"), "")
    counts = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("different")))
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return {
        "A": counts["n"] < 50,
        "B": counts["different"] * 100 < counts["n"] * 65,
        "C": capitals * 100 > F.length(text) * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """Gauss-Jordan in rationals: the columns x with matrix * x = right."""
    n = len(matrix)
    rows = [list(map(Fraction, a + b)) for a, b in zip(matrix, right)]
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                factor = rows[r][i]
                rows[r] = [x - factor * y for x, y in zip(rows[r], rows[i])]
    return [row[n:] for row in rows]


def shapley_matrix(players: int) -> list[list[Fraction]]:
    """(players, 2 ** players): times the values of all coalitions (by bits; the empty one 0), the Shapley values.

    Minimise sum over coalitions S, neither empty nor all, of k(S) * (v(S) - sum of shares in S) ** 2 with
    k(S) = (n - 1) / (binomial(n, |S|) * |S| * (n - |S|)), where the shares add up to v(all).
    """
    n, everyone = players, (1 << players) - 1
    inner = [s for s in range(1, everyone)]
    kernel = {s: Fraction(n - 1, math.comb(n, k) * k * (n - k)) for s in inner for k in [s.bit_count()]}
    inside = [[s >> i & 1 for s in range(everyone + 1)] for i in range(n)]
    normal = [[sum((kernel[s] * inside[i][s] * inside[j][s] for s in inner), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    normal.append([Fraction(1)] * n + [Fraction(0)])  # a Lagrange multiplier keeps the sum
    right = [[kernel.get(s, Fraction(0)) * inside[i][s] for s in range(everyone + 1)] for i in range(n)]
    right.append([Fraction(int(s == everyone)) for s in range(everyone + 1)])
    return solve(normal, right)[:n]


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", filters: Mapping[str, Column] | None = None) -> DataFrame:
    """(doc_id, part, mask) for each row: bit i of ``mask`` is set if it fails the i-th filter; the last is E.

    ``filters``: letter to a condition on the text column ``t`` (not NULL); ``text_filters`` unless given.
    E: the text is that of a row with a smaller doc_id, in any part. Texts are compared by 128 bits of hash.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    tests = filters if filters is not None else text_filters(F.col("t"))
    bits = [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(tests.values())]
    # Settled: texts are read once, and what follows is a few numbers a row.
    narrow = settle(rows.select(
        "doc_id", "part", sum(bits, F.lit(0)).alias("bits"), F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2")))
    copies = narrow.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1")
    # Settled, so that the join can be split where one text has a great share of the rows.
    copies = settle(copies.select("h1", "h2", "first"))
    marked = narrow.join(copies, ["h1", "h2"], "left")
    copy = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << len(tests))).otherwise(F.lit(0))
    return marked.select("doc_id", "part", (F.col("bits") + copy).alias("mask"))


def _per_coalition(count: str, n: int) -> Column:
    """Array by coalition: the rows of ``entries`` that fail one of its filters."""
    def removed(s: Column) -> Column:
        hit = F.filter("entries", lambda e: e["mask"].bitwiseAND(s) != 0)
        return F.aggregate(hit, F.lit(0).cast("long"), lambda total, e: total + e[count])

    return F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), removed)


def coalitions(failed: DataFrame, labels: DataFrame | None, letters: Sequence[str]) -> DataFrame:
    """One row per part: docs, and by coalition (bits) the arrays removed, good, toxic; ``only``: the rows of exactly its mask.

    ``labels`` (doc_id, quality, toxic); a doc_id counts as good if a row of it has quality 1, as toxic
    if one has toxic 1. NULL doc_ids have no label.
    """
    n = len(letters)
    if labels is not None:
        known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("q"), F.col("toxic").alias("x"))
        known = known.groupBy("doc_id").agg(
            F.max(F.coalesce(F.col("q") == 1, F.lit(False)).cast("int")).alias("q"),
            F.max(F.coalesce(F.col("x") == 1, F.lit(False)).cast("int")).alias("x"))
        failed = failed.join(known.filter("q + x > 0"), "doc_id", "left")
    else:
        failed = failed.select("*", F.lit(0).alias("q"), F.lit(0).alias("x"))
    counts = failed.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("q", F.lit(0)).cast("long")).alias("good"), F.sum(F.coalesce("x", F.lit(0)).cast("long")).alias("toxic"))
    tabled = counts.groupBy("part").agg(
        F.sum("n").alias("docs"), F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("entries"))  # 2 ** n entries at most
    only = F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda s: F.aggregate(
        F.filter("entries", lambda e: e["mask"] == s), F.lit(0).cast("long"), lambda total, e: total + e["n"]))
    return tabled.select(
        "part", "docs", _per_coalition("n", n).alias("removed"), _per_coalition("good", n).alias("good"),
        _per_coalition("toxic", n).alias("toxic"), only.alias("only"))


def audit(table: DataFrame, letters: Sequence[str]) -> DataFrame:
    """One row per part, order and step of ``coalitions``: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    n = len(letters)
    orders = ["".join(p) for p in itertools.permutations(letters)]
    factor = math.factorial(n)
    shares = [[int(factor * x) for x in row] for row in shapley_matrix(n)]  # whole numbers: sums over orders
    weights = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in shares])
    at = lambda name, i: F.get(F.col(name), i)
    shapley = F.transform(weights, lambda row: F.aggregate(
        F.zip_with(row, "removed", lambda w, v: w * v), F.lit(0).cast("long"), lambda total, x: total + x))
    # In two steps, so that the arrays of a part are worked out once, not for each of its rows.
    parts = settle(table.withColumn("shares", shapley))
    rows = parts.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in orders])))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = {x: F.locate(x, F.col("filter_order")) for x in letters}
    bit = lambda x: 1 << letters.index(x)
    before = sum((F.when(place[x] < F.col("step"), bit(x)).otherwise(0) for x in letters), F.lit(0))
    own = sum((F.when(place[x] == F.col("step"), letters.index(x)).otherwise(0) for x in letters), F.lit(0))
    alone = F.get(F.array(*[F.lit(1 << i) for i in range(n)]), F.col("own"))
    rows = rows.withColumn("before", before).withColumn("own", own).withColumn("alone", alone)
    after = F.col("before") + F.col("alone")
    gone = at("removed", after) - at("removed", F.col("before"))
    return rows.select(
        "part", "filter_order", "step", (F.col("docs") - at("removed", after)).alias("kept"), gone.alias("removed"),
        (at("removed", F.col("alone")) - gone).alias("redundant"), at("only", F.col("alone")).alias("unique_fails"),
        (at("good", after) - at("good", F.col("before"))).alias("good_lost"),
        (at("toxic", after) - at("toxic", F.col("before"))).alias("toxic_lost"), at("shares", F.col("own")).alias("shapley"))


def audit_filters(
    docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", part: str = "source",
    filters: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per part (value of ``part``; NULL: '') , filter_order (all permutations) and step (from 1).

    kept: documents left after the step; removed: those that go in it; redundant: those that fail its
    filter but went earlier; unique_fails: those that fail no other filter; good_lost, toxic_lost:
    removed ones with that label; shapley: its filter's removals, summed over all orders.

    * NULL texts are empty: no words, no characters, equal to other empty ones.
    * Equal texts: the rows with the smallest doc_id pass E, also if that doc_id is repeated; rows with a
      NULL doc_id pass E and make no other row fail it.
    * Repeated rows count each. Labels without a document, and repeated labels, add nothing.
    * No documents: no rows. Other columns are ignored.
    """
    letters = [*(filters if filters is not None else "ABCD"), COPY]
    return audit(coalitions(failures(docs, doc_id, text, part, filters), labels, letters), letters)
