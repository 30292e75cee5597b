"""Classification of titles into role families by substring patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_CHARS = 3  # of a pattern, by which a text finds it or a bitmap tells that there is none

RolePatterns = Sequence[tuple[str, str]]


def matches_role(title_lower: Column, patterns: Sequence[str]) -> Column:
    """Whether the lower-cased title contains any of the patterns."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | F.contains(title_lower, F.lit(pattern))
    return F.coalesce(hit, F.lit(False))


def roles_of(title_lower: Column, roles: RolePatterns) -> Column:
    """Array of the distinct roles that a title belongs to."""
    by_role: dict[str, list[str]] = {}
    for role, pattern in roles:
        by_role.setdefault(role, []).append(pattern)
    if not by_role:
        return F.array().cast("array<string>")
    return F.array_compact(
        F.array(*[F.when(matches_role(title_lower, p), F.lit(r)) for r, p in by_role.items()])
    )


def parts_of(text: Column) -> Column:
    """All distinct parts of ``text`` with one to KEY_CHARS characters, and ''."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))

    def of_length(n: int) -> Column:
        return F.transform(places, lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.concat(F.array(F.lit("")), *[of_length(n) for n in range(1, KEY_CHARS + 1)]))


def parts_of_length(text: Column, lengths: Column) -> Column:
    """All distinct parts of ``text`` that have one of ``lengths`` characters."""
    def of_length(n: Column) -> Column:
        places = F.sequence(F.lit(1), F.when(n == 0, 1).otherwise(F.length(text) - n + 1))
        return F.transform(places, lambda i: F.substring(text, i, n))

    fitting = F.filter(lengths, lambda n: n <= F.length(text))
    return F.array_distinct(F.flatten(F.transform(fitting, of_length)))


BITMAP_WORDS = 1024  # of 64 bits, for the keys of a seed table


def _bit(pattern: Column) -> Column:
    """By the first characters and the length, so that patterns with the same beginning take few bits."""
    return F.pmod(F.xxhash64(F.substring(pattern, 1, KEY_CHARS), F.length(pattern)), F.lit(64 * BITMAP_WORDS))


def pattern_bitmap(seed: DataFrame) -> Column:
    """A scalar: the bits of all patterns, as an array of BITMAP_WORDS numbers (8 KB, however many there are)."""
    bits = seed.select(_bit(F.col("pattern")).alias("bit"))
    words = bits.groupBy(F.expr("bit div 64").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("w"))
    held = words.agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("m"))
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(BITMAP_WORDS - 1).cast("long"))
    return held.select(F.transform(numbers, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("bitmap")).scalar()


def posting_roles(postings: DataFrame, roles: RolePatterns | DataFrame) -> DataFrame:
    """Distinct (job_id, role) of ``postings`` (job_id, title_lower).

    A list of patterns is applied row by row: no join, no shuffle; there a job_id must stand once, and
    postings that have their ``roles`` already (as from ``roles_of``) keep them.
    A seed table (role, pattern) of any size stays a table. Then each different title is looked at
    once: its parts that are as long as some pattern meet the patterns in an equi-join on the whole
    pattern, so a title meets only patterns it contains, however many begin alike. Of the parts only
    those leave the task that some pattern may be, by a bitmap of the patterns' first characters and
    lengths. Titles take their roles back to the postings. Rows without a role or a pattern count
    for nothing.
    """
    if isinstance(roles, DataFrame):
        seed = roles.filter("role is not null and pattern is not null").select("role", "pattern").distinct()
        lengths = seed.agg(F.sort_array(F.collect_set(F.length("pattern"))).alias("lengths")).scalar()
        titles = postings.filter("title_lower is not null").select("title_lower").distinct()
        titles = titles.withColumn("bitmap", pattern_bitmap(seed)).withColumn("lengths", lengths)
        known = F.filter(parts_of_length(F.col("title_lower"), F.col("lengths")), lambda k: F.getbit(
            F.get("bitmap", F.floor(_bit(k) / 64).cast("int")), (_bit(k) % 64).cast("int")) == 1)
        parts = titles.select("title_lower", F.explode(known).alias("pattern"))
        found = parts.join(seed, "pattern").select("title_lower", "role").distinct()
        return postings.select("job_id", "title_lower").join(found, "title_lower").select("job_id", "role").distinct()
    known = F.col("roles") if "roles" in postings.columns else roles_of(F.col("title_lower"), roles)
    return postings.select("job_id", F.explode(known).alias("role"))
