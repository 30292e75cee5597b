"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of blocks of 512 bits, built by an aggregation and as large as the list
asks for. A URL looks at one block only, so probing is a join on the block number; what passes
meets the list itself in an exact join, and false positives end there.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandweave.llm.staging import settle

BITS_PER_URL = 16
WORDS = 8  # of 64 bits in a block; a URL sets one bit in each

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class UrlRule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _low(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def host_of(url: Column) -> Column:
    """Between the first :// and /, ?, # or the end, A-Z lower-cased; '' without ://."""
    return F.coalesce(_low(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to ?, # or the end; '' without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One spelling for URLs that name the same page; NULL without ://.

    Scheme, www., standard ports, fragment, repeated and closing slashes, index.html and tracking
    parameters go; the other parameters are sorted.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path_of(url), "/+", "/"), r"/index\.html?$", ""), "/$", "")
    query = F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&")
    own = F.sort_array(F.filter(query, lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)")))
    return F.when(url.contains("://"), F.concat(
        host, path, F.when(F.size(own) > 0, F.concat(F.lit("?"), F.array_join(own, "&"))).otherwise(F.lit(""))))


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """(rule, verdict) of the longest rule that fits the host or a domain above it and the start of the path, else NULL."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a URL, and the bit it sets in each word of the block."""
    place, spots = F.xxhash64(key), F.xxhash64(F.lit(1), key)
    one = F.lit(1).cast("long")
    shift = [F.shiftrightunsigned(spots, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return F.pmod(place, F.lit(blocks)), [F.call_function("shiftleft", one, s) for s in shift]


def bloom_blocks(listed: DataFrame, url: str, blocks: int, name: str = "block") -> DataFrame:
    """The filter: ``name`` and the array words of its 64-bit words. Blocks that nothing is listed in are left out."""
    block, bits = _bits(F.col(url), blocks)
    rows = listed.select(block.alias(name), *[b.alias(f"w{i}") for i, b in enumerate(bits)])
    words = [F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]
    return rows.groupBy(name).agg(*words).select(name, F.array(*[f"w{i}" for i in range(WORDS)]).alias("words"))


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[UrlRule] = (), url: str = "url", listed_url: str = "url",
    bits_per_url: int = BITS_PER_URL,
) -> DataFrame:
    """Add host, path, rule, verdict (allow or block), listed and maybe_listed to ``pages``.

    The verdict is the rule's; where none fits, URLs of the list are blocked and others allowed.

    * NULL and texts without :// have an empty host and path, are never listed, hence allowed; they
      look at no block.
    * URLs of both sides are compared in canonical form; the list may repeat them or hold NULLs.
    * One row per row of ``pages``; its other columns stay, but for those named like a result.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "listed", "maybe_listed")
    own, page = pages.columns, [F.col(f"`{c}`") for c in pages.columns]
    # The page is one column, so no name of it meets those in use here.
    exact = settle(listed.select(canonical(F.col(listed_url)).alias("key")).filter("key is not null").distinct())
    n = exact.count()
    blocks = max(1, -(-n * bits_per_url // (64 * WORDS)))
    probe = pages.select(F.struct(*page).alias("page"), canonical(F.col(f"`{url}`")).alias("key"), F.col(f"`{url}`").cast("string").alias("url"))
    block, bits = _bits(F.col("key"), blocks)
    filters = settle(bloom_blocks(exact, "key", blocks))
    probed = probe.withColumn("block", F.when(F.col("key").isNotNull(), block)).join(filters, "block", "left")
    hit = F.lit(True)
    for i, b in enumerate(bits):
        hit = hit & (F.get("words", F.lit(i)).bitwiseAND(b) != 0)
    maybe = F.coalesce(hit, F.lit(False))
    probed = probed.select("page", "url", maybe.alias("maybe_listed"), F.when(maybe, F.col("key")).alias("key"))
    both = probed.join(exact.withColumn("on_list", F.lit(True)), "key", "left")
    listed_ = F.coalesce("on_list", F.lit(False))
    judged = both.select("page", "maybe_listed", listed_.alias("listed"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("found.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select(*[F.col("page").getField(c).alias(c) for c in own], "host", "path", F.col("found.rule").alias("rule"),
                         verdict.alias("verdict"), "listed", "maybe_listed")
