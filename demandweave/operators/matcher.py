"""Skill extraction: one regular expression over the text, evaluated in the JVM.

The dictionary is configuration. Its terms become a pattern on the driver; texts are only
ever read by executors, row by row, with no shuffle and no Python worker.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from demandweave.fixed_values import DEFAULT_GUARDS
from demandweave.functions.text import OUTER_SPACES

TOKEN = "[A-Za-z0-9+#]"
TOKEN_CHARS = string.ascii_letters + string.digits + "+#"  # one by one: Java looks them up in a table
TERMS_PER_MAP = 32  # a map literal is searched from its start, so terms are spread over many

Guard = tuple[str, str | None, str | None]


@dataclass(frozen=True)
class Term:
    """A surface form of a skill, lower case."""

    term: str
    skill_id: int
    skill: str
    category: str


def term_table(dictionary: DataFrame, *scope: str) -> DataFrame:
    """All surface forms of ``dictionary`` (skill_id, name, category, aliases).

    The canonical name comes before the aliases; blanks are dropped; of equal terms (without
    regard to case) the first definition wins. ``scope`` columns keep dictionaries apart.
    """
    forms = F.concat(F.array(F.col("name")), F.coalesce(F.col("aliases"), F.array().cast("array<string>")))
    rows = dictionary.select(
        *scope, "skill_id", F.col("name").alias("skill"), "category",
        F.posexplode(forms).alias("place", "form"),
    )
    rows = rows.withColumn("term", F.lower(F.regexp_replace("form", OUTER_SPACES, ""))).filter(F.col("term") != "")
    first = Window.partitionBy(*scope, "term").orderBy("skill_id", "place")
    return (
        rows.withColumn("rank", F.row_number().over(first)).filter("rank = 1")
        .select(*scope, "term", "skill_id", "skill", "category")
    )


def collect_terms(dictionary: DataFrame) -> list[Term]:
    """Bring a dictionary to the driver, where the pattern is built. It is configuration, not data."""
    return [Term(r.term, r.skill_id, r.skill, r.category) for r in term_table(dictionary).collect()]


# --- pattern ----------------------------------------------------------------------------


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", text)


def _guard_checks(term: str, guards: dict[str, Guard]) -> str:
    """Conditions at the end of a guarded term under which its occurrence counts."""
    if term not in guards:
        return ""
    _, before, after = guards[term]
    checks = f"(?!{after})" if after else ""
    if before:
        checks += f"(?<!(?:{before}){_quote(term)})"
    return checks


def _prefix_tree(terms: Sequence[str], guards: dict[str, Guard]) -> str:
    """Alternation of ``terms``, to stand in a group, with shared prefixes written once.

    Deeper branches come first, so the longest term wins as in a list sorted by length.
    A term that is the beginning of a guarded one gives way where the longer one stands:
    there the occurrence belongs to the guarded term, counted or not.
    """
    tree: dict = {}
    for term in terms:
        node = tree
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = term

    def ending(term: str) -> str:
        longer = [g for g in guards if g != term and g.startswith(term) and g in terms_set]
        yields = "".join(f"(?!{_quote(g[len(term):])}(?!{TOKEN}))" for g in longer)
        return f"(?!{TOKEN}){yields}{_guard_checks(term, guards)}"

    def write(node: dict, top: bool = False) -> str:
        branches = [_quote(ch) + write(child) for ch, child in sorted(node.items()) if ch]
        if "" in node:
            branches.append(ending(node[""]))
        return "|".join(branches) if top or len(branches) == 1 else "(?:" + "|".join(branches) + ")"

    terms_set = set(terms)
    return write(tree, top=True)


def _no_beginning(terms: Sequence[str]) -> str:
    """A look-ahead that fails at the characters of ASCII with which no term begins in any case."""
    firsts = {t[0] for t in terms}
    begin = {c for f in firsts for c in f.lower() + f.upper()}
    if not all(f.isascii() for f in firsts):  # some other letters are ASCII letters in another case
        begin |= set("iIkKsS")
    others = "".join(f"\\x{i:02x}" for i in range(128) if chr(i) not in begin)
    return f"(?![{others}])" if others else ""


def can_be_led(terms: Sequence[str], guards: Sequence[Guard]) -> bool:
    """Whether a character in front of the text changes no match, and a match never begins right behind another."""
    return all(t[-1] in TOKEN_CHARS for t in terms) and not any(before for _, before, _ in guards)


def build_pattern(terms: Sequence[str], guards: Sequence[Guard] = (), led: bool = False) -> str:
    """A Java pattern whose group 1 holds each occurrence that counts.

    Rejected occurrences of guarded terms are consumed by a second branch outside of the
    group, so they come out as ''. Terms are matched without regard to case and not inside
    longer tokens; '.' does not belong to a token.

    Most places of a text lie inside of a word. So that they cost one look at a table of characters, a match
    takes the character before a term with it, if the last match does not end there, and goes on only where
    some term may begin. The exact conditions are tested behind that. ``led``: the text has a line feed in
    front and the terms are as ``can_be_led`` says, so there always is such a character.
    """
    if not terms:
        return r"(?!)()"
    by_term: dict[str, Guard] = {}
    for guard in guards:
        by_term.setdefault(guard[0].lower(), guard)
    guarded = sorted((t for t in terms if t in by_term), key=len, reverse=True)
    rejected = f"|(?:{'|'.join(_quote(t) for t in guarded)})(?!{TOKEN})" if guarded else ""
    before = f"[^{TOKEN_CHARS}]" if led else rf"(?:\G|[^{TOKEN_CHARS}])"
    counts = f"({_prefix_tree(list(terms), by_term)})"
    return f"{before}{_no_beginning(terms)}(?iU)(?<!{TOKEN})" + (f"(?:{counts}{rejected})" if rejected else counts)


class SkillMatcher:
    """A dictionary with its guards, ready to be applied to text columns."""

    def __init__(self, terms: Sequence[Term], guards: Sequence[Guard] = tuple(DEFAULT_GUARDS)):
        self.terms = list(terms)
        forms = [t.term for t in terms]
        self.led = can_be_led(forms, guards)
        self.pattern = build_pattern(forms, guards, self.led)

    @classmethod
    def from_dictionary(cls, dictionary: DataFrame, guards: Sequence[Guard] = tuple(DEFAULT_GUARDS)):
        return cls(collect_terms(dictionary), guards)

    def surface_forms(self, text: Column) -> Column:
        """Distinct lower-case terms found in ``text``; NULL or blank gives an empty array."""
        searched = F.concat(F.lit("\n" if self.led else ""), F.coalesce(text, F.lit("")))
        found = F.regexp_extract_all(searched, F.lit(self.pattern), F.lit(1))
        return F.array_remove(F.array_distinct(F.transform(found, F.lower)), "")

    def _known(self, form: Column) -> Column:
        """struct(id, skill, category) of a surface form, NULL if it is none."""
        n = max(1, len(self.terms) // TERMS_PER_MAP)
        parts: list[list[Column]] = [[] for _ in range(n)]
        for t in self.terms:
            entry = F.struct(F.lit(t.skill_id).alias("id"), F.lit(t.skill).alias("skill"), F.lit(t.category).alias("category"))
            parts[zlib.crc32(t.term.encode()) % n] += [F.lit(t.term), entry]
        empty = F.create_map().cast("map<string, struct<id: int, skill: string, category: string>>")
        maps = F.array(*[F.create_map(*p) if p else empty for p in parts])
        return F.try_element_at(F.get(maps, (F.crc32(form) % n).cast("int")), form)

    def _entries(self, text: Column) -> Column:
        return F.array_compact(F.transform(self.surface_forms(text), self._known))

    def skill_ids(self, text: Column) -> Column:
        """Distinct skill ids mentioned in ``text``."""
        if not self.terms:
            return F.array().cast("array<int>")
        return F.array_distinct(F.transform(self._entries(text), lambda e: e["id"]))

    def skill_names(self, text: Column) -> Column:
        """Sorted distinct canonical names mentioned in ``text``."""
        if not self.terms:
            return F.array().cast("array<string>")
        return F.array_sort(F.array_distinct(F.transform(self._entries(text), lambda e: e["skill"])))

    def skills_in(self, text: Column) -> Column:
        """struct(id, skill, category) of each distinct skill mentioned in ``text``."""
        return F.array_distinct(self._entries(text))


def extract_links(texts: DataFrame, matcher: SkillMatcher) -> DataFrame:
    """One row (job_id, skill, category) per distinct skill of a posting's title and text."""
    blob = F.concat(F.col("title"), F.lit("\n"), F.col("description"))
    if not matcher.terms:
        return texts.select("job_id", F.lit("").alias("skill"), F.lit("").alias("category")).limit(0)
    return texts.select("job_id", F.explode(matcher.skills_in(blob)).alias("s")).select("job_id", "s.skill", "s.category")


def texts_for(jobs: DataFrame, job_ids: DataFrame) -> DataFrame:
    """Title and text of the postings whose id is in ``job_ids``."""
    return jobs.join(job_ids.select("job_id"), "job_id", "left_semi").select(
        "job_id", "title", "description"
    )


def replace_links(links: DataFrame, job_ids: DataFrame, fresh: DataFrame) -> DataFrame:
    """Drop the links of ``job_ids``, add the new ones. Ids without new links end empty."""
    kept = links.join(job_ids.select("job_id"), "job_id", "left_anti")
    return kept.select("job_id", "skill", "category").unionByName(
        fresh.select("job_id", "skill", "category")
    )


def reextract(jobs: DataFrame, links: DataFrame, job_ids: DataFrame | None, matcher: SkillMatcher) -> DataFrame:
    """New links table after extraction for ``job_ids`` only, or for all postings if None."""
    if job_ids is None:
        return extract_links(jobs, matcher)
    return replace_links(links, job_ids, extract_links(texts_for(jobs, job_ids), matcher))
