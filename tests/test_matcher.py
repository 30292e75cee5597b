from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from demandweave.operators.matcher import SkillMatcher, Term, collect_terms, extract_links, reextract

SKILLS = {
    "JavaScript": ["JavaScript", "JS"], "C#": ["C#", "C Sharp"], ".NET": [".NET"], "Go": ["Go", "Golang"],
    "C++": ["C++"], "C": ["C"], "R": ["R"], "Node.js": ["Node.js", "Node"], "Python": ["Python"],
    "GitHub": ["GitHub"], "GitHub Actions": ["GitHub Actions"], "Delta Lake": ["Delta Lake"],
}
TERMS = [
    Term(form.lower(), i, name, "x") for i, (name, forms) in enumerate(SKILLS.items(), 1) for form in forms
]


def names(spark, texts, terms=TERMS, **kwargs):
    matcher = SkillMatcher(terms, **kwargs)
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    rows = df.select("n", matcher.skill_names(F.col("t")).alias("s")).collect()
    return [r.s for r in sorted(rows)]


CASES = [
    ("We use JavaScript and C# on .NET.", [".NET", "C#", "JavaScript"]),
    ("Google and JSON are no skills", []),
    ("we use Python.", ["Python"]),
    ("PYTHON python PyThOn", ["Python"]),
    ("node.js, Node", ["Node.js"]),
    ("C++ or C# but not C+", ["C#", "C++"]),
    ("C, C++ and Go", ["C", "C++", "Go"]),
    ("GitHub Actions only", ["GitHub Actions"]),
    ("GitHub Actions and GitHub", ["GitHub", "GitHub Actions"]),
    ("a Delta Lake", ["Delta Lake"]),
    ("asp.net", []),
    ("x.net .net", [".NET"]),
    ("", []),
    ("  \n ", []),
    (None, []),
    # guards
    ("Go-to-Market team", []), ("go-live date", []), ("as you go", []), ("Go, Rust", ["Go"]),
    ("as you go with Go", ["Go"]), ("C-level", []), ("C suite", []), ("the C‑suite", []), ("Series C round", []),
    ("U.S.C. law", []), ("C’s", []), ("R&D and R$", []), ("R, SQL", ["R"]), ("C level and C", ["C"]),
    ("Series C Sharp", ["C#"]), ("C level", []),
]


@pytest.mark.parametrize("dummy", [0])
def test_cases(spark, dummy):
    got = names(spark, [t for t, _ in CASES])
    assert {t: g for (t, _), g in zip(CASES, got)} == {t: sorted(w) for t, w in CASES}


def test_empty_dictionary_never_matches(spark):
    assert names(spark, ["Python"], terms=[]) == [[]]


def test_a_rejected_long_term_hides_a_shorter_one(spark):
    terms = [Term("c", 1, "C", ""), Term("c sharp", 2, "C#", "")]
    guards = [("C Sharp", None, " round")]
    assert names(spark, ["a c sharp round", "a c sharp", "a c"], terms, guards=guards) == [[], ["C#"], ["C"]]


def scan(text, terms, guards):
    """Plain left-to-right scan: at each place the longest term that stands there."""
    found, i = set(), 0
    token = re.compile("[A-Za-z0-9+#]")
    ordered = sorted(terms, key=lambda t: -len(t.term))
    while i < len(text):
        if i and token.match(text[i - 1]):
            i += 1
            continue
        for t in ordered:
            end = i + len(t.term)
            if text[i:end].lower() == t.term and not (end < len(text) and token.match(text[end])):
                guard = guards.get(t.term)
                after = guard and guard[1] and re.match(guard[1], text[end:], re.I)
                before = guard and guard[0] and re.search(f"(?:{guard[0]})$", text[max(0, i - 16):i], re.I)
                if not after and not before:
                    found.add(t.skill)
                i = end
                break
        else:
            i += 1
    return sorted(found)


def test_random_texts_against_a_plain_scan(spark):
    rng = random.Random(7)
    words = ["go", "Go", "C", "c", "C#", "C Sharp", "R", "JS", "Node", ".js", "Node.js", ".NET", "GitHub", "Actions",
             "you", "series", "level", "suite", "&", "$", "-", "‑", "’s", ".", ",", "+", "#", "to-market", "live", "é", " ", "A."]
    texts = ["".join(w + rng.choice(["", " ", " ", "-"]) for w in rng.choices(words, k=rng.randint(1, 14))) for _ in range(4000)]
    guards = {"c": (r"[A-Za-z]\.|\bseries ", r"[\s‑-]?(?:level|suite)\b|['’]"), "r": (None, r"[&$]"),
              "go": (r"\byou ", r"-(?:to-market|live)")}
    got = names(spark, texts)
    wrong = [(t, g, scan(t, TERMS, guards)) for t, g in zip(texts, got) if g != scan(t, TERMS, guards)]
    assert wrong == []


def test_terms_with_and_without_a_character_in_front(spark):
    """Terms that all end in a letter are searched with a line feed in front of the text; both ways find the same."""
    rng = random.Random(8)
    words = ["k", "is", "s+", "k s", "\u017fa", "i.k"]
    terms = [Term(w, i, w, "x") for i, w in enumerate(words)]
    assert SkillMatcher(terms, []).led and not SkillMatcher([*terms, Term("k.", 9, "k.", "x")], []).led
    assert not SkillMatcher(terms, [("k", "^", None)]).led
    texts = ["".join(rng.choices(["k", "K", "i", "s", "S", " ", ".", "+", "\n", "a", "\u212a", "\u017f", "\u0130", "\u0131"], k=rng.randint(0, 14))) for _ in range(3000)]
    # A guard which never applies takes the other way.
    assert names(spark, texts, terms, guards=[]) == names(spark, texts, terms, guards=[("k", "never ", None)])
    plain = [t for t in texts if t.isascii()]
    assert names(spark, plain, terms, guards=[]) == [scan(t, terms, {}) for t in plain]


def test_first_definition_of_a_term_wins(spark):
    dictionary = spark.createDataFrame(
        [(1, "Kubernetes", "DevOps", ["k8s", " "]), (2, "K8S", "Cloud", None), (3, "Go", "Language", ["golang"])],
        "skill_id int, name string, category string, aliases array<string>",
    )
    terms = {t.term: t.skill_id for t in collect_terms(dictionary)}
    assert terms == {"kubernetes": 1, "k8s": 1, "go": 3, "golang": 3}
    many = SkillMatcher([Term(f"term{i}", i, f"Term {i}", "T") for i in range(6_000)], [])
    row = spark.createDataFrame([("term5999 and term17, term17",)], "t string").select(many.skill_names(F.col("t")).alias("n")).first()
    assert row.n == ["Term 17", "Term 5999"]


def test_links_are_distinct_per_skill_and_incremental(spark):
    jobs = spark.createDataFrame(
        [("a", "JavaScript dev", "JS and Python"), ("b", "None", "nothing"), ("c", "Go", "Golang")],
        "job_id string, title string, description string",
    )
    matcher = SkillMatcher(TERMS)
    assert {(r.job_id, r.skill) for r in extract_links(jobs, matcher).collect()} == {
        ("a", "JavaScript"), ("a", "Python"), ("c", "Go")}
    assert extract_links(jobs, SkillMatcher([])).count() == 0
    old = spark.createDataFrame([("a", "Old", "x"), ("b", "Old", "x"), ("c", "Old", "x")],
                                "job_id string, skill string, category string")
    ids = spark.createDataFrame([("a",), ("b",), ("a",)], "job_id string")
    new = reextract(jobs, old, ids, matcher)
    assert sorted((r.job_id, r.skill) for r in new.collect()) == [("a", "JavaScript"), ("a", "Python"), ("c", "Old")]
    assert sorted((r.job_id, r.skill) for r in reextract(jobs, old, None, matcher).collect()) == [
        ("a", "JavaScript"), ("a", "Python"), ("c", "Go")]


def test_pattern_runs_once_and_in_the_jvm(spark):
    jobs = spark.createDataFrame([("a", "x", "y")], "job_id string, title string, description string")
    plan = extract_links(jobs, SkillMatcher(TERMS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Exchange" not in plan
