from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from demandweave.llm.chat_format import preference_segments, swapped_replies
from demandweave.llm.license_scan import NOTICES, FuzzyNotices, exact_places, holds_in_order, pieces, scan_licenses, word_text
from demandweave.llm.queries import URL_RULES
from demandweave.llm.url_filters import UrlRule, bloom_blocks, canonical, judge_urls

URLS = "page_id long, url string"
TURNS = "pair_id long, turn long, role string, text string"


def test_canonical(spark):
    cases = {
        "http://WWW.Example.org:80//a//b/?b=2&a=1#x": "example.org/a/b?a=1&b=2", "https://example.org/a/b": "example.org/a/b",
        "https://example.org/index.html": "example.org", "https://example.org": "example.org",
        "x://h/p?utm_source=1&ref=2&q=3": "h/p?q=3", "no scheme": None, "": None, "a://b://c": "b:/c",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", canonical(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in rows} == cases


def test_rules(spark):
    urls = {
        "http://a.example.org/es/1": ("example.org/es/", "block"), "http://example.org/en/1": ("example.org/en/1", "block"),
        "http://example.org/en/2": ("org/", "allow"), "http://notexample.org/es/": ("org/", "allow"), "http://ORG/": ("org/", "allow"),
        "http://x.com/fr/": ("com/fr/", "allow"), "http://x.com/de/": ("com/de/", "block"), "http://x.com/": (None, "allow"),
        "http://x.org": (None, "allow"), "x.org/": (None, "allow"),
    }
    df = spark.createDataFrame(list(enumerate(urls)), URLS)
    got = {r.url: (r.rule, r.verdict) for r in judge_urls(df, df.filter("false"), URL_RULES).collect()}
    assert got == urls


def test_list_matches_exact_lookup(spark, rnd):
    make = lambda: f"http{rnd.choice(['', 's'])}://{rnd.choice(['', 'www.'])}h{rnd.randint(0, 60)}.net/{rnd.choice('abc')}{rnd.choice(['', '/', '?ref=1', '#t'])}"
    pages = [(i, make()) for i in range(600)] + [(None, None), (1, ""), (2, "plain")] + [(9, "http://h1.net/a")] * 40
    listed = spark.createDataFrame([(make(),) for _ in range(40)] * 2 + [(None,), ("junk",)], "url string")
    df = spark.createDataFrame([(*p, "k", 3) for p in pages], URLS + ", w0 string, block long")
    out = judge_urls(df, listed)
    names = {r.c for r in listed.select(canonical(F.col("url")).alias("c")).collect() if r.c}
    rows = out.withColumn("c", canonical(F.col("url"))).collect()
    assert len(rows) == len(pages) and out.columns[:4] == ["page_id", "url", "w0", "block"]
    assert all(r.listed == (r.c in names) and r.verdict == ("block" if r.listed else "allow") for r in rows)
    assert all(r.maybe_listed for r in rows if r.listed)


def test_filter_is_small_and_mostly_right(spark):
    urls = spark.range(5000).select(F.concat(F.lit("h.net/"), "id").alias("url"))
    assert bloom_blocks(urls, "url", 157).count() <= 157
    pages = spark.range(5000, 25000).select("id", F.concat(F.lit("http://h.net/"), "id").alias("url"))
    listed = urls.select(F.concat(F.lit("http://"), "url").alias("url"))
    false = judge_urls(pages, listed).filter("maybe_listed").count()
    assert false < 200 and judge_urls(pages, listed).filter("listed").count() == 0


def test_urls_empty_tables(spark):
    none = spark.createDataFrame([], URLS)
    some = spark.createDataFrame([(1, "http://a.b/")], URLS)
    assert judge_urls(none, some, URL_RULES).collect() == [] and judge_urls(some, none, [UrlRule("b", "", "block")]).first().verdict == "block"


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute_base(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    starts = [i for i, _ in places]
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_matches_brute_force(spark, rnd):
    bits = ["under", "the MIT", "license", "Apache-License,", "version", "2", "cc", "by", "nc", "CC BY-NC", "é", "\n", "x.", "0", "\x7f", "mit"]
    texts = [None, "", "...", "cc by nc by nc cc by nc", "under the mit licenseé", "é cc by nc"]
    texts += [rnd.choice(["", " "]).join(rnd.choice(bits) + rnd.choice([" ", ""]) for _ in range(rnd.randint(1, 60))) for _ in range(200)]
    got = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        want = brute_base(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_edits_within_the_bound_are_found(rnd, prose):
    fuzzy = FuzzyNotices(NOTICES)
    for i, notice in enumerate(NOTICES):
        assert "".join(p for _, p in pieces(notice.phrase, notice.edits)) == notice.phrase
        for edits in range(notice.edits + 1):
            letters = list(notice.phrase)
            for _ in range(edits):
                k = rnd.randrange(1, len(letters) - 1)
                letters[k : k + rnd.randint(0, 1)] = [rnd.choice("qz")]
            text = "".join(letters)
            if not holds_in_order(text, notice.exact):
                continue  # the name itself is edited
            best = distance(notice.phrase, text)
            found = [f for f in fuzzy.find(f"{prose(20)} {text} {prose(20)}") if f[0] == i]
            assert found and min(f[3] for f in found) <= best, (notice, text)
    assert fuzzy.find(word_text(prose(400).encode()).decode()) == []


def test_spans_and_labels(spark):
    text = "Intro. This work is lisensed under the GNU General Publik License, version 3. All rights reservd!"
    row = scan_licenses(spark.createDataFrame([(1, text, 2)], "doc_id long, text string, spans long")).first()
    assert row.labels == "all-rights-reserved,gpl-3" and row.base_labels == "" and row.n_base == 0 and 0.9 < row.score < 1
    assert [(s.label, s.start, s.end, s.edits) for s in row.spans] == [("gpl-3", 7, 13, 1), ("all-rights-reserved", 13, 16, 1)]
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert exact_places(b"cc by nc cc by nc", b"cc by nc") == [0, 3] and exact_places(b"", b"cc") == []


def segments(spark, chosen, rejected):
    out = preference_segments(spark.createDataFrame(chosen, TURNS), spark.createDataFrame(rejected, TURNS))
    return sorted((repr(r.pair_id), r.part, r.turn, r.rendered, r.loss) for r in out.collect())


def test_longest_common_prefix(spark):
    prompt = [(1, 0, "system", "s"), (1, 1, "user", "u")]
    chosen = [*prompt, (1, 2, "assistant", "good"), (1, 3, "user", "thanks")]
    rejected = [*prompt, (1, 2, "assistant", "bad")]
    assert segments(spark, chosen, rejected) == [
        ("1", "chosen", 2, "<|assistant|>\ngood<|end|>\n", True), ("1", "chosen", 3, "<|user|>\nthanks<|end|>\n", False),
        ("1", "prompt", 0, "<|system|>\ns<|end|>\n", False), ("1", "prompt", 1, "<|user|>\nu<|end|>\n", False),
        ("1", "rejected", 2, "<|assistant|>\nbad<|end|>\n", True)]


def test_chat_edge_cases(spark):
    same = [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    assert {x[1] for x in segments(spark, same, same)} == {"prompt"} and len(segments(spark, same, same)) == 2
    assert {x[1] for x in segments(spark, same, [])} == {"chosen"} and {x[1] for x in segments(spark, [], same)} == {"rejected"}
    assert segments(spark, [], []) == []
    # NULL and '' differ; a NULL pair is a pair; the same text in another role differs.
    assert [x[1] for x in segments(spark, [(None, 0, "user", None)], [(None, 0, "user", "")])] == ["chosen", "rejected"]
    assert [x[1] for x in segments(spark, [(1, 0, "user", "a")], [(1, 0, "assistant", "a")])] == ["chosen", "rejected"]
    # Repeated rows are compared as a set and all rendered; very long texts pass through.
    long = "w " * 200_000
    twice = [(2, 0, "user", long)] * 2
    assert [x[1] for x in segments(spark, twice, twice[:1])] == ["prompt", "prompt"]
    # A gap in the numbers is a difference.
    assert [x[:3] for x in segments(spark, [(3, 0, "user", "a"), (3, 2, "user", "b")], [(3, 0, "user", "a"), (3, 1, "user", "b")])] == [
        ("3", "chosen", 2), ("3", "prompt", 0), ("3", "rejected", 1)]


def test_prompt_and_completions_rebuild_both_sides(spark, rnd):
    rows = [(c, t, rnd.choice(["user", "assistant"]), rnd.choice("abc")) for c in range(30) for t in range(rnd.randint(1, 7))]
    chosen, rejected = swapped_replies(spark.createDataFrame(rows, TURNS.replace("pair_id", "conv_id")))
    for side, df in (("chosen", chosen), ("rejected", rejected)):
        out = preference_segments(chosen, rejected).filter(F.col("part").isin("prompt", side)).collect()
        want = sorted((r.pair_id, r.turn, f"<|{r.role}|>\n{r.text}<|end|>\n") for r in df.collect())
        assert sorted((r.pair_id, r.turn, r.rendered) for r in out) == want
    plain = [spark.createDataFrame(df.collect(), TURNS) for df in (chosen, rejected)]
    plan = preference_segments(*plain)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Window|collect_list", plan)


# Wordings of licences that no notice stands for; none may get a label of its own.
OTHERS = [
    "licensed under the bsd license", "licensed under the isc license", "licensed under the mpl license", "licensed under the zlib license",
    "licensed under cc by sa 4.0", "licensed under cc by nd 4.0", "GNU General Public License version 2", "gnu lesser general public license version 3",
    "gnu affero general public license version 3", "mozilla public license version 1.1", "apache license version 1.1", "licensed under the apache license version 1 1",
    "creative commons attribution sharealike 4.0 international", "creative commons attribution noderivatives 4.0 international",
    "eclipse public license version 2.0", "european union public licence version 1.2", "permission is not granted to any person",
]


def test_no_licence_gets_the_name_of_another(spark):
    """Every notice against every other, and against licences without a notice."""
    fuzzy = FuzzyNotices(NOTICES)
    for i, notice in enumerate(NOTICES):
        assert {NOTICES[f[0]].label for f in fuzzy.find(f"one two {notice.phrase} three")} == {notice.label}, notice
    for text in OTHERS:
        assert fuzzy.find(word_text(f"this work is {text} as it stands".encode()).decode()) == [], text
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(OTHERS)], "doc_id long, text string")
    assert {r.labels for r in scan_licenses(docs).collect()} == {""}


def test_all_places_of_a_notice_are_reported():
    fuzzy = FuzzyNotices(NOTICES)
    text = "all rights reservd all rights reserved al rights reserved x all rights reserved"
    got = [(a, b, e) for i, a, b, e in fuzzy.find(text) if NOTICES[i].label == "all-rights-reserved"]
    assert [(text[a:b].strip(), e) for a, b, e in got] == [
        ("all rights reservd", 1), ("all rights reserved", 0), ("al rights reserved", 1), ("all rights reserved", 0)]
    assert not [f for f in fuzzy.find("small rights reserved") if f[3] == 0]


@pytest.mark.parametrize("extra", ["block", "key", "words", "url_", "page", "found", "on_list", "w0", "w7", "_block", "_url", "_rule", "maybe"])
def test_pages_may_have_any_column(spark, extra):
    pages = spark.createDataFrame([("http://a.org/x", 1, None), (None, 2, 3)], f"url string, page_id long, `{extra}` long")
    listed = spark.createDataFrame([("http://a.org/x",), (None,)], "url string")
    got = {r.page_id: (r.verdict, r[extra]) for r in judge_urls(pages, listed).collect()}
    assert got == {1: ("block", None), 2: ("allow", 3)}


def test_turns_without_a_number_stand_last(spark):
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, None, "user", "left")]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, None, "user", "right")]
    got = preference_segments(spark.createDataFrame(chosen, TURNS), spark.createDataFrame(rejected, TURNS)).collect()
    assert sorted((r.part, r.turn if r.turn is not None else 99, r.rendered.split("\n")[1][:5]) for r in got) == [
        ("chosen", 99, "left<"), ("prompt", 0, "q<|en"), ("prompt", 1, "a<|en"), ("rejected", 99, "right")]


def test_every_conversation_with_a_reply_makes_a_pair(spark, rnd):
    ids = rnd.sample(range(-50, 5000), 61)
    rows = [(c, t, role, f"{c}.{t}") for c in ids for t, role in ((0, "user"), (1, "assistant"), (2, "user"))] + [(None, 1, "assistant", "x"), (9999, 0, "user", "y")]
    chosen, rejected = swapped_replies(spark.createDataFrame(rows, TURNS.replace("pair_id", "conv_id")).repartition(7))
    order = sorted(ids)
    want = {c: f"{n}.1" for c, n in zip(order, order[1:] + order[:1])}
    assert {r.pair_id: r.text for r in rejected.filter("turn = 1").collect()} == want
    assert chosen.count() == 2 * 61 and rejected.count() == 2 * 61
    alone = spark.createDataFrame(rows[:3], TURNS.replace("pair_id", "conv_id"))
    assert all(df.isEmpty() for df in swapped_replies(alone))
