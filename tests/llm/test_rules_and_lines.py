from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from demandweave.llm.decontamination import with_leaks
from demandweave.llm.line_dedup import dedup_lines
from demandweave.llm.order_minhash import keep_one
from demandweave.llm.quality_rules import RULES, Rule, judge

SCHEMA = "doc_id long, text string"
WORD = r"[^\x20\x09-\x0D]+"


def counts(text):
    text = text or ""
    w = re.findall(WORD, text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {p for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))


def test_counts_and_base(spark, rnd, prose):
    part = prose(12)
    texts = [None, "", " \t\n", "a b c d e a b c d e", "é ü x \U0001f600 ##|", f"{part}\n{part}\n \n{prose(9)}", "x " * 5000,
             f"{prose(30)}\r\n{prose(5)}\x0b{prose(3)}\x0c", "one\ntwo\n\none\none ", "w " * 6, prose(4), prose(5)]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    rows = list(enumerate(texts))
    for r in judge(spark.createDataFrame(rows, SCHEMA)).collect():
        want = counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)


def test_verdicts(spark):
    clean = "The history of the town is short, and it was built on the river by people that came from the north in a cold year. "
    texts = {"": clean, "exclamations,capitals,stop_words": clean.upper().replace(" ", "!! "), "symbols,stop_words": clean.replace(" ", "### "),
             "stop_words": "xq vbn trew plok " * 1 + "uiop asdf ghjk lzxc vbnm qwer tyui opas", "word_length": "the " + " ".join("y" * (40 + i) for i in range(12))}
    got = {r.broken_rules: r.kept for r in judge(spark.createDataFrame(list(enumerate(texts.values())), SCHEMA)).collect()}
    assert got == {name: name in ("", "stop_words") for name in texts}  # no stop words alone is no reason


def test_rules_are_a_parameter_and_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k", 7, True)], SCHEMA + ", n_words long, kept boolean")
    row = judge(df, [Rule("few", "n_words", "n_lines", None, 1000)]).first()
    assert (row.n_words, row.kept, row.broken_rules) == (11, False, "few")
    assert judge(df, []).first().kept
    assert judge(spark.createDataFrame([], SCHEMA)).collect() == []
    assert len({r.name for r in RULES}) == len(RULES)


def test_rules_are_one_projection(spark, tmp_path):
    spark.createDataFrame([(1, "a")], SCHEMA).write.parquet(str(tmp_path / "d"))
    plan = judge(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Join", plan)


def brute_lines(rows, chars=40, docs=5):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    order = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars:
                held[key(x)].add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= docs and max(held[key(x)]) != order(i))]
        out.append((repr(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines_match_brute_force(spark, rnd, prose):
    common = [prose(rnd.randint(3, 12)) for _ in range(12)] + ["é" * 39, "é" * 40]
    rows = [(i, "\n".join(
        rnd.choice([" ", "", "\t"]) + (rnd.choice([str.upper, str]))(rnd.choice(common)) if rnd.random() < 0.6 else prose(8)
        for _ in range(rnd.choice([1, 3, 8, 150])))) for i in range(40)]
    rows += [(None, None), (None, common[0]), (None, common[1]), (50, ""), (50, "\n\n"), (51, rows[3][1]), (51, rows[3][1]), (51, common[0])]
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((repr(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got) == brute_lines(rows)
    assert all((r.bitmap is None) == (r.n_dropped == 0) for r in got)
    bits = {r.doc_id: sum(bin(w.bits & (1 << 64) - 1).count("1") for w in r.bitmap) for r in got if r.bitmap and r.doc_id not in (None, 51)}
    assert bits == {r.doc_id: r.n_dropped for r in got if r.doc_id in bits}


def test_lines_keep_columns_and_empty_tables(spark):
    line = "a line that is long enough to be a shared line"
    df = spark.createDataFrame([(i, line, "s", i) for i in range(6)], SCHEMA + ", key string, d long")
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "key", "d", "n_lines", "n_dropped", "bitmap", "kept_text"]
    assert {r.doc_id: r.kept_text for r in out.collect()} == {**{i: "" for i in range(5)}, 5: line}
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lines_plan_has_no_python(spark, tmp_path):
    spark.createDataFrame([(1, "a")], SCHEMA).write.parquet(str(tmp_path / "d"))
    plan = dedup_lines(spark.read.parquet(str(tmp_path / "d"))).select("doc_id", F.sha2("kept_text", 256))
    assert not re.search("Python|Arrow|Pandas|Window", plan._jdf.queryExecution().executedPlan().toString())


NAMES = ["words", "lines", "d", "t", "gone", "c1", "c2", "words_of", "found", "_words", "_lines", "_d", "_t", "_gone", "_c1", "_c2", "_text", "_found",
         "bitmap_", "key", "h1", "n", "first", "part", "place"]


@pytest.mark.parametrize("extra", [NAMES[:13], NAMES[13:]])
def test_documents_may_have_any_column(spark, extra):
    rows = [(1, "some words that are here", *[5] * len(extra)), (2, None, *[None] * len(extra))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in extra))
    items = spark.createDataFrame([(1, "no such item here at all")], "item_id long, text string")
    for name, df in (("rules", judge(docs)), ("lines", dedup_lines(docs)), ("near", keep_one(docs)), ("leaks", with_leaks(docs, items))):
        assert {(r.doc_id, *(r[n] for n in extra)) for r in df.collect()} == {(1, *[5] * len(extra)), (2, *[None] * len(extra))}, name
