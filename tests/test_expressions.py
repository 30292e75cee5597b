from __future__ import annotations

import datetime as dt
import hashlib
import html
import random
import re

from pyspark.sql import functions as F

from demandweave.functions import dates, json, numbers, text


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"n int, v {kind}")
    return [r.x for r in sorted(df.select("n", expr(F.col("v")).alias("x")).collect(), key=lambda r: r.n)]


def plain_text(value):
    if not value or not value.strip():
        return ""
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html.unescape(value))).strip()


def test_strip_html_cases(spark):
    values = [
        None, "", "  \t", "<p>Hi</p>", "&lt;p&gt;A &amp;amp; B&lt;/p&gt;", "a&nbsp;b c\x1dd", "caf&eacute; &#8364;&#x41;&#39;",
        "&notin; &notit; &ampx &amp", "a<b\nc>d", "1 < 2 > 3", "&#0;&#128;&#xD800;&#x110000;&#1;", "<>", "&", "&&amp;&", "&lt",
    ]
    assert column(spark, values, text.strip_html) == [plain_text(v) for v in values]


def test_strip_html_random(spark):
    rng = random.Random(3)
    parts = ["&amp;", "&lt;", "&gt;", "&copy", "&#65;", "&#x42", "&nbsp;", "&bogus;", "&", ";", "<b>", "</b>", "<", ">", "x", "é", " ",
             "\n", " ", "#", "lt", "amp", "&notin", "&hellip;", "&CounterClockwiseContourIntegral;"]
    values = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    assert column(spark, values, text.strip_html) == [plain_text(v) for v in values]


def test_odd_spaces_are_those_that_change(spark):
    rng = random.Random(4)
    values = ["".join(rng.choices(" \n\t\x0b\x1c\x85\u00a0\u3000a<é ", k=rng.randint(0, 9))) for _ in range(3000)]
    every = column(spark, values, lambda c: F.regexp_replace(c, text.SPACES, " "))
    assert column(spark, values, lambda c: F.regexp_replace(c, text.ODD_SPACES, " ")) == every


def test_keys_and_hashes(spark):
    values = [None, "", " Ácme,  Inc.! ", "C++/C#", "ÉÉ", "a b"]

    def key(v):
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ]", " ", (v or "").strip().lower())).strip()

    assert column(spark, values, text.normalize_for_key) == [key(v) for v in values]
    got = column(spark, values, lambda c: text.dedup_hash(c, F.lit("Dev"), c))
    assert got == [hashlib.sha256(f"{key(v)}|dev|{key(v)}".encode()).hexdigest().upper() for v in values]
    df = spark.range(1)
    same = df.select(
        text.dedup_hash(F.lit("Acme, Inc."), F.lit("Data  Engineer"), F.lit(None).cast("string")).alias("a"),
        text.dedup_hash(F.lit("acme inc"), F.lit("data-engineer"), F.lit("")).alias("b"),
        text.make_job_id(F.lit("lever"), F.lit("1")).alias("id"),
    ).first()
    assert same.a == same.b and same.id == hashlib.sha256(b"lever|1").hexdigest()


def test_surrogate_key_marks_null(spark):
    got = column(spark, ["a", None], lambda c: text.surrogate_key(c, F.lit(1)))
    assert got[0] == hashlib.md5(b"a-1").hexdigest() and got[0] != got[1]


def test_small_text_helpers(spark):
    assert column(spark, ["REMOTE - EU", "Berlin", None], text.looks_remote) == [True, False, False]
    assert column(spark, [" Go\t ", "A b"], text.fold_name) == ["go", "a b"]
    assert column(spark, ["50%_a", "50xya"], lambda c: text.contains_ignoring_case(c, "0%_A")) == [True, False]
    assert column(spark, ["  ", "x ", None], text.not_blank) == [None, "x ", None]


def test_parse_iso_against_the_standard_library(spark):
    rng = random.Random(5)
    days = ["2024-01-31", "20240131", "2024-02-30", "2024-1-1", "2024-13-01", "0000-01-01", "2024", "2024-05", "0001-01-01", "x"]
    seps = ["T", " ", "t", "/"]
    clocks = ["", "12", "12:30", "1230", "12:30:45", "123045", "12:3045", "1230:45", "12:30:45.1", "12:30:45,123456789", "24:00", "12:60",
              "23:59:59.999999", "12:30:60", "12:30:45."]
    zones = ["", "Z", "+02:00", "-0330", "+05", "+23:59", "+24:00", "+02:00:30", "+0200:30", "z", "+2"]
    values = {rng.choice(days) + rng.choice(seps) + rng.choice(clocks) + rng.choice(zones) for _ in range(6000)}
    values = sorted(v for v in values if not v.startswith("0001-01-01")) + ["2024-01-31", "", "2024-W05-3x", "2024-01-31Z"]

    def want(v):
        try:
            t = dt.datetime.fromisoformat(v.replace("Z", "+00:00"))
        except ValueError:
            return None
        t = t if t.tzinfo else t.replace(tzinfo=dt.UTC)
        return round((t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1))

    got = column(spark, values, lambda c: F.unix_micros(dates.parse_iso(c)))
    wrong = [(v, g, want(v)) for v, g in zip(values, got) if g != want(v)]
    assert not wrong, "\n".join(map(str, wrong))
    assert column(spark, [None], dates.parse_iso) == [None]


def test_epochs(spark):
    assert column(spark, [0, 1_700_000_000_123, 10**17], lambda c: F.unix_micros(dates.from_epoch_ms(c)), "long") == [
        0, 1_700_000_000_123_000, None]
    assert column(spark, [5], lambda c: F.unix_micros(dates.from_epoch_seconds(c)), "long") == [5_000_000]


def test_typed_json(spark):
    docs = ['{"a": "x"}', '{"a": 12345}', '{"a": 1.0}', '{"a": 1.5}', '{"a": 1e3}', '{"a": true}', '{"a": null}', "{}", "[1]", '"s"', "{bad",
            '{"a": {"b": "in"}}', '{"a": ""}', '{"a": 12345678901234567890123}', '{"a": -0.250}', '{"a": 100}', '{"a": 10.0}']
    parse = lambda c: F.try_parse_json(c)
    assert column(spark, docs, lambda c: json.get_id(parse(c), "$.a")) == [
        "x", "12345", "1", "1.5", "1000", None, None, None, None, None, None, None, "", "12345678901234567890123", "-0.25", "100", "10"]
    assert column(spark, docs, lambda c: json.get_str(parse(c), "$.a")) == ["x"] + [None] * 11 + [""] + [None] * 4
    assert column(spark, docs, lambda c: json.get_bool(parse(c), "$.a")) == [False] * 5 + [True] + [False] * 11
    assert column(spark, docs, lambda c: json.get_int(parse(c), "$.a"))[:4] == [None, 12345, None, None]
    assert column(spark, docs, lambda c: json.get_str(json.get_child(parse(c), "$.a"), "$.b"))[11] == "in"


def test_percent_rounds_like_python(spark):
    pairs = [(c, t) for t in (0, 1, 3, 7, 8, 16, 40, 80, 160, 200, 400, 1000, 2000, 999, 12345) for c in range(0, 2001, 7)]
    df = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(pairs)], "n int, c int, t long")
    got = [r.x for r in sorted(df.select("n", numbers.percent(F.col("c"), F.col("t")).alias("x")).collect())]
    want = [round(100 * c / t, 1) if t else 0.0 for c, t in pairs]
    assert [x for x in zip(pairs, got, want) if x[1] != x[2]] == []
