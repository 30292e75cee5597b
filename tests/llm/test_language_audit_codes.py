"""Language ID, filter audit and vector codes against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
import zstandard

from demandweave.llm import language_id, vector_codes
from demandweave.llm.filter_audit import audit_filters, shapley_matrix
from demandweave.llm.language_id import Encoder, fit_dictionaries, identify_languages, predict
from demandweave.llm.queries import queries
from demandweave.llm.vector_codes import compress_vectors, nearest

FOLDER = "/root/testdata/sf0.01"


# --- language ID ---

SYLLABLES = {"aa": "ka ro mi te su na lo pi".split(), "bb": "sch ung ver ein lich zu gen haft".split(), "cc": "eau ien oux ez oir ette ais ment".split()}


def speech(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_held_out_languages_are_found(spark):
    got = queries()["op11_language_id"](spark, FOLDER).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and 0 <= r.margin for r in got) and {r.lang_pred for r in got} <= {"en", "de", "fr", "es", "und"}
    out = [r for r in got if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in out)
    longer = [r for r in out if len(docs[r.doc_id].text.split()) >= 10]
    print("held out:", right, "of", len(out))
    sure = [r.lang_pred == docs[r.doc_id].lang for r in longer if not r.rejected]
    assert right >= 0.95 * len(out) and len(sure) >= 0.9 * len(longer) and sum(sure) >= 0.99 * len(sure)


def test_sizes_are_those_of_whole_texts(rnd):
    """A plain loop over blocks with dictionaries that are not precomputed: nothing of a long text is left out."""
    books = {lang: speech(rnd, lang, 900).encode() for lang in SYLLABLES}
    encoder = Encoder(books)
    for n in (1, 5, 40, 3000):
        text = speech(rnd, "bb", n).encode()
        want = []
        for name in sorted(books):
            level = language_id.SHORT_LEVEL if len(text) < language_id.SHORT else language_id.LEVEL
            c = zstandard.ZstdCompressor(
                level=level, dict_data=zstandard.ZstdCompressionDict(books[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                write_content_size=False, write_checksum=False, write_dict_id=False)
            want.append(sum(len(c.compress(text[i : i + 4096])) for i in range(0, len(text), 4096)))
        got = encoder.sizes(text)
        assert len(got) == 3 and all(abs(a - b) <= 0.1 * b + 8 for a, b in zip(got, want)) and (n < 5 or min(got) == got[1])
    tail = speech(rnd, "aa", 20).encode() + b" " + speech(rnd, "cc", 4000).encode()
    assert encoder.judge(tail)[0] == "cc"


def test_only_rows_to_learn_from_count(spark, rnd):
    rows = [(i, speech(rnd, lang, 60), lang) for i, lang in enumerate(rnd.choice(list(SYLLABLES)) for _ in range(120))]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    lied = [(i, t, "zz" if i in held else lang) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    a, b = [sorted(tuple(r) for r in identify_languages(spark.createDataFrame(x, schema)).collect()) for x in (rows, lied)]
    assert a == b and all(r[2] == rows[r[0]][2] for r in a if not r[5]) and sum(r[5] for r in a) < 12
    moved = [(i, t, lang, f"src{i}", i, True) for i, t, lang in rows]
    c = identify_languages(spark.createDataFrame(moved, schema + ", source string, words long, held_out boolean"))
    assert sorted(tuple(r) for r in c.collect()) == a


def test_language_cases(spark, rnd):
    schema = "doc_id long, text string, lang string"
    known = [(i, speech(rnd, lang, 50), lang) for i, lang in enumerate(sorted(SYLLABLES) * 20)]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !? 34", "cc"), (None, speech(rnd, "aa", 30), None), (1003, speech(rnd, "cc", 60_000), None),
           (1004, "  \n\t ", None), (1005, "a", None), (1005, "a", None)]
    got = identify_languages(spark.createDataFrame(known + odd, schema)).collect()
    assert len(got) == len(known) + len(odd)
    by = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 1000}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1004)] == ["und"] * 4 and all(by[i].rejected and by[i].score == 0 for i in (1000, 1001, 1002, 1004))
    assert by[None].lang_pred == "aa" and not by[None].held_out and by[1003].lang_pred == "cc"
    assert sum(r.doc_id == 1005 for r in got) == 2 and by[1005].lang_pred in SYLLABLES
    empty = spark.createDataFrame([], schema)
    assert identify_languages(empty).collect() == [] and fit_dictionaries(empty) == {}
    assert [r.lang_pred for r in predict(spark.createDataFrame(odd[4:5], schema), {}).collect()] == ["und"]
    assert [r.margin for r in predict(spark.createDataFrame(odd[4:5], schema), {"cc": b"x"}).collect()] == [1.0]


def test_dictionaries_are_bounded_and_hold_copies_once(spark, rnd):
    rows = [("aa", speech(rnd, "aa", 300)) for _ in range(300)] + [("bb", "immer das gleiche")] * 500 + [("bb", speech(rnd, "bb", 9))]
    books = fit_dictionaries(spark.createDataFrame(rows, "lang string, text string"))
    assert len(books["aa"]) == language_id.DICTIONARY_BYTES
    assert books["bb"].count(b"immer das gleiche") == 1


# --- filter audit ---

def plain_audit(rows, labels):
    """Every document through every order, one after the other."""
    fails, parts = [], set()
    for doc, text, source in rows:
        t, part = text or "", source or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        f = set()
        if len(words) < 50:
            f.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            f.add("C")
        if set(t) & set("#$%&*|"):
            f.add("D")
        if doc is not None and any(d is not None and d < doc and (x or "") == t for d, x, _ in rows):
            f.add("E")
        parts.add(part)
        good = any(d == doc and q == 1 for d, q, _ in labels if d is not None)
        toxic = any(d == doc and x == 1 for d, _, x in labels if d is not None)
        fails.append((part, f, good, toxic))
    out, total = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        left = Counter(p for p, *_ in fails)
        for step, letter in enumerate(order, 1):
            c = Counter()
            for part, f, good, toxic in fails:
                if letter in f:
                    first = f & set(order[: step - 1])
                    c[part, "redundant" if first else "removed"] += 1
                    c[part, "unique"] += len(f) == 1
                    if not first:
                        c[part, "good"] += good
                        c[part, "toxic"] += toxic
            for part in parts:
                left[part] -= c[part, "removed"]
                total[part, letter] += c[part, "removed"]
                out[part, order, step] = [left[part], *(c[part, k] for k in ("removed", "redundant", "unique", "good", "toxic"))]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_matches_a_plain_loop(spark, rnd):
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        n = rnd.choice([0, 3, 45, 50, 60, 90])
        text = " ".join(rnd.choice(words) if rnd.random() < 0.5 else f"x{rnd.random()}" for _ in range(n))
        text = rnd.choice([text, text.upper(), f"{text} #", f"{text}\n\t|", text + "\xa0Ä"])
        rows.append((i, text, rnd.choice(["a", "b", None])))
    rows += [(200 + i, rows[rnd.randrange(30)][1], rnd.choice(["a", "b", "c"])) for i in range(60)]
    rows += [(None, rows[3][1], "a"), (None, None, "d"), (400, None, "d"), (401, "", "d"), (5, rows[5][1], "a"), (402, "w " * 20000, "d"), (403, "É#" * 9, "")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 1), (4, 1, 0), (9999, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, source string, mask int, part string, n int").repartition(5)
    named = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit_filters(docs, named).collect()}
    assert got == plain_audit(rows, labels)


def test_audit_cases(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a b", "s")], "doc_id long, text string, source string")
    got = audit_filters(docs).filter("filter_order = 'EABCD'").orderBy("step").collect()
    assert [(r.kept, r.removed, r.redundant, r.shapley) for r in got] == [(1, 1, 0, 60), (0, 1, 1, 180), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert audit_filters(docs.limit(0)).collect() == []
    only = {"X": __import__("pyspark.sql.functions", fromlist=["x"]).col("t").startswith("a")}
    got = audit_filters(docs, filters=only).collect()
    assert len(got) == 4 and {r.shapley for r in got if r.filter_order[r.step - 1] == "X"} == {3}


def test_shapley_solution_is_exact(rnd):
    for n in (2, 3, 5):
        m = shapley_matrix(n)
        for _ in range(5):
            v = [0] + [rnd.randint(-50, 50) for _ in range((1 << n) - 1)]
            for i in range(n):
                want = Fraction(0)
                for order in permutations(range(n)):
                    before = sum(1 << j for j in order[: order.index(i)])
                    want += v[before | 1 << i] - v[before]
                assert sum(a * b for a, b in zip(m[i], v)) == want / math.factorial(n)


# --- vector codes ---

def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    size = width // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * size : (p + 1) * size] for _, v, _ in first] for p in range(parts)]

    def assign(v, p):
        own = v[p * size : (p + 1) * size]
        return min((sum((a - b) ** 2 for a, b in zip(own, c)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(assign(v, p)[1], []).append(v[p * size : (p + 1) * size])
            moved.append([[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else c for k, c in enumerate(books[p])])
        books = moved
    out = []
    for i, v, label in kept:
        best = [assign(v, p) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    totals = Counter()
    for _, label, _, e in out:
        totals[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, totals[label]) for i, label, c, e in out), key=repr), sha


def codes_of(df, **options):
    coded, books = compress_vectors(df, **options)
    return sorted(((r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in coded.collect()), key=repr), books.sha256()


SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(rnd, n, width=32, scale=0.1):
    return [[float(np.float32(rnd.gauss(0, scale))) for _ in range(width)] for _ in range(n)]


def test_codes_match_a_plain_loop(spark, rnd):
    data = vectors(rnd, 220)
    rows = [(1000 - i, v, rnd.choice([1, 2, None])) for i, v in enumerate(data)]
    rows += [(5, None, 1), (6, [0.5, None] + [0.0] * 30, 1), (7, [float("nan")] + [0.0] * 31, 2), (8, [float("-inf")] + [0.0] * 31, 2)]
    rows += [(9, data[0], 1), (9, data[1], 1), (None, data[2], None), (None, data[3], 1), (2000, data[4], 2), (2001, data[4], 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", v string, error int").repartition(5)
    assert codes_of(df) == plain_codes(rows)
    assert codes_of(df, parts=4, entries=7, rounds=5) == plain_codes(rows, 4, 7, 5)


def test_few_rows_odd_lengths_and_large_numbers(spark, rnd):
    short = [(i, [float(x) for x in range(i)], i % 2) for i in range(1, 20)] + [(30, [], None)]
    assert codes_of(spark.createDataFrame(short, SCHEMA)) == plain_codes(short)
    same = [(i, [0.25] * 16, 1) for i in range(90)]
    got = codes_of(spark.createDataFrame(same, SCHEMA))
    assert got == plain_codes(same) and {c for _, c, *_ in got[0]} == {"00" * 16}
    huge = [(i, [rnd.choice([1e300, -1e200, 0.5, 3e18]) * rnd.random() for _ in range(16)], 1) for i in range(70)]
    wide = "vec_id long, embedding array<double>, label int"
    most = (1 << 63) - 1
    want, sha = plain_codes(huge)
    assert codes_of(spark.createDataFrame(huge, wide)) == (sorted(((i, c, min(e, most), min(t, most)) for i, c, e, t in want), key=repr), sha)
    empty = codes_of(spark.createDataFrame([], SCHEMA))
    assert empty == ([], hashlib.sha256(b"").hexdigest())
    assert codes_of(spark.createDataFrame([(1, None, 1)], SCHEMA))[0] == []


def test_nearest_ties_take_the_lower_index():
    books = np.array([[[0], [2], [2]]])
    codes, error = nearest(np.array([[1], [2], [5]]), books)
    assert codes.tolist() == [[0], [1], [1]] and error.tolist() == [1, 0, 9]


@pytest.mark.parametrize("cells", [1, 100])
def test_small_pieces_change_nothing(spark, rnd, monkeypatch, cells):
    monkeypatch.setattr(vector_codes, "CELLS", cells)
    rows = [(i, v, 1) for i, v in enumerate(vectors(random.Random(3), 80, 16))]
    assert codes_of(spark.createDataFrame(rows, SCHEMA)) == plain_codes(rows)
