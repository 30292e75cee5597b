from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pytest

from demandweave.llm import order_minhash
from demandweave.llm.components import connected, joined
from demandweave.llm.order_minhash import keep_one, near_duplicates, similarity

SCHEMA = "doc_id long, text string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute_classes(rows, at_least=0.8):
    """Smallest id of each document's class, by comparing all pairs."""
    def shingles(text):
        w = (text or "").lower().split()
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    sets, part = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        m = lcs(a, b) if a and b else 0
        if (rows[i][1] or "") == (rows[j][1] or "") or (m and m / (len(a) + len(b) - m) >= at_least - 1e-12):
            part[root(j)] = root(i)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    return sorted((doc, min(groups[root(i)]), len(groups[root(i)])) for i, (doc, _) in enumerate(rows))


def edited(rnd, text, n):
    words = text.split()
    for _ in range(n):
        k = rnd.randrange(len(words))
        words[k : k + rnd.randint(0, 1)] = [f"new{rnd.random()}"]
    return " ".join(words)


def test_alignment_is_exact_from_the_threshold_on(rnd):
    for _ in range(800):
        a = [rnd.randint(0, 30) for _ in range(rnd.randint(1, 40))]
        b = list(a)
        for _ in range(rnd.randint(0, 6)):
            k = rnd.randint(0, len(b))
            b[k : k + rnd.randint(0, 1)] = [rnd.randint(0, 30)] * rnd.randint(0, 1)
        m = lcs(a, b)
        want = m / (len(a) + len(b) - m)
        got = similarity(np.array(a, np.uint32), np.array(b, np.uint32), 0.8)
        assert got == (pytest.approx(want) if want >= 0.8 else 0.0)


def test_classes_match_all_pairs(spark, rnd, prose):
    rows = []
    for _ in range(25):
        base = prose(rnd.choice([6, 30, 80, 150, 300]))
        rows += [(len(rows) + k, edited(rnd, base, rnd.choice([0, 0, 1, 2, 4, 8])) if k else base) for k in range(rnd.randint(1, 5))]
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())
    assert got == brute_classes(rows)


def test_order_counts(spark, prose):
    a, b = prose(60), prose(60)
    rows = [(1, f"{a} {b}"), (2, f"{b} {a}"), (3, f"{a} {b} end")]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_large_group_of_near_copies(spark, rnd, prose):
    base = prose(120)
    rows = [(i, edited(rnd, base, 1)) for i in range(400)] + [(1000 + i, prose(120)) for i in range(50)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.class_id for r in got if r.doc_id < 1000} == {0}
    assert all(r.class_id == r.doc_id and r.kept for r in got if r.doc_id >= 1000)
    assert [r.doc_id for r in got if r.kept and r.doc_id < 1000] == [0]


def test_star_of_copies_that_only_the_original_links(spark, rnd):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(320):
        copy = list(base)
        for quarter in range(4):  # each word replaced takes five shingles
            copy[50 * quarter + rnd.randint(5, 44)] = f"new{i}.{quarter}"
        texts.append(" ".join(copy))
    hashes = [np.array([hash(tuple(t.split()[i : i + 5])) & 0xFFFFFFFF for i in range(196)], np.uint32) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if similarity(hashes[i], hashes[j], 0.8)]
    assert sum(i == 0 for i, _ in links) == 320 and len(links) < 1.2 * 320
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {(r.class_id, r.class_size) for r in got} == {(680, 321)} and sum(r.kept for r in got) == 1


def test_every_pair_of_a_bucket_is_compared(spark, rnd, prose, monkeypatch):
    """Buckets that many tasks hold, with stars and unlike texts in one bucket each."""
    monkeypatch.setattr(order_minhash, "HOT", 3)
    shared, rows = prose(120), []
    for star in range(6):
        base = f"{shared} {prose(60)}"
        rows += [(100 * star + k, edited(rnd, base, 4) if k else base) for k in range(14)]
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute_classes(rows)


def test_shared_passage_is_no_copy(spark, prose):
    shared = prose(50)
    rows = [(i, f"{prose(100)} {shared} {prose(60)}") for i in range(120)]
    assert all(r.class_size == 1 for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())


def test_nulls_short_texts_and_repeats(spark, prose):
    text = prose(40)
    rows = [(1, None), (2, ""), (3, "two words"), (4, "two words"), (5, "Two words"), (None, text), (7, text), (7, text), (None, "alone in here")]
    got = sorted((repr(r.doc_id), repr(r.class_id), r.class_size, r.n_words) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    want = [(1, 1, 2, 0), (2, 1, 2, 0), (3, 3, 2, 2), (4, 3, 2, 2), (5, 5, 1, 2), (None, 7, 3, 40), (7, 7, 3, 40), (7, 7, 3, 40), (None, None, 1, 3)]
    assert got == sorted((repr(a), repr(b), c, d) for a, b, c, d in want)
    kept = keep_one(spark.createDataFrame([(*r, "en", 1) for r in rows], SCHEMA + ", node string, _x long")).collect()
    assert sorted((repr(r.doc_id), r.text) for r in kept) == sorted(
        [("1", None), ("3", "two words"), ("5", "Two words"), ("7", text), ("None", "alone in here")], key=lambda x: (x[0], x[1] or ""))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).collect() == [] and keep_one(empty).collect() == []


def test_components(spark, rnd):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    rnd.shuffle(edges)
    got = {r.node: r.part for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, **{i: 200 for i in (200, 201, 202)}}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []
    for cut in (0, 40, len(edges)):  # in two steps
        first, rest = [spark.createDataFrame(e, "a long, b long") for e in (edges[:cut], edges[cut:])]
        assert {r.node: r.part for r in joined(connected(first), rest).collect()} == got


def missed(similarity):
    """The chance that a pair shares fewer than COMMON sketches."""
    p, n = similarity**order_minhash.PICKED, order_minhash.SKETCHES
    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(order_minhash.COMMON))


def test_chance_of_a_lost_pair():
    assert order_minhash.SHINGLE == 5 and order_minhash.SIMILARITY == 0.8
    assert missed(0.8) < 3e-4 and missed(0.85) < 1e-6


def test_recall_in_large_groups(rnd, prose, spark, monkeypatch):
    """Links between unlike members of large groups: copies of copies, and texts around a long common passage."""
    monkeypatch.setattr(order_minhash, "LARGE", 16)
    rows, base = [], prose(160)
    for _ in range(120):  # a chain: each is an edit of an earlier one
        rows.append((len(rows), edited(rnd, rows[rnd.randrange(len(rows))][1] if rows and rnd.random() < 0.7 else base, rnd.randint(1, 5))))
    passage = prose(100)
    for _ in range(60):
        rest = prose(rnd.choice([10, 25, 50]))
        rows += [(len(rows) + k, f"{rest} {passage} {prose(3)}") for k in range(rnd.choice([1, 1, 2]))]
    want = brute_classes(rows)
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect())
    of = {d: c for d, c, _ in want}
    pairs = [(a, b) for a, b in combinations(sorted(of), 2) if of[a] == of[b]]
    found = {d: c for d, c, _ in got}
    recall = sum(found[a] == found[b] for a, b in pairs) / len(pairs)
    print(f"recall {recall:.4f} of {len(pairs)} pairs in {len(set(of.values()))} classes")
    assert recall >= 0.9 and all(of[a] == of[b] for a, b in combinations(sorted(found), 2) if found[a] == found[b])
    assert got == want


def test_texts_around_a_passage_are_not_compared(spark, rnd, prose, monkeypatch):
    """However many share it: their own shingles take them out before any pair is made."""
    monkeypatch.setattr(order_minhash, "LARGE", 8)
    compared = []
    monkeypatch.setattr(order_minhash, "_pairs", lambda rows, make=order_minhash._pairs: compared.append(make(rows)) or compared[-1])
    passage = prose(140)
    rows = [(i, f"{passage} {prose(60)}") for i in range(150)]
    assert all(r.class_size == 1 for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    after = sum(df.count() for df in compared[1:])
    print("pairs after the first member of each bucket:", after)
    assert after < 0.05 * 150 * 149 / 2  # what small buckets leave
