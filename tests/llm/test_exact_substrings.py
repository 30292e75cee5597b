from __future__ import annotations

import hashlib
import random

import pytest

from demandweave.llm.exact_substrings import dedup_substrings

SCHEMA = "doc_id long, text string"


def brute(texts, length):
    data, count = [(t or "").encode() for t in texts], {}
    for b in data:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    rows = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        rows.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return rows


def found(spark, rows, length=200):
    out = dedup_substrings(spark.createDataFrame(rows, SCHEMA).repartition(4), length).collect()
    return sorted((repr(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in out)


def expected(rows, length=200):
    return sorted((repr(i), *b) for (i, _), b in zip(rows, brute([t for _, t in rows], length)))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    rnd = random.Random(seed)
    letters = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    pool, rows = [letters(rnd.randint(150, 900)) for _ in range(10)], []
    for i in range(80):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            s = rnd.choice(pool)
            if rnd.random() < 0.5:
                s = s[rnd.randint(0, len(s) // 3) : len(s) - rnd.randint(0, len(s) // 3)]
            if rnd.random() < 0.5:
                k = rnd.randrange(len(s))
                s = s[:k] + "#" + s[k + 1 :]
            parts.append(s if rnd.random() < 0.6 else letters(rnd.randint(50, 500)))
        rows.append((i, "".join(parts)))
    assert found(spark, rows) == expected(rows)


def test_nulls_copies_and_periods(spark, prose):
    long = prose(3000)  # beyond the size that neighbours share a chunk with
    rows = [(None, None), (None, "x" * 300), (1, ""), (2, "ab" * 500), (3, prose(40)), (3, prose(40)), (4, long), (4, long),
            (5, "y" * 199), (6, "y" * 200), (7, long[:200] + "z"), (None, "x" * 300)]
    assert found(spark, rows) == expected(rows)


def test_edges_of_a_repeat(spark, prose):
    shared = prose(200)[:400]
    rows = [(i, f"{prose(30)}{shared[:n]}{prose(30)}") for i, n in enumerate([199, 200, 201, 215, 231, 399, 400])]
    assert found(spark, rows) == expected(rows)


def test_empty_table_and_extra_columns(spark):
    assert dedup_substrings(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "q" * 250, 5, "z")], SCHEMA + ", digit1 long, ranges string")
    assert dedup_substrings(df).first().n_removed == 250


def test_length_is_checked(spark):
    with pytest.raises(ValueError):
        dedup_substrings(spark.createDataFrame([], SCHEMA), 300)


def test_unlike_texts_under_one_doc_id(spark):
    """Texts of one doc_id are told apart by more than the 16 bits of their hash that a place has room for."""
    from pyspark.sql import functions as F
    rnd = random.Random(5)
    pool = [(7, "".join(rnd.choice("abcdefgh ") for _ in range(512))) for _ in range(3000)]
    keyed = spark.createDataFrame(pool, SCHEMA).withColumn("k", F.shiftrightunsigned(F.xxhash64(F.lit(7), "text"), 48)).collect()
    by: dict[int, list[str]] = {}
    for r in keyed:
        by.setdefault(r.k, []).append(r.text)
    a, b = next(v[:2] for v in by.values() if len(v) > 1)
    rows = [(7, a), (7, b), (8, a[100:400]), (None, b[:50]), (7, a[:10])]
    assert found(spark, rows) == expected(rows)
