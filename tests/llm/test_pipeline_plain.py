"""The rows of corpus_pipeline.run() against the same five stages in plain Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline

from test_order_minhash import brute_classes, edited
from test_packing_leaks_classifier import brute_alignment, brute_pack
from test_rules_and_lines import WORD, counts


def passes(text):
    text = text or ""
    n_words, chars, symbols, dup_lines, again = counts(text)
    lines = len([x for x in text.split("\n") if re.search(WORD, x)])
    exclamations, capitals = text.count("!"), len(re.findall("[A-Z]", text))
    return not (
        n_words < 10 or 100 * again > 20 * n_words or not 200 * n_words <= 100 * chars <= 1200 * n_words
        or 100 * symbols > 10 * n_words or 100 * exclamations > 30 * n_words or 100 * capitals > 40 * chars or 100 * dup_lines > 50 * lines)


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks(text, items):
    own = words(text)
    for item in items:
        w = words(item)
        if len(w) >= 3 and brute_alignment(own, w) >= max(0.4 * len(w), min(len(w), 6)):
            return True
    return False


def test_rows_match_plain_stages(spark, tmp_path, rnd, prose):
    common = " ".join(f"footer{i}" for i in range(9))  # a line of over 40 characters
    items = [(i, prose(rnd.randint(15, 30))) for i in range(6)] + [(7, "one of the"), (8, None)]
    rows = []

    def add(text, source):
        rows.append((len(rows), text, rnd.choice(["en", "de", None]), source, len(text or "")))

    for _ in range(30):
        add("\n".join([prose(rnd.randint(12, 60)), *([common] if rnd.random() < 0.4 else []), prose(rnd.randint(5, 40))]), rnd.choice(["a", "a", "b", None]))
    base = prose(200)
    add(base, "a")
    for _ in range(25):  # copies that only their original links
        add(edited(rnd, base, 4), "a")
    for k in range(6):
        add(f"{prose(30)} {edited(rnd, items[k][1], k % 3)} {prose(20)}", "b")
    for text in (None, "", "short text", "x " * 40, "LOUD!!! " * 20, base, prose(5000), "one of the " + prose(30)):
        add(text, "c")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [r for r in rows if passes(r[1])]
    assert {"LOUD!!! " * 20, "x " * 40, None, ""} & {r[1] for r in left} == set() and len(left) > 60
    cut = {r[0]: kept for r, kept in zip(left, plain_lines(left))}
    left = [(r[0], cut[r[0]], *r[2:]) for r in left]
    classes = {doc: first for doc, first, _ in brute_classes([(r[0], r[1]) for r in left])}
    left = [r for r in left if classes[r[0]] == r[0]]
    left = [r for r in left if not leaks(r[1], [t for _, t in items])]

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {r[0] for r in left}
    texts, sizes, pieces = {r[0]: r[1] for r in left}, Counter(), defaultdict(list)
    for r in got:
        sizes[r.doc_id] += r.n_words
        pieces[r.doc_id].append((r.first_word, r.n_words))
    n_words = {d: len(re.findall(WORD, t)) for d, t in texts.items()}
    assert sizes == n_words
    for d, parts in pieces.items():  # every word once, in full pieces and a rest
        at = 0
        for first, n in sorted(parts):
            assert first == at and n <= 2048
            at += n
        assert at == n_words[d]
    placed = [(r[0], r[3], None, n_words[r[0]]) for r in left]
    _, bins = brute_pack(placed, 2048)
    by_bin = defaultdict(list)
    for r in got:
        by_bin[r.bin_id].append(r)
    rests = [b for b in by_bin.values() if b[0].n_words < 2048]
    assert len(rests) <= bins + 1
    for members in by_bin.values():
        assert sum(r.n_words for r in members) <= 2048
        named = [r.source for r in members if r.source is not None and r.n_words < 2048]
        assert len(named) == len(set(named))


def plain_lines(rows):
    """The texts after line dedup."""
    keys = defaultdict(set)
    split = {r[0]: (r[1] or "").split("\n") for r in rows}
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    for d, lines in split.items():
        for line in lines:
            if len(key(line)) >= 40:
                keys[key(line)].add(d)
    gone = {k: max(ds) for k, ds in keys.items() if len(ds) >= 5}
    return ["\n".join(x for x in split[r[0]] if key(x) not in gone or gone[key(x)] == r[0]) for r in rows]
