"""Near-duplicate texts by Order MinHash, verified by banded alignment.

A sketch takes the ``PICKED`` smallest of a document's occurrence-labelled shingles under one hash
order and keeps them in the order in which the text has them. Two texts share a sketch only if
they share these shingles *and* their order, which follows edit similarity where a plain MinHash
follows only the sets. Texts with a common sketch are candidates; a banded alignment of their
shingles decides.

Similarity: m shingles of one text aligned to equal ones of the other, in order and one to one,
make m / (shingles of both - m); 0.8 with shingles of five words unless told otherwise.

Few picked shingles make a sketch that texts share by chance of a common passage; so many are picked,
and there are many sketches of which two texts must share ``COMMON``: a pair of similarity 0.8 has 12
of 72 in common, one of 0.6 has one.

A bucket of n texts is not turned into pairs. Its members are compared with one of them, which joins
most copies. Of large buckets that stay in several parts (texts that share a long passage and little
else), texts then go that have more than 1 - t of their shingles for themselves: they can't reach the
similarity t with any other, however many share the rest. What is left goes on in blocks: some members
of a bucket (heads) are compared with all others that are still apart, until each member of a bucket
with several parts has been a head. A pair meets in the first of its common buckets only, and not if
lengths and shared shingles rule it out. So the classes are those of all pairs that share ``COMMON``
sketches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandweave.llm.arrays import WORD_BYTES, Chunk, Slices, chunks, mixed, words
from demandweave.llm.components import connected, joined
from demandweave.llm.staging import free_names, settle

SHINGLE = 5
SKETCHES = 72
PICKED = 8
COMMON = 3  # sketches that a pair must share
SIMILARITY = 0.8
LARGE = 64  # of a bucket with more texts, in several parts, texts are looked at for shingles of their own
BLOCK = 200_000  # shingles that are counted together
HOT = 50_000  # memberships of a bucket that one task may hold

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased), and where each document's words begin."""
    lower = chunk._replace(data=_LOWER[chunk.data])
    found = words(lower, WORD_BYTES)
    return Slices(lower.data).hashes(found.starts, found.ends), found.bounds


def shingle_hashes(word: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``width`` consecutive words within a document, and where each document's begin."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    n = max(0, len(word) - width + 1)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h += word[j : j + n] * _ODD[j]
    own = np.repeat(np.arange(len(counts)), counts)
    return mixed(h[np.arange(len(own)) - starts[own] + bounds[own]]), starts


def occurrence_labelled(shingle: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash of each shingle together with its occurrence number in the document."""
    own = np.repeat(np.arange(len(starts) - 1), np.diff(starts)).astype(np.uint64)
    key = mixed(shingle + own * _ODD[100])
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    place = np.arange(len(key))
    number = np.empty(len(key), np.uint64)
    number[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    return mixed(shingle + number * _ODD[101])


def order_sketches(shingle: np.ndarray, starts: np.ndarray, sketches: int, picked: int) -> np.ndarray:
    """(sketches, documents): hash of the ``picked`` smallest labelled shingles in text order.

    Documents without a shingle have no meaningful value.
    """
    docs = np.diff(starts)
    some = np.flatnonzero(docs > 0)
    out = np.zeros((sketches, len(docs)), np.uint64)
    if not len(some):
        return out
    labelled = occurrence_labelled(shingle, starts)
    bits = np.uint64(max(1, len(shingle).bit_length()))
    first, place, size = starts[:-1][some], np.arange(len(shingle), dtype=np.uint64), docs[some]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for s in range(sketches):
        h = (labelled ^ _ODD[s]) * _ODD[s + 64]
        h ^= h >> np.uint64(32)
        h *= _ODD[s + 128]
        h = (h >> bits << bits) | place
        chosen = np.empty((picked, len(some)), np.int64)
        for p in range(picked):
            least = np.minimum.reduceat(h, first)
            chosen[p] = np.where(size > p, (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), -1)
            if p + 1 < picked:
                h[chosen[p][chosen[p] >= 0]] = top
        chosen.sort(axis=0)
        value = np.full(len(some), s + 1, np.uint64)
        for p in range(picked):
            value = mixed(value * _ODD[200] + np.where(chosen[p] >= 0, shingle[chosen[p]], np.uint64(0)))
        out[s, some] = value
    return out


def aligned_shingles(a: list[int], b: list[int], most_apart: int) -> int:
    """Longest common subsequence of ``a`` and ``b``, within a band around the diagonal.

    Exact if at most ``most_apart`` elements of both are left over, else a lower bound. One bit
    stands for a row of the band; a column costs a few operations on whole numbers.
    """
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    width = 2 * most_apart + 1
    full = (1 << width) - 1
    found, low, band = 0, -most_apart, full  # a 0 bit is a matched row; rows below 0 never match
    for x in b:
        match = 0
        for i in places.get(x, ()):
            if 0 <= i - low < width:
                match |= 1 << (i - low)
        if match:
            both = band & match
            band = ((band + both) | (band - both)) & full
        found += 1 - (band & 1)  # this row leaves the band
        low += 1
        band = band >> 1 | 1 << (width - 1)
    return found + width - bin(band).count("1")


def similarity(a: np.ndarray, b: np.ndarray, at_least: float) -> float:
    """Aligned shingles over all shingles; 0.0 stands for anything below ``at_least``."""
    total = len(a) + len(b)
    need = int(np.ceil(at_least * total / (1 + at_least) - 1e-9))  # aligned shingles for at_least
    if min(len(a), len(b)) < need or not total:
        return 0.0
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    tail = n if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    m = head + tail
    if m + min(len(a), len(b)) < need:
        return 0.0
    if len(a) and len(b):
        m += aligned_shingles(a.tolist(), b.tolist(), total - 2 * need)
    return m / (total - m) if m >= need else 0.0


def _sketches(shingle: int, sketches: int, picked: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                word, bounds = word_hashes(chunk)
                hashes, starts = shingle_hashes(word, bounds, shingle)
                n = len(starts) - 1
                values = order_sketches(hashes, starts, sketches, picked).T.copy()
                keep = np.diff(starts) > 0
                sizes = np.where(keep, sketches, 0)
                own = batch.slice(chunk.first, n)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                flat = values[keep].reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [own.column("c1"), own.column("c2"), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64)))],
                    ["c1", "c2", "n_words", "sketches"])

    return task


def _sequences(shingle: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                word, bounds = word_hashes(chunk)
                hashes, starts = shingle_hashes(word, bounds, shingle)
                small = (hashes >> np.uint64(32)).astype(np.uint32)
                own = batch.slice(chunk.first, len(starts) - 1)
                yield pa.RecordBatch.from_arrays(
                    [own.column("c1"), own.column("c2"),
                     pa.array([small[starts[i] : starts[i + 1]].tobytes() for i in range(len(starts) - 1)], pa.binary())],
                    ["c1", "c2", "shingles"])

    return task


def _label_blocks(blocks: int):
    """Labelled shingles in ``blocks`` by hash: one row per batch and block with the shingles that stand in one
    text of the batch, beside that text, and those that stand in several, each once without a text."""
    kind = pa.list_(pa.int64())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column("shingles")]
            if not shingles:
                continue
            sizes = np.array([len(x) for x in shingles], np.int64)
            labels = occurrence_labelled(np.concatenate(shingles).astype(np.uint64), np.concatenate([[0], np.cumsum(sizes)]))
            label, first, times = np.unique(labels, return_index=True, return_counts=True)
            text = np.where(times == 1, np.repeat(np.arange(len(sizes)), sizes)[first], -1) if len(label) else np.zeros(0, np.int64)
            h1, h2 = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("c1", "c2")]
            block = (label >> np.uint64(32)).astype(np.int64) % blocks
            order = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[order], np.arange(blocks + 1))
            for k in range(blocks):
                own = order[cuts[k] : cuts[k + 1]]
                if len(own):
                    one = text[own] >= 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int64())] + [pa.array([v], kind) for v in (
                            label[own[~one]].view(np.int64), label[own[one]].view(np.int64), h1[text[own[one]]], h2[text[own[one]]])],
                        ["block", "several", "single", "h1", "h2"])

    return task


def _alone(table: pa.Table) -> pa.Table:
    """How many of the shingles of a block stand in one text only, by text."""
    several, single, h1, h2 = [
        np.concatenate([np.asarray(x.values, np.int64) for x in table.column(c).combine_chunks()] or [np.zeros(0, np.int64)])
        for c in ("several", "single", "h1", "h2")]
    label, first, times = np.unique(np.concatenate([single, several]), return_index=True, return_counts=True)
    own = first[(times == 1) & (first < len(single))]
    nodes, n = np.unique(np.stack([h1[own], h2[own]], 1), axis=0, return_counts=True)
    return pa.table({"h1": pa.array(nodes[:, 0]), "h2": pa.array(nodes[:, 1]), "alone": pa.array(n.astype(np.int64))})


def _verify(at_least: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = pa.array([
                similarity(np.frombuffer(a.as_buffer(), np.uint32), np.frombuffer(b.as_buffer(), np.uint32), at_least) > 0
                for a, b in zip(batch.column("sa"), batch.column("sb"))
            ], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(links) for c in _PAIR], _PAIR)

    return task


_PAIR = ["a1", "a2", "b1", "b2"]


def content_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text; NULL counts as ''."""
    content = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(content), F.xxhash64(F.lit(1), content)


def _node(prefix: str) -> Column:
    return F.struct(F.col(f"{prefix}1").alias("h1"), F.col(f"{prefix}2").alias("h2"))


def _apart(members: DataFrame, parts: DataFrame) -> DataFrame:
    """The memberships of buckets that hold several parts, each with the part of its node."""
    placed = members.drop("part").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    several = placed.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q")
    return placed.join(several.select("bucket"), "bucket")


def _without_own_shingles(apart: DataFrame, sequences: DataFrame, at_least: float) -> DataFrame:
    """``apart`` without texts in large buckets that can have no partner there. ``common``: the most
    shingles that a text may share with another text of the bucket.

    Shingles are counted over all texts in large buckets, so one that occurs once is in no other. They
    are counted in blocks by hash; one that many texts hold enters its block once a batch.
    """
    large = settle(apart.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > LARGE).select("bucket"))
    of_large = apart.join(large, "bucket")
    nodes = settle(of_large.select("node", "size").distinct())
    blocks = max(1, -(-(nodes.agg(F.sum("size")).first()[0] or 0) // BLOCK))
    own = sequences.join(nodes.select(F.col("node.h1").alias("c1"), F.col("node.h2").alias("c2")), ["c1", "c2"])
    labels = own.mapInArrow(_label_blocks(blocks), "block long, several array<long>, single array<long>, h1 array<long>, h2 array<long>")
    alone = labels.groupBy("block").applyInArrow(_alone, "h1 long, h2 long, alone long")
    alone = settle(alone.groupBy(F.struct("h1", "h2").alias("node")).agg(F.sum("alone").alias("alone")))
    common = F.col("size") - F.coalesce("alone", F.lit(0))
    kept = of_large.join(alone, "node", "left").withColumn("common", common).filter(F.col("common") >= F.col("size") * at_least - 1e-6)
    return apart.join(large, "bucket", "left_anti").unionByName(kept.drop("alone"))


def _levelled(members: DataFrame, own: DataFrame) -> DataFrame:
    """``members`` with the ``level`` in which a node is a head, in all its buckets at once.

    Nodes with the most neighbours in their buckets come first. At most 32, 1,024 ... nodes of a
    bucket are heads up to level 0, 1 ... (times its ``salts``, which split a hot bucket).
    ``own``: (node, own), the sketches of each node in order; they are added.
    """
    counted = members.join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket")
    salted = counted.withColumn("score", F.sum("n").over(Window.partitionBy("node"))).withColumn(
        "salts", F.ceil(F.col("n") / HOT)).withColumn("salt", F.pmod(F.xxhash64("node"), "salts"))
    place = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy(F.desc("score"), "node"))
    level = ((F.length(F.bin(place)) - 1) / 5).cast("int")
    levelled = salted.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy("node"))).drop("n", "score")
    return levelled.join(own, "node")


def text_classes(
    docs: DataFrame, shingle: int = SHINGLE, at_least: float = SIMILARITY, sketches: int = SKETCHES,
    picked: int = PICKED, common: int = COMMON, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per different text: c1, c2 (``content_key``), n_words and what ``near_duplicates`` says
    of its class: class_size, class_id, first (d, c1, c2: the row that stays)."""
    c1, c2 = content_key(F.col(text))
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), c1.alias("c1"), c2.alias("c2"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sketched = settle(
        keyed.select("c1", "c2", "text").mapInArrow(
            _sketches(shingle, sketches, picked), "c1 long, c2 long, n_words long, sketches array<long>")
        .dropDuplicates(["c1", "c2"])
    )
    members = sketched.select("c1", "c2", "n_words", F.explode("sketches").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("c1", "c2")).alias("r")).filter("n > 1")
    members = settle(members.join(shared, "bucket"))
    pairs = settle(_pairs(members.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"),
                                         F.col("r.c1").alias("b1"), F.col("r.c2").alias("b2"))))
    wanted = members.select("c1", "c2").distinct()
    texts = keyed.select("c1", "c2", "text").join(wanted, ["c1", "c2"]).groupBy("c1", "c2").agg(F.first("text").alias("text"))
    sequences = settle(texts.mapInArrow(_sequences(shingle), "c1 long, c2 long, shingles binary"))

    def verified(candidates: DataFrame) -> DataFrame:
        a = sequences.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("shingles").alias("sa"))
        b = sequences.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("shingles").alias("sb"))
        # The shorter text has at_least of the shingles of the longer one, or the pair is none.
        near = F.least(F.length("sa"), F.length("sb")) >= F.greatest(F.length("sa"), F.length("sb")) * at_least
        rows = candidates.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).filter(near)
        return rows.mapInArrow(_verify(at_least), "a1 long, a2 long, b1 long, b2 long")

    links = settle(verified(pairs))
    parts = connected(links.select(_node("a").alias("a"), _node("b").alias("b")))
    size = F.col("n_words") - (shingle - 1)
    placed = members.select(
        "bucket", size.alias("size"), _node("c").alias("node"), size.alias("common"),
        F.struct(F.col("r.c1").alias("h1"), F.col("r.c2").alias("h2")).alias("r"))
    apart = settle(_without_own_shingles(settle(_apart(placed, parts)), sequences, at_least))
    own = sketched.select(_node("c").alias("node"), F.col("sketches").alias("own"))
    apart, level = settle(_levelled(_apart(apart, parts), own)), 0
    while (last := apart.agg(F.max("level")).first()[0]) is not None:
        heads = apart.filter(F.col("level") == level).select(
            "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
            F.col("node").alias("a"), F.col("part").alias("p"), F.col("size").alias("n"), F.col("common").alias("m"), F.col("own").alias("o"))
        # A pair meets when the first of both is a head, of two heads of one level once; those with r have been compared.
        most, shared = F.least("common", "m"), F.array_intersect("own", "o")
        more = heads.join(apart.filter(F.col("level") >= level), ["bucket", "salt"]).filter(
            (F.col("part") != F.col("p")) & ((F.col("level") > level) | (F.col("a") < F.col("node")))
            & (F.col("node") != F.col("r")) & (F.col("a") != F.col("r"))
            & (F.least("size", "n") >= F.greatest("size", "n") * at_least)
            & (most >= (F.col("size") + F.col("n") - most) * at_least - 1e-6)
            & (F.size(shared) >= common) & (F.get(shared, F.lit(0)) == F.col("bucket")))
        more = settle(_pairs(more.select(
            F.col("a.h1").alias("a1"), F.col("a.h2").alias("a2"), F.col("node.h1").alias("b1"), F.col("node.h2").alias("b2"))))
        found = settle(verified(more))
        parts = joined(parts, found.select(_node("a").alias("a"), _node("b").alias("b")))
        if level == last:
            break
        apart, level = settle(_apart(apart.filter(F.col("level") > level), parts)), level + 1

    node = F.struct(F.col("c1").alias("h1"), F.col("c2").alias("h2"))
    ids = keyed.select("doc_id", "c1", "c2")
    nodes = ids.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("d")).withColumn("node", node)
    nodes = nodes.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    classes = nodes.groupBy("part").agg(
        F.sum("n").alias("class_size"), F.min("d").alias("class_id"),
        F.min(F.struct(F.col("d").isNull(), "d", "c1", "c2")).alias("first"))
    return nodes.select("c1", "c2", "part").join(classes, "part").drop("part").join(sketched.select("c1", "c2", "n_words"), ["c1", "c2"])


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, at_least: float = SIMILARITY, sketches: int = SKETCHES,
    picked: int = PICKED, common: int = COMMON, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Class of each document: one row per row of ``docs`` with doc_id, class_id, class_size, n_words, kept.

    Classes are the connected parts of links between texts of similarity ``at_least`` or more.
    class_id is the smallest doc_id of the class, class_size its number of rows. ``kept`` is true
    for the rows with that doc_id whose text is the smallest by hash among such rows.

    * Equal texts are one node, so copies (also under equal or NULL doc_ids) cost nothing more.
    * A text with fewer than ``shingle`` words (NULL and '' have none, and are equal) links to
      exact copies only.
    * NULL doc_ids are last in order; a class of NULL doc_ids only has the class_id NULL.
    * Words are compared without regard to the case of A-Z. Other columns are ignored.
    * A pair of similarity 0.8 shares fewer than 3 of 72 sketches, and is then not compared, with a chance of
      about 2e-4; at 0.85 that is below 1e-6.
    """
    classes = text_classes(docs, shingle, at_least, sketches, picked, common, doc_id, text)
    c1, c2 = content_key(F.col(text))
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), c1.alias("c1"), c2.alias("c2"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.d")) & (F.col("c1") == F.col("first.c1")) & (F.col("c2") == F.col("first.c2"))
    return ids.join(classes, ["c1", "c2"]).select("doc_id", "class_id", "class_size", "n_words", kept.alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, each once; ``options`` are its parameters.

    Of rows with equal doc_id and text any one stays: they may differ in other columns only.
    """
    classes = text_classes(docs, doc_id=doc_id, text=text, **options)
    no_id = F.lit(-(1 << 63))
    key = free_names(docs.columns, "c1", "c2", "d")
    first = classes.select("first.*").distinct().select(
        F.col("c1").alias(key[0]), F.col("c2").alias(key[1]), F.coalesce("d", no_id).alias(key[2]))
    own = [*content_key(F.col(text)), F.coalesce(F.col(doc_id).cast("long"), no_id)]
    keyed = docs.select("*", *[c.alias(k) for c, k in zip(own, key)])
    return keyed.join(first, key).dropDuplicates(key).select(*[F.col(f"`{c}`") for c in docs.columns])


def _pairs(rows: DataFrame) -> DataFrame:
    """Each unordered pair of different nodes once, the smaller one as b."""
    swap = F.struct("a1", "a2") < F.struct("b1", "b2")
    a, b = [F.struct(F.col(f"{p}1").alias("h1"), F.col(f"{p}2").alias("h2")) for p in "ab"]
    high, low = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    return rows.filter("a1 <> b1 or a2 <> b2").select(
        high["h1"].alias("a1"), high["h2"].alias("a2"), low["h1"].alias("b1"), low["h2"].alias("b2")).distinct()
