"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that starts twice or more.

The suffixes are ordered by a most-significant-digit radix sort that ends at depth ``length``:
whatever is still equal there is a repeated string, so the order beyond never matters. Suffixes
of one digit are a hash group, groups of one are dropped, and only the others go on to the next
digit. Two things keep the rows few:

* The bytes of a window are read from its *anchor* on, the smallest 8-gram (by a hash) among its
  first ``SPREAD``; equal windows have it at the same offset. A fixed order of the bytes of a
  window is as good for a radix sort as left to right, and neighbouring windows share the anchor,
  hence the first digit. So a row stands for a *run* of windows with one anchor.
* A run that repeats as a whole needs no look at its windows; only runs at the edge of a repeat
  are split, into pieces of ``PIECE`` windows and then into single windows.

Digits: (1) the bytes behind the anchor that all windows of any run have, (2) all bytes of the
run, (3) the bytes common to a piece, then all of the piece, (4) the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandweave.llm.arrays import Chunk, Slices, chunks, mixed
from demandweave.llm.staging import settle

LENGTH = 200
SEED_BYTES = 8
SPREAD = 144
PIECE = 16

# A place in one long: 16 bits of the text's hash, start of the run, windows in it, offset of the anchor.
_SALT, _START, _COUNT = 47, 16, 8
_START_MASK = (1 << (_SALT - _START)) - 1
_PLACE_BITS = _SALT - _START  # of a place in a chunk


def anchor_runs(chunk: Chunk, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, first window in the text, windows, offset of the
    anchor from the first window, digits 1 and 2."""
    data, bounds, spread = np.ascontiguousarray(chunk.data), chunk.starts, min(SPREAD, length - SEED_BYTES + 1)
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return (none,) * 6
    bits = _PLACE_BITS  # the same in every chunk: equal windows take equal anchors wherever they stand
    key = np.ndarray((n - SEED_BYTES + 1,), "<u8", data, 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    key >>= np.uint64(bits)
    key <<= np.uint64(bits)
    key |= np.arange(len(key), dtype=np.uint64)  # of equal ones the first counts
    reach = 1
    while reach < spread:
        step = min(reach, spread - reach)
        key = np.minimum(key[:-step], key[step:])
        reach += step
    last = np.repeat(bounds[1:], np.diff(bounds))[: n - length + 1]
    windows = np.flatnonzero(np.arange(n - length + 1) + length <= last)  # windows within one text
    if not len(windows):
        return (none,) * 6
    at = (key[windows] & np.uint64((1 << bits) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    start, anchor, count = windows[new], at[new], np.diff(np.concatenate([new, [len(windows)]]))
    s = Slices(data)
    digit1 = s.hashes(anchor, anchor + (length - spread + 1))
    digit2 = s.hashes(start, start + (count - 1 + length)) + (anchor - start).astype(np.uint64)
    row = np.searchsorted(bounds, start, "right") - 1
    return row + chunk.first, start - bounds[row], count, anchor - start, digit1.view(np.int64), digit2.view(np.int64)


def _runs(length: int):
    schema = pa.schema([(c, pa.int64()) for c in ("digit1", "digit2", "ref", "place")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ref = batch.column("ref").to_numpy(zero_copy_only=False)
            salt = batch.column("salt").to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column("text")):
                row, start, count, lead, digit1, digit2 = anchor_runs(chunk, length)
                place = salt[row] << _SALT | start << _START | (count - 1) << _COUNT | lead
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (digit1, digit2, ref[row], place)], schema=schema)

    return task


def _contexts(length: int):
    schema = pa.schema([("digit1", pa.int64()), ("ref", pa.int64()), ("place", pa.int64()),
                        ("copies", pa.int64()), ("bytes", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ref, text, runs in zip(*(batch.column(c) for c in ("ref", "text", "runs"))):
                data, runs = memoryview(text.as_buffer()), runs.as_py()
                for i in range(0, len(runs), 10_000):
                    part = runs[i : i + 10_000]
                    cut = []
                    for r in part:
                        start, count = r["place"] >> _START & _START_MASK, (r["place"] >> _COUNT & 255) + 1
                        cut.append(bytes(data[start : start + count - 1 + length]))
                    columns = [pa.array([r["digit1"] for r in part], pa.int64()), pa.array([ref.as_py()] * len(part), pa.int64()),
                               pa.array([r["place"] for r in part], pa.int64()), pa.array([r["copies"] for r in part], pa.int64()),
                               pa.array(cut, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return task


def _pieces(length: int, size: int, given: bool):
    """Pieces of at most ``size`` windows, cut at multiples of ``size`` of the anchor's offset.

    ``given``: only of the pieces in the column ``wanted``, as single windows.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("digit1", "ref", "place", "copies", "piece", "core", "whole", "low", "high")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place_all = batch.column("place").to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column("bytes")):
                rows = np.arange(chunk.first, chunk.first + len(chunk.starts) - 1)
                place = place_all[rows]
                high, count = place & 255, (place >> _COUNT & 255) + 1
                low, anchor = high - count + 1, chunk.starts[:-1] + high
                if given:
                    wanted = batch.column("wanted").slice(chunk.first, len(rows))
                    own = np.repeat(np.arange(len(rows)), np.diff(wanted.offsets.to_numpy()))
                    piece = wanted.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                else:
                    pieces = high // size - low // size + 1
                    own = np.repeat(np.arange(len(rows)), pieces)
                    piece = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + (low // size)[own]
                if not len(own):
                    continue
                first = np.maximum(piece * size, low[own])
                last = np.minimum(piece * size + size - 1, high[own])
                if given:  # each window is a piece of its own
                    each = last - first + 1
                    again = np.repeat(np.arange(len(own)), each)
                    offset = np.arange(len(again)) - np.repeat(np.cumsum(each) - each, each) + first[again]
                    own, piece, first, last = own[again], offset, offset, offset
                a, s = anchor[own], Slices(chunk.data)
                whole = s.hashes(a - last, a - first + length)
                if given:
                    core = whole
                else:  # the common bytes of any piece with this number, whether it is complete or not
                    core = s.hashes(a - piece * size, a - (piece * size + size - 1) + length)
                    whole = mixed(whole + (first << 8 | last).astype(np.uint64))
                row = rows[own]
                columns = [batch.column("digit1").take(pa.array(row)), batch.column("ref").take(pa.array(row)), place[own],
                           batch.column("copies").take(pa.array(row)), piece, core.view(np.int64), whole.view(np.int64), first, last]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)

    return task


_PIECE_ROW = "digit1 long, ref long, place long, copies long, piece long, core long, whole long, low long, high long"


def _covered(length: int) -> list:
    """Byte range of the windows whose anchor has an offset of ``low`` to ``high``."""
    start = F.expr(f"((place >> {_START}) & {_START_MASK}L) + (place & 255)")
    return ["ref", F.expr(f"place >> {_SALT}").alias("salt"), (start - F.col("high")).alias("start"),
            (start - F.col("low") + length).alias("end")]


def repeated_ranges(texts: DataFrame, length: int) -> DataFrame:
    """Byte ranges (ref, salt, start, end) that repeated strings cover; they may overlap.

    ``texts``: ref, salt, text. Equal (ref, salt) stand for equal texts.
    """
    runs = texts.mapInArrow(_runs(length), "digit1 long, digit2 long, ref long, place long")
    # Keys are settled before they are joined: a join of two plain scans can be split where a key is frequent.
    shared = settle(runs.groupBy("digit1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digit1"))
    survivors = settle(runs.join(shared, "digit1", "left_semi"))

    # Copies of a run are a class with one of them as its representative.
    classes = settle(
        survivors.groupBy("digit1", "digit2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("ref", "place")).alias("r"))
        .select("digit1", "digit2", "copies", "r.ref", "r.place")
    )
    whole_runs = (
        survivors.join(classes.filter("copies > 1").select("digit1", "digit2"), ["digit1", "digit2"], "left_semi")
        .withColumn("high", F.expr("place & 255"))
        .withColumn("low", F.expr(f"high - ((place >> {_COUNT}) & 255)"))
        .select(*_covered(length))
    )

    split = settle(classes.groupBy("digit1").agg(F.count(F.lit(1)).alias("n"), F.min("copies").alias("least"))
                   .filter("n > 1 and least = 1").select("digit1"))
    by_text = (
        classes.join(split, "digit1", "left_semi")
        .groupBy("ref", F.expr(f"place >> {_SALT}").alias("salt"))
        .agg(F.collect_list(F.struct("digit1", "place", "copies")).alias("runs"))  # as many as the text has places
    )
    # A text that stands in several rows is needed once; `copies` already counts them.
    cut = texts.join(by_text, ["ref", "salt"]).select("ref", "text", "runs")
    contexts = settle(cut.mapInArrow(_contexts(length), "digit1 long, ref long, place long, copies long, bytes binary")
                      .dropDuplicates(["ref", "place"]))

    pieces = contexts.mapInArrow(_pieces(length, PIECE, False), _PIECE_ROW)
    by_core = pieces.groupBy("digit1", "piece", "core").agg(
        F.sum("copies").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b")).filter("n > 1")
    by_core = settle(by_core.select("digit1", "piece", "core", (F.col("a") != F.col("b")).alias("mixed")))
    alive = settle(pieces.join(by_core, ["digit1", "piece", "core"]))
    # A run with copies is covered as a whole already.
    twice = alive.groupBy("digit1", "piece", "core", "whole").agg(F.sum("copies").alias("n")).filter("n > 1")
    whole_pieces = alive.filter("copies = 1").join(
        twice.select("digit1", "piece", "core", "whole"), ["digit1", "piece", "core", "whole"], "left_semi")

    wanted = alive.filter("mixed").groupBy("ref", "place").agg(F.collect_set("piece").alias("wanted"))  # 9 at most
    windows = contexts.join(wanted, ["ref", "place"]).mapInArrow(_pieces(length, PIECE, True), _PIECE_ROW)
    again = windows.groupBy("digit1", "piece", "whole").agg(F.sum("copies").alias("n")).filter("n > 1")
    single = windows.filter("copies = 1").join(
        again.select("digit1", "piece", "whole"), ["digit1", "piece", "whole"], "left_semi")
    return whole_runs.unionByName(whole_pieces.select(*_covered(length))).unionByName(single.select(*_covered(length)))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, n_removed, spans, digests = [], [], [], []
        for text, ranges in zip(batch.column("text"), batch.column("ranges")):
            data = memoryview(text.as_buffer()) if text.is_valid and len(text.as_buffer()) else memoryview(b"")
            removed: list[list[int]] = []
            for r in sorted((r["start"], r["end"]) for r in ranges.as_py() or []):
                if removed and r[0] <= removed[-1][1]:
                    removed[-1][1] = max(removed[-1][1], r[1])
                else:
                    removed.append(list(r))
            digest, at = hashlib.sha256(), 0
            for start, end in removed:
                digest.update(data[at:start])
                at = end
            digest.update(data[at:])
            n_bytes.append(len(data))
            n_removed.append(sum(e - s for s, e in removed))
            spans.append([{"start": s, "end": e} for s, e in removed])
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(digests)],
            ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])


def dedup_substrings(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What each document loses if every byte goes that a repeated string of ``length`` bytes covers.

    Returns one row per row of ``docs``: doc_id, n_bytes, n_removed, spans (start and end of each
    removed run, in bytes), kept_sha256 (of the bytes that stay). ``length``: 16 to 255.

    * Texts are judged as UTF-8 bytes; NULL and '' have no bytes. Strings never cross documents.
    * Repeated rows are documents of their own, also with equal or NULL doc_id.
    * Overlapping occurrences count. No string is capped, whatever its number of occurrences.
    * A text takes part in one piece, so it has to fit the memory of a task (about 100 bytes a byte).
    * Other columns are ignored. An empty table gives an empty one.
    """
    if not 16 <= length <= 255:
        raise ValueError("length must be from 16 to 255")
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(
        F.xxhash64(F.col(doc_id).cast("long"), content).alias("ref"),  # with salt, 80 bits for a row's doc_id and text
        F.shiftrightunsigned(F.xxhash64(F.lit(7), content), 48).alias("salt"),
        content.alias("text"), F.col(doc_id).cast("long").alias("doc_id"),
    )
    ranges = repeated_ranges(texts.select("ref", "salt", "text"), length)
    by_text = settle(ranges.groupBy("ref", "salt").agg(F.collect_set(F.struct("start", "end")).alias("ranges")))
    return texts.join(by_text, ["ref", "salt"], "left").select("doc_id", "text", "ranges").mapInArrow(
        _cut_out, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string")
