"""Benchmark decontamination: rare n-grams as seeds, then Smith-Waterman alignment.

Two passes over the documents, and no exchange of text. The first counts how often the n-grams of
the benchmark stand in the documents; the rarer ones of each item become seeds. The second finds
seeds, and aligns the item with the text around them. The benchmark takes part in blocks of a
bounded size, each of which goes to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandweave.llm.arrays import Chunk, Slices, chunks, words
from demandweave.llm.order_minhash import _LOWER, shingle_hashes
from demandweave.llm.staging import free_names

GRAM = 3
SEED_SHARE = 0.7  # of the n-grams of an item, the rarest
COMMON = 1e-5  # n-grams below this share of all words are seeds in any case
AT_LEAST = 0.4  # chance alignments with common words stay below 0.3
SHORT = 6  # words that must match in any case; a shorter item must match as a whole
BLOCK_BYTES = 4 << 20

_LETTERS = np.zeros(256, np.bool_)
_LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
LEAKS = "array<struct<item_id: long, score: double, first_word: long, last_word: long>>"


class Items(NamedTuple):
    """A block of the benchmark: words of all items, and their n-grams, sorted by hash."""

    ids: list
    word: np.ndarray
    bounds: np.ndarray
    gram: np.ndarray  # hashes, sorted; an n-gram may stand more than once
    item: np.ndarray
    offset: np.ndarray


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Words are digits, letters and all beyond ASCII, without regard to the case of A-Z."""
    lower = chunk._replace(data=_LOWER[chunk.data])
    found = words(lower, _LETTERS)
    return Slices(lower.data).hashes(found.starts, found.ends), found.bounds


def load_items(rows: list) -> Items:
    """``rows``: (item_id, text)."""
    texts = pa.array([r[1] or "" for r in rows], pa.string())
    parts = [word_hashes(c) for c in chunks(texts, 1 << 40)]
    word, bounds = parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
    gram, starts = shingle_hashes(word, bounds, GRAM)
    item = np.repeat(np.arange(len(rows)), np.diff(starts))
    order = np.argsort(gram, kind="stable")
    return Items([r[0] for r in rows], word, bounds, gram[order], item[order], (np.arange(len(gram)) - starts[item])[order])


def _looked_up(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``wanted`` whose value is in ``sorted_``, and where it first stands there."""
    if not len(sorted_) or not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(sorted_, wanted)
    at[at == len(sorted_)] = 0
    hit = np.flatnonzero(sorted_[at] == wanted)
    return hit, at[hit]


def _count(gram: np.ndarray):
    """How often the documents hold each of ``gram`` (sorted, distinct); -1 stands for all words."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n_words = np.zeros(len(gram), np.int64), 0
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                word, bounds = word_hashes(chunk)
                n_words += len(word)
                _, at = _looked_up(gram, shingle_hashes(word, bounds, GRAM)[0])
                total += np.bincount(at, minlength=len(gram))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n_words))], ["gram", "n"])

    return task


def choose_seeds(items: Items, count: np.ndarray, n_words: int) -> np.ndarray:
    """Which n-grams are seeds: the rarest SEED_SHARE of each item with ties, and all rare ones."""
    per_item = np.bincount(items.item, minlength=len(items.ids))
    order = np.lexsort((count, items.item))
    starts = np.concatenate([[0], np.cumsum(per_item)])[:-1]
    limit = np.zeros(len(items.ids), np.int64)
    some = per_item > 0
    last = starts[some] + np.ceil(per_item[some] * SEED_SHARE).astype(np.int64) - 1
    limit[some] = count[order[last]]
    return (count <= limit[items.item]) | (count <= COMMON * n_words)


def smith_waterman(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment (match 1, mismatch and gap -1): score, first and last place in ``text``."""
    n = len(text)
    steps = np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), steps.copy()
    best = (0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where(text == word, 1, -1)
        score = np.concatenate([[0], np.maximum(diagonal, row[1:] - 1)])
        start = np.concatenate([[0], np.where(diagonal >= row[1:] - 1, begin[:-1], begin[1:])])
        low = score <= 0
        score[low], start[low] = 0, steps[low]
        # A gap in the item: the best of the places to the left, less their distance.
        ahead = score + steps
        top = np.maximum.accumulate(ahead)
        source = np.maximum.accumulate(np.where(ahead == top, steps, 0))
        row = top - steps
        begin = np.where(row > 0, start[source], steps)
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(begin[j]), j - 1)
    return best


def align_seeds(word: np.ndarray, places: np.ndarray, item: np.ndarray, offset: np.ndarray, items: Items, at_least: float):
    """Yields (item, score, first, last) for the items that a document holds, best place of each."""
    order = np.lexsort((places - offset, item))
    places, item, offset = places[order], item[order], offset[order]
    diagonal = places - offset
    size = np.diff(items.bounds)
    new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (np.diff(diagonal) > size[item[1:]])]))
    best: dict[int, tuple] = {}
    for a, b in zip(new, np.append(new[1:], len(item))):
        i = int(item[a])
        m, pad = int(size[i]), int(size[i]) // 2 + 2
        low, high = max(0, int(diagonal[a]) - pad), min(len(word), int(diagonal[b - 1]) + m + pad)
        text, own = word[low:high], items.word[items.bounds[i] : items.bounds[i + 1]]
        need = max(at_least * m, min(m, SHORT))
        if np.isin(own, text).sum() < need:
            continue  # the score is at most the number of words of the item that the text has
        score, first, last = smith_waterman(text, own)
        if score >= need and score / m > best.get(i, (0,))[0]:
            best[i] = (score / m, low + first, low + last)
    for i, (score, first, last) in sorted(best.items()):
        yield i, score, first, last


def _find(items: Items, at_least: float, names: list[str], text_name: str, found_name: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Where each hash stands in the sorted list, and how often.
        distinct, first, times = np.unique(items.gram, return_index=True, return_counts=True)
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for chunk in chunks(batch.column(text_name)):
                word, bounds = word_hashes(chunk)
                gram, starts = shingle_hashes(word, bounds, GRAM)
                hit, at = _looked_up(distinct, gram)
                if not len(hit):
                    continue
                doc = np.searchsorted(starts, hit, "right") - 1
                again = np.repeat(np.arange(len(hit)), times[at])
                entry = np.arange(len(again)) - np.repeat(np.cumsum(times[at]) - times[at], times[at]) + first[at][again]
                place = (hit - starts[doc])[again]
                cuts = np.flatnonzero(np.diff(doc[again])) + 1
                for own in np.split(np.arange(len(again)), cuts):
                    d = int(doc[again[own[0]]])
                    text = word[bounds[d] : bounds[d + 1]]
                    for i, score, low, high in align_seeds(text, place[own], items.item[entry[own]], items.offset[entry[own]], items, at_least):
                        found[chunk.first + d].append({"item_id": items.ids[i], "score": score, "first_word": low, "last_word": high})
            leak = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, leak)], [*names, found_name])

    return task


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list]:
    """The benchmark in blocks of about ``block_bytes`` of text, one at a time on the driver."""
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    for k in range(n):
        own = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in own.sort("item_id", "text").collect()]


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, at_least: float = AT_LEAST, block_bytes: int = BLOCK_BYTES,
    text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Add ``leaks`` to ``docs``: items of the benchmark that the text holds, exact or edited.

    A leak has item_id, score (of the alignment, over the words of the item: 1 for an exact copy),
    first_word and last_word of the best place. ``at_least`` is the least score.

    * Items with fewer than three words (NULL and '' have none) are never found; of those with fewer than
      ``SHORT`` only exact copies; of longer ones ``SHORT`` words at least must match.
    * NULL and empty texts hold nothing. Whole texts are read; no number of leaks is capped.
    * Equal items are found each; repeated rows are judged alike.
    * One row per row of ``docs``; its columns stay, but for one named leaks.
    """
    docs = docs.drop("leaks")
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text <> ''")
    names = docs.columns
    none = F.array().cast(LEAKS)
    out = docs.withColumn("leaks", none)
    for rows in _blocks(items, block_bytes):
        block = load_items(rows)
        gram, inverse = np.unique(block.gram, return_inverse=True)
        counted = docs.select(F.col(text).cast("string")).mapInArrow(_count(gram), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        n = {r.gram: r.n for r in counted.collect()}  # one row per n-gram of the block
        count = np.array([n.get(i, 0) for i in range(len(gram))], np.int64)[inverse] if len(gram) else np.zeros(0, np.int64)
        seed = choose_seeds(block, count, n.get(-1, 0))
        seeds = block._replace(gram=block.gram[seed], item=block.item[seed], offset=block.offset[seed])
        words_of, found = free_names([*names, "leaks"], "words_of", "found")
        own = [*names, "leaks", words_of]
        with_text = out.withColumn(words_of, F.col(f"`{text}`").cast("string"))
        kind = T.StructType([*with_text.schema.fields, T.StructField(found, out.schema["leaks"].dataType)])
        out = with_text.mapInArrow(_find(seeds, at_least, own, words_of, found), kind).select(
            *[F.col(f"`{c}`") for c in names], F.concat("leaks", found).alias("leaks"))
    return out
