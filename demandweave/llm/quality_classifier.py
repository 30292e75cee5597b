"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Random indexing: a token has a fixed sparse vector of a few +1 and -1, drawn from its hash; the
vector of a word is the sum of those of its neighbours over the whole corpus. Words share a fixed
number of rows by hash, so the sums have a bounded size however large the vocabulary is. They are
whole numbers, so the order in which tasks end does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandweave.llm.arrays import Chunk, Slices, chunks
from demandweave.llm.staging import settle

ROWS = 1 << 14  # of word vectors
WIDTH = 32
WINDOW = 2  # neighbours on each side
TRAIN_ROWS = 20_000  # labelled rows that the network is fitted on, at most
HIDDEN = 24
EPOCHS = 400
THRESHOLD = 0.7

# A token is a run of one kind of byte: small letters (and all beyond ASCII), capitals, digits, or
# one symbol repeated. White space parts tokens and is none.
_KIND = np.arange(256)
_KIND[97:123] = _KIND[128:] = 256
_KIND[65:91], _KIND[48:58] = 257, 258
_KIND[[0x20, *range(0x09, 0x0E)]] = 0


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, and where each document's tokens begin."""
    kind = _KIND[chunk.data]
    new = np.ones(len(kind), np.bool_)
    new[1:] = kind[1:] != kind[:-1]
    new[chunk.starts[:-1][chunk.starts[:-1] < len(kind)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(kind))
    some = kind[starts] != 0
    starts, ends = starts[some], ends[some]
    long_symbols = (kind[starts] < 256) & (ends - starts > 3)
    ends = np.where(long_symbols, starts + 3, ends)  # !!!! counts as !!!
    return Slices(chunk.data).hashes(starts, ends), np.searchsorted(starts, chunk.starts)


def _row(token: np.ndarray, rows: int) -> np.ndarray:
    return (token >> np.uint64(40)).astype(np.int64) & (rows - 1)


def _index(token: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(dimension, sign) of the entries of a token's fixed vector."""
    out = []
    for k in range(2):
        bits = token >> np.uint64(16 * k)
        out.append(((bits & np.uint64(0xFF)).astype(np.int64) % width, 1.0 - 2.0 * ((bits >> np.uint64(8)) & np.uint64(1)).astype(np.float64)))
    return out


def _contexts(rows: int, width: int, window: int):
    names = ["row", *(f"v{i}" for i in range(width))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rows * width)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                token, bounds = tokens(chunk)
                row, index = _row(token, rows), _index(token, width)
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                for step in range(1, window + 1):
                    near = np.flatnonzero(doc[step:] == doc[:-step])
                    for word, other in ((near, near + step), (near + step, near)):
                        for at, sign in index:
                            total += np.bincount(row[word] * width + at[other], sign[other], rows * width)
        table = total.astype(np.int64).reshape(rows, width)
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(table[some, i]) for i in range(width))], names)

    return task


def word_vectors(texts: DataFrame, rows: int = ROWS, width: int = WIDTH, window: int = WINDOW) -> np.ndarray:
    """(rows, width) unit vectors from all of ``texts`` (one column); rows * width bounds the size."""
    names = [f"v{i}" for i in range(width)]
    parts = texts.mapInArrow(_contexts(rows, width, window), "row long, " + ", ".join(f"{n} long" for n in names))
    sums = parts.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((rows, width))
    if sums.num_rows:
        out[sums.column("row").to_numpy()] = np.stack([sums.column(n).to_numpy() for n in names], 1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(chunk: Chunk, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each document; zeros for a document without tokens."""
    token, bounds = tokens(chunk)
    n, width = np.diff(bounds), vectors.shape[1]
    out = np.zeros((len(n), 2 * width), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        own = vectors[_row(token, len(vectors))]
        size = n[some, None]
        mean = np.add.reduceat(own, bounds[:-1][some], axis=0, dtype=np.float64) / size
        square = np.add.reduceat(own * own, bounds[:-1][some], axis=0, dtype=np.float64) / size
        out[some, :width] = mean
        out[some, width:] = np.sqrt(np.maximum(square - mean * mean, 0))
    return out


def _features(vectors: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                values = pooled(chunk, vectors)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, len(values)), lists], ["doc_id", "features"])

    return task


class Network(NamedTuple):
    """Two layers over standardised features; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, check: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS) -> Network:
    """Fit on the rows outside ``check`` (Adam, weight decay), calibrate the temperature on those inside."""
    x = x.astype(np.float64)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.Generator(np.random.PCG64(11))
    width = x.shape[1]
    p = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z, t = (x[~check] - mean) / scale, y[~check]
    for step in range(1, epochs + 1):
        h = np.tanh(z @ p[0] + p[1])
        error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - t) / max(1, len(t))
        back = np.outer(error, p[2]) * (1 - h * h)
        grads = [z.T @ back + 1e-3 * p[0], back.sum(0), h.T @ error + 1e-3 * p[2], error.sum(keepdims=True)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if check.any():
        logit, target = net.logits(x[check]), y[check]

        def loss(temperature: float) -> float:
            a = logit / temperature
            return float(np.mean(np.logaddexp(0, a) - target * a))

        net = net._replace(temperature=float(min(np.geomspace(0.25, 8, 61), key=loss)))
    return net


def _score(net: Network):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = len(net.mean)
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(net.scores(x))], ["doc_id", "score"])

    return task


def score_quality(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD,
    doc_id: str = "doc_id", text: str = "text", label: str = "quality",
) -> DataFrame:
    """Score of each document: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Word vectors come from all documents. The network is fitted on at most ``train_rows`` labelled
    documents, those with the smallest hash (among a share of the labels), whose crc32(doc_id as text) mod 4 is not 2 (held_out:
    it is 2); a fifth of them sets the temperature. Only the text goes into a score.

    * NULL and empty texts have a vector of zeros, and its score.
    * Rows of labels without a document or a label count for nothing; repeated ones count each.
    * A NULL doc_id is never held out, and never labelled. Without labels every score is 0.5.
    * One row per row of ``docs``; other columns are ignored.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    vectors = word_vectors(texts.select("text"))
    features = settle(texts.mapInArrow(_features(vectors), "doc_id long, features array<float>"))
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter(
        F.col("y").isin(0.0, 1.0) & ~held_out & F.col("doc_id").isNotNull())
    # A share of the hashes with about twice as many rows, so no task passes on more than its part of them.
    share = min(1.0, 2 * train_rows / max(1, known.count()))
    labelled = known.filter(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 32)) < int(share * (1 << 32)))
    chosen = features.join(labelled, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(train_rows).toArrow()
    if chosen.num_rows:
        x = chosen.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(chosen.num_rows, -1)
        y = chosen.column("y").to_numpy()
        check = np.arange(len(y)) % 5 == 4
        net = fit(x, y, check)
    else:
        width = 2 * WIDTH
        net = Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    scored = features.mapInArrow(_score(net), "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
