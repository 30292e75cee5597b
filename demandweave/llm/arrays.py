"""Texts of an Arrow batch as one byte buffer, and hashes of its parts, for tasks that work with numpy.

Long batches are handed out in chunks of whole documents, so the arrays of a task stay small
however many rows a batch has. A document longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20


class Chunk(NamedTuple):
    first: int  # row of the batch
    data: np.ndarray  # bytes of the documents, one after the other
    starts: np.ndarray  # of each document in data, and the end of the last


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a string column (NULL: empty) in chunks of about ``size`` bytes."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    first, rows = 0, len(column)
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), rows)
        own = offsets[first : last + 1]
        yield Chunk(first, data[own[0] : own[-1]], own - own[0])
        first = last


_LETTERS = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse among the numbers of 64 bits
_BACK = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64; lengths are rounded up so that chunks share them."""
    return _powers(base, max(CHUNK_BYTES * 2, 1 << (n - 1).bit_length() if n > 1 else 1))[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit hash over all others."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class Slices:
    """Hashes of any slices of a byte buffer, from one pass over it."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        terms = _LETTERS[data]
        terms *= powers(_BASE, len(data))
        np.cumsum(terms, out=self.sums[1:])
        self.back = powers(_BACK, len(data) + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal slices have equal hashes; the length counts, too."""
        h = self.sums[ends] - self.sums[starts]
        h *= self.back[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mixed(h)


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # first word of each document, and the number of words


def words(chunk: Chunk, letters: np.ndarray) -> Words:
    """Maximal runs of bytes for which ``letters`` (256 booleans) holds, within documents."""
    inside = np.zeros(len(chunk.data) + 2, np.bool_)
    inside[1:-1] = letters[chunk.data]
    edge = inside[1:] != inside[:-1]
    # A run that crosses from one document into the next is two words.
    cuts = chunk.starts[1:-1]
    both = cuts[inside[cuts] & inside[cuts + 1]]
    places = np.flatnonzero(edge)
    if len(both):
        places = np.sort(np.concatenate([places, both, both]), kind="stable")
    starts, ends = places[0::2], places[1::2]
    return Words(starts, ends, np.searchsorted(starts, chunk.starts))


SPACES = np.zeros(256, np.bool_)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Words are what stands between ASCII white space.
WORD_BYTES = ~SPACES


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return h.view(np.int64)
