"""Vector codes: 16 parts of a vector, each named by the nearest of 64 entries of a codebook.

Components are whole numbers, so each dimension has few different values. A task builds a
dictionary per dimension: its distinct values, and for each the squared difference to all entries.
A part's distance to all entries is then a gather per dimension and a sum; nothing is multiplied
per vector. All is done in whole numbers, so the order in which tasks end does not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandweave.llm.staging import settle

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
CELLS = 1 << 18  # components that a task looks at together

_SMALL = 1 << 26  # up to here squared distances of 1,024 components and more fit in 64 bits
_LIMB = 20  # larger sums travel in limbs of so many bits


def usable(vector: Column) -> Column:
    """Neither NULL nor with a component that is NULL, infinite or no number."""
    big = F.lit(float("inf")).cast("double")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < big))
    return F.coalesce(fine, F.lit(False))


def whole(values: np.ndarray, exact: bool) -> np.ndarray:
    """floor(256 * x); ``exact``: as Python's numbers, for values that 64 bits don't hold."""
    if not exact:
        return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)
    out = np.empty(values.shape, object)
    for at, x in np.ndenumerate(values.astype(np.float64)):
        n, d = float(x).as_integer_ratio()
        out[at] = SCALE * n // d
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width): shorter vectors are filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.float64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def nearest(values: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and squared distance of each row to its entries, summed over the parts.

    ``codebooks``: (parts, entries, width of a part). Equal distances: the lower index.
    """
    parts, entries, size = codebooks.shape
    codes = np.zeros((len(values), parts), np.int64)
    error = np.zeros(len(values), values.dtype)
    for p in range(parts):
        distance = np.zeros((len(values), entries), values.dtype)
        for j in range(size):
            own, code = np.unique(values[:, p * size + j], return_inverse=True)  # the dictionary of this dimension
            table = own[:, None] - codebooks[p, :, j][None, :]
            table = table * table
            distance += table[code]
        if entries:
            codes[:, p] = np.argmin(distance, axis=1)
            error = error + distance[np.arange(len(values)), codes[:, p]]
    return codes, error


def _pieces(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // max(1, width))
    for first in range(0, batch.num_rows, step):
        yield batch.slice(first, step)


def _limbs(number: int, limbs: int) -> list[int]:
    """The number in base 2 ** 20, smallest first; the last limb has the sign."""
    out = []
    for _ in range(limbs - 1):
        out.append(number & ((1 << _LIMB) - 1))
        number >>= _LIMB
    return [*out, number]


def _sums(codebooks: np.ndarray, width: int, exact: bool, limbs: int):
    """One row for each entry that a task's parts fall on: part, entry, count, component sums (in limbs)."""
    parts, entries, size = codebooks.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, size), object if exact else np.int64)
        for batch in batches:
            for piece in _pieces(batch, width):
                values = whole(matrix(piece.column("v"), width), exact)
                codes, _ = nearest(values, codebooks)
                for p in range(parts):
                    np.add.at(count[p], codes[:, p], 1)
                    np.add.at(total[p], codes[:, p], values[:, p * size : (p + 1) * size])
        p, k = np.nonzero(count)
        sums = [[x for number in total[a, b] for x in (_limbs(int(number), limbs) if exact else [int(number)])] for a, b in zip(p, k)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int64()), pa.array(k, pa.int64()), pa.array(count[p, k], pa.int64()), pa.array(sums, pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"])

    return task


class Codebooks:
    """What ``fit`` has learned: the entries (parts, entries, width of a part) and how to read vectors."""

    def __init__(self, entries: np.ndarray, width: int, exact: bool):
        self.entries, self.width, self.exact = entries, width, exact

    def text(self) -> str:
        """All components by part, entry and position, comma-joined."""
        return ",".join(str(int(x)) for x in self.entries.reshape(-1))

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()


def kept_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The usable rows, as vec_id, label, v."""
    kind = "float" if "array<float" in vectors.select(F.col(vector)).schema[0].dataType.simpleString() else "double"
    return vectors.filter(usable(F.col(vector))).select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast(f"array<{kind}>").alias("v"))


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``kept_vectors``: they start as the parts of the smallest vec_ids; each round moves an
    entry to the floor of the mean of the parts nearest to it."""
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    longest, most, rows = kept.agg(F.max(F.size("v")), F.max(largest), F.count(F.lit(1))).first()
    width = -(-(longest or 0) // parts) * parts
    reach = int(np.ceil(most or 0.0)) * SCALE + 1
    exact = reach > _SMALL or width > 4096 or reach * rows >= 1 << 62
    limbs = (reach * max(1, rows)).bit_length() // _LIMB + 2
    first = kept.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).toArrow()
    start = whole(matrix(first.column("v").combine_chunks(), width), exact) if first.num_rows else np.zeros((0, width), np.int64)
    size = width // parts
    books = np.ascontiguousarray(start.reshape(len(start), parts, size).transpose(1, 0, 2))
    for _ in range(rounds if len(start) else 0):
        found = kept.select("v").mapInArrow(_sums(books, width, exact, limbs), "part long, entry long, n long, sums array<long>")
        each = limbs if exact else 1
        summed = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size * each)])
        books = books.copy()
        for row in summed.collect():  # parts * entries rows at most
            sums = [sum(row[3 + j * each + i] << (_LIMB * i) for i in range(each)) for j in range(size)]
            books[row.part, row.entry] = [s // row.n for s in sums]
    return Codebooks(books, width, exact)


def _encode(books: Codebooks):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, books.width):
                codes, error = nearest(whole(matrix(piece.column("v"), books.width), books.exact), books.entries)
                most = (1 << 63) - 1
                held = pa.array([min(int(e), most) for e in error] if books.exact else error, pa.int64())
                code = [row.tobytes() for row in codes.astype(np.uint8 if books.entries.shape[1] <= 256 else ">u2")]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("vec_id"), piece.column("label"), pa.array(code, pa.binary()), held], ["vec_id", "label", "code", "error"])

    return task


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (binary, one byte a part, two from 257 entries on), error for each row of ``kept_vectors``."""
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return kept.select("vec_id", "label", "v").mapInArrow(
        _encode(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long")


def compress_vectors(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error, label_error) of each usable row, and the codebooks.

    * Rows whose vector is NULL or holds a NULL or non-finite component are left out.
    * Vectors shorter than the longest (rounded up to whole parts), also empty ones, are filled up with zeros.
    * Equal vec_ids: all rows are encoded; which are the smallest is then settled by the components. NULL comes last.
    * With fewer rows than ``entries`` the codebooks are shorter; an empty table gives no row.
    * Components beyond 64 bits are reckoned with exactly; an error beyond 2**63 - 1 is given as that number.
    * label_error: errors summed over the rows with an equal label, NULLs together. Other columns are ignored.
    """
    kept = settle(kept_vectors(vectors, vec_id, vector, label))
    books = fit(kept, parts, entries, rounds)
    coded = settle(encode(kept, books))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    totals = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), most).cast("long").alias("label_error"))
    totals = totals.withColumnRenamed("label", "of")
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    return joined, books
