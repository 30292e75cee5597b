"""Best-fit packing of documents into sequences of fixed capacity, with conflicts.

Documents are dealt out into shards of a bounded size by a hash, so a large source or a large group
of copies fills all shards alike; each shard is packed on its own. A bin carries a bitmap of the
sources and one of the duplicate clusters it holds. Open bins are ordered by what is left in
them; the search starts at the tightest one that is large enough and goes on to the next larger
until neither bitmap speaks against it.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandweave.llm.quality_rules import let
from demandweave.llm.staging import settle

CAPACITY = 2048  # words
SHARD_ROWS = 8192

_SPACE = " \t\n\x0b\x0c\r"


class OpenBins:
    def __init__(self, capacity: int):
        self.capacity = capacity
        self.sources: list[int] = []  # bitmaps, one per bin
        self.clusters: list[int] = []
        self.free: list[int] = []
        self._by_free: dict[int, dict[int, None]] = {}
        self._some = 0  # bit r: there is a bin with r left

    def _file(self, b: int) -> None:
        r = self.free[b]
        if r:
            self._by_free.setdefault(r, {})[b] = None
            self._some |= 1 << r

    def _tightest(self, size: int, source: int, cluster: int) -> int | None:
        rest = self._some >> size
        while rest:
            r = size + (rest & -rest).bit_length() - 1
            for b in self._by_free[r]:
                if not self.sources[b] & source and not self.clusters[b] & cluster:
                    return b
            rest &= rest - 1
        return None

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Place an item; returns its bin and its offset there. ``source``, ``cluster``: one bit, or 0."""
        b = self._tightest(size, source, cluster)
        if b is None:
            b = len(self.free)
            self.free.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            own = self._by_free[self.free[b]]
            del own[b]
            if not own:
                self._some &= ~(1 << self.free[b])
        offset = self.capacity - self.free[b]
        self.free[b] -= size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self._file(b)
        return b, offset


def pack(items: Iterable[tuple], capacity: int) -> list[tuple]:
    """``items``: (key, source, cluster, size). Returns (key, piece, first, size, bin, offset).

    Items beyond the capacity are cut; full pieces have a bin of their own. Larger rests come first.
    """
    items, out, rests = list(items), [], []
    bins = OpenBins(capacity)
    seen: dict = {}
    for key, source, cluster, size in items:
        for piece in range(size // capacity):
            out.append((key, piece, piece * capacity, capacity, *bins.put(capacity, 0, 0)))
        if size % capacity:
            rests.append((size % capacity, key, source, cluster, size // capacity))
            seen[cluster] = seen.get(cluster, 0) + 1
    source_bit: dict = {}
    cluster_bit: dict = {}
    for size, key, source, cluster, piece in sorted(rests, key=lambda r: (-r[0], r[1])):
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None or seen[cluster] == 1 else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        out.append((key, piece, piece * capacity, size, *bins.put(size, s, c)))
    return out


def _pack_shard(capacity: int):
    def task(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        columns = [table.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "n_words")]
        # Rows in an order that does not depend on how they came here; the key is the place in it.
        rows = sorted(zip(*columns), key=lambda r: (r[0] is None, r[0] or 0, r[2] or 0, r[1] or "", r[3]))
        placed = pack(((i, r[1], r[2], r[3]) for i, r in enumerate(rows)), capacity)
        keys, piece, first, size, bins, offset = list(zip(*placed)) or [[]] * 6
        out = {
            "doc_id": pa.array([rows[i][0] for i in keys], pa.int64()), "piece": pa.array(piece, pa.int64()),
            "first_word": pa.array(first, pa.int64()), "n_words": pa.array(size, pa.int64()),
            "bin_id": pa.array([None if b is None else shard << 32 | b for b in bins], pa.int64()),
            "bin_offset": pa.array(offset, pa.int64()),
            "source": pa.array([rows[i][1] for i in keys], pa.string()), "cluster": pa.array([rows[i][2] for i in keys], pa.int64()),
        }
        return pa.table(out)

    return task


def content_cluster(text: Column) -> Column:
    """Copies of a text, without regard to case and white space; NULL and empty texts have no cluster."""
    content = F.trim(F.regexp_replace(F.lower(text), f"[{_SPACE}]+", " "))
    return F.when(content != "", F.xxhash64(content))


def word_count(text: Column) -> Column:
    words = let(F.split(F.coalesce(text.cast("string"), F.lit("")), f"[{_SPACE}]+"), lambda w: F.size(F.array_remove(w, "")))
    return words.cast("long")


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None, shard_rows: int = SHARD_ROWS,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Pieces of documents and their bins: doc_id, piece, first_word, n_words, bin_id, bin_offset, source, cluster.

    A bin holds ``capacity`` words, at most one rest of a document per source and at most one per
    duplicate cluster (``cluster``: a long; ``content_cluster`` unless given). A document beyond
    the capacity is cut into full pieces, each a bin of its own, and a rest.

    * A text without words (NULL, '') has one row with n_words 0 and no bin.
    * A NULL source or cluster conflicts with nothing.
    * Repeated rows are packed each; with equal texts they are one cluster.
    * Rows are packed in shards of about ``shard_rows``, by a hash of doc_id, text and a number among
      equal rows, so that also those are dealt out; bins do not cross shards.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(content).alias("h"), F.col(source).cast("string").alias("source"),
        (content_cluster(content) if cluster is None else cluster.cast("long")).alias("cluster"), word_count(content).alias("n_words"))
    # Equal rows are counted before they are dealt out. Settled: texts are read once.
    rows = settle(rows.groupBy("doc_id", "h", "source", "cluster", "n_words").agg(F.count(F.lit(1)).alias("times")))
    some = rows.filter("n_words > 0")
    shards = max(1, -(-(some.agg(F.sum("times")).first()[0] or 0) // shard_rows))
    each = some.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    dealt = each.select(
        F.pmod(F.xxhash64("doc_id", "h", "time"), F.lit(shards)).cast("long").alias("shard"), "doc_id", "source", "cluster", "n_words")
    packed = dealt.groupBy("shard").applyInArrow(
        _pack_shard(capacity), "doc_id long, piece long, first_word long, n_words long, bin_id long, bin_offset long, source string, cluster long")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    empty = rows.filter("n_words = 0").withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(
        "doc_id", zero.alias("piece"), zero.alias("first_word"), "n_words", none.alias("bin_id"), none.alias("bin_offset"), "source", "cluster")
    return packed.unionByName(empty)
