"""Line dedup: lines that many documents share stay in one of them.

Hashes of the lines are dealt out by range of (hash, document) and sorted by position within, so
a line that a third of all documents hold fills many partitions; each streams its part in order,
and one row per partition and line goes on to count the documents. What comes out is a compressed
bitmap per document, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandweave.llm.quality_rules import let
from demandweave.llm.staging import free_names, settle

MIN_CHARS = 40
MIN_DOCUMENTS = 5

_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NO_ID = -(1 << 63)  # stands for a NULL doc_id: before all others


def lines_of(text: Column) -> Column:
    r"""Lines between \n; NULL and '' are one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _UPPER.lower())


def _row_key(doc_id: str, text: str) -> list[Column]:
    """Tells rows apart also where a doc_id is repeated or NULL; equal rows are judged alike."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("d"),
            F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("t")]


def dropped_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Bitmaps of the lines to drop: (d, t, bitmap), only for documents that lose a line.

    ``bitmap``: array of (word, bits); bit i of ``bits`` stands for line 64 * word + i, counted
    from 0. Words without a dropped line are left out. d, t: see ``_row_key``. The keeper of a line is
    the largest doc_id that holds it, all rows of that doc_id.
    """
    entry = F.struct(F.col("i").cast("long").alias("pos"), line_key(F.col("line")).alias("key"))
    lines = (
        docs.select(*_row_key(doc_id, text), F.posexplode(lines_of(F.col(text))).alias("i", "line"))
        .filter(F.length("line") >= min_chars).select("d", "t", entry.alias("e")).filter(F.length("e.key") >= min_chars)
        .select(F.xxhash64("e.key").alias("h1"), F.xxhash64(F.lit(1), "e.key").alias("h2"), "d", "t", "e.pos")
    )
    # A key of so many documents stands in so many rows; ranges of them are found by a sample.
    lines = settle(lines)
    ranges = lines.repartitionByRange("h1", "h2", "d").sortWithinPartitions("h1", "h2", "d", "pos")
    per_doc = ranges.groupBy("h1", "h2", "d").agg(F.first("pos").alias("pos"))
    spread = per_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("keeper"))
    # Settled, so that the join can be split where a line is frequent.
    common = settle(spread.filter(F.col("n") >= min_documents).select("h1", "h2", "keeper"))
    gone = lines.join(common, ["h1", "h2"]).filter("d <> keeper")
    words = gone.groupBy("d", "t", F.expr("pos div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits"))
    return words.groupBy("d", "t").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))


def _places(bitmap: Column) -> Column:
    bits = F.sequence(F.lit(0), F.lit(63))
    return F.flatten(F.transform(bitmap, lambda w: F.transform(
        F.filter(bits, lambda b: F.getbit(w["bits"], b) == 1), lambda b: (w["word"] * 64 + b).cast("int"))))


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    r"""Add n_lines, n_dropped, bitmap (NULL if nothing is dropped) and kept_text to ``docs``.

    A line whose key (see ``line_key``) has ``min_chars`` code points or more and stands in
    ``min_documents`` documents or more goes, except in the document with the largest doc_id that
    holds it, where all its lines stay. Other lines stay, joined by \n.

    * Documents are told apart by doc_id: rows with the same doc_id count once, a NULL doc_id as
      one document before all others. Keys are compared by 128 bits of hash.
    * NULL and '' are one empty line; their kept_text is ''. A document that loses all its lines stays, with kept_text ''.
    * One row per row of ``docs``; its other columns stay, but for those named like a result.
    """
    docs = docs.drop("n_lines", "n_dropped", "bitmap", "kept_text")
    kd, kt, places = free_names(docs.columns, "d", "t", "gone")
    gone = dropped_lines(docs, min_chars, min_documents, doc_id, text).withColumnsRenamed({"d": kd, "t": kt})
    d, t = _row_key(doc_id, text)
    marked = docs.select("*", d.alias(kd), t.alias(kt)).join(gone, [kd, kt], "left").drop(kd, kt)
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marked = marked.withColumn(places, _places(F.col("bitmap")))

    def without(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(places))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    kept = let(lines_of(F.col(text)), without)
    n_lines = F.length(content) - F.length(F.translate(content, "\n", "")) + 1
    return marked.select(
        *[F.col(f"`{c}`") for c in docs.columns], n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_dropped"), "bitmap",
        F.when(F.col("bitmap").isNull(), content).otherwise(kept).alias("kept_text"))
