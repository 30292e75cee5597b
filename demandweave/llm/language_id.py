"""Language ID by compression: the language whose dictionary makes a text smallest.

A language is a raw-content dictionary for zstandard: pieces of its documents, one after the other.
A text is encoded once with each dictionary, in blocks, and the bytes are added up over the whole
text. A dictionary saves what it shares with the text, so the smallest sum names the language; if
the next one is hardly larger, the text is rejected.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandweave.llm.staging import settle

DICTIONARY_BYTES = 32 << 10  # of a language
TOTAL_BYTES = 64 << 20  # of all dictionaries: with more than 2,048 languages each gets less
PIECE = 1024  # characters that one document gives to a dictionary
SAMPLE = 128  # documents of a language that are asked for a piece
BLOCK = 4096  # bytes that are encoded at once
SHORT = 1024  # texts of fewer bytes are encoded with more effort
LEVEL, SHORT_LEVEL = 6, 12
MARGIN = 0.02  # the next language must need so much more
SHARPNESS = 40.0
UNKNOWN = "und"


def letters_of(text: Column) -> Column:
    """The words of a text in lower case, parted by blanks; '' if it is NULL or has no letter."""
    low = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{M}]+", " ")
    return F.when(low.rlike(r"\p{L}"), F.trim(low)).otherwise("")


def held_out_of(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_dictionaries(
    docs: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES, sample: int = SAMPLE, lang: str = "lang", text: str = "text",
) -> dict[str, bytes]:
    """Language to dictionary, from the rows of ``docs``.

    At most ``sample`` different texts of a language, those with the smallest hash, give a piece of at
    most ``PIECE`` characters each, from a place that depends on the hash; pieces in order of the hash
    fill the dictionary. Rows without a language or a letter give nothing.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    known = docs.select(F.col(lang).cast("string").alias("lang"), content.alias("text"), F.xxhash64(content).alias("h")).filter("lang IS NOT NULL")
    # A share of the hashes that holds about 4 * sample texts, so no task passes on more than its part.
    # Settled tables are small files here, so Spark knows that it may broadcast them.
    texts = settle(known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")))
    share = F.least(F.lit(1.0), F.lit(4.0 * sample) / F.greatest("n", F.lit(1)))
    few = known.select("lang", "h").join(texts, "lang").filter(F.pmod(F.xxhash64(F.lit(7), "h"), F.lit(1 << 32)) < share * (1 << 32))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    keys = settle(few.select("lang", "h").distinct().withColumn("place", place).filter(F.col("place") <= sample))
    words = known.join(keys, ["lang", "h"]).select("lang", "place", "h", letters_of(F.col("text")).alias("w"))
    start = F.pmod("h", F.greatest(F.length("w") - PIECE + 1, F.lit(1))) + 1
    pieces = words.filter("w <> ''").select("lang", "place", F.col("w").substr(start.cast("int"), F.lit(PIECE)).alias("piece"))
    chosen = settle(pieces.groupBy("lang", "place").agg(F.min("piece").alias("piece")))  # copies of a text give one piece
    each = dictionary_bytes
    languages = chosen.select("lang").distinct().count()
    if languages * each > TOTAL_BYTES:
        each = max(256, TOTAL_BYTES // languages)
        chosen = chosen.filter(F.col("place") <= max(1, 2 * each // PIECE))
    held: dict[str, list[bytes]] = {}
    each = dictionary_bytes
    languages = chosen.select("lang").distinct().count()
    if languages * each > TOTAL_BYTES:
        each = max(256, TOTAL_BYTES // languages)
        chosen = chosen.filter(F.col("place") <= max(1, 2 * each // PIECE))
    for row in chosen.orderBy("lang", "place").toLocalIterator():
        held.setdefault(row.lang, []).append(row.piece.encode())
    return {name: b" ".join(parts)[:each] for name, parts in held.items()}


class Encoder:
    """Sizes of a text under each dictionary."""

    def __init__(self, dictionaries: Mapping[str, bytes]):
        self.names = sorted(dictionaries)
        self.known = [frozenset(dictionaries[n].split()) for n in self.names]
        self.by_level = {level: [self._compressor(dictionaries[n], level) for n in self.names] for level in (LEVEL, SHORT_LEVEL)}

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        # zstandard takes no dictionary of fewer than 8 bytes.
        held = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, text: bytes) -> list[int]:
        used = self.by_level[SHORT_LEVEL if len(text) < SHORT else LEVEL]
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in used]

    def judge(self, text: bytes) -> tuple[str, float, float]:
        """(language, score, margin). Of equal sizes, the dictionary with more of the text's words is first."""
        sizes = self.sizes(b" " + text + b" ")
        least = min(sizes)
        tied = [i for i, s in enumerate(sizes) if s == least]
        if len(tied) > 1:
            words = text.split()
            best = max(tied, key=lambda i: (sum(len(w) for w in words if w in self.known[i]), -i))
        else:
            best = tied[0]
        others = sizes[:best] + sizes[best + 1 :]
        margin = (min(others) - least) / least if others else 1.0
        share = np.exp(-SHARPNESS * (np.array(sizes) / least - 1))
        return self.names[best], float(1 / share.sum()), margin


@functools.lru_cache(2)
def _encoder(dictionaries: tuple[tuple[str, bytes], ...]) -> Encoder:
    return Encoder(dict(dictionaries))


def _predict(dictionaries: tuple[tuple[str, bytes], ...]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(dictionaries)
        for batch in batches:
            texts = batch.column("words").cast(pa.large_binary())
            found = [
                encoder.judge(t.as_py()) if len(t.as_buffer() or b"") and encoder.names else (UNKNOWN, 0.0, 0.0)
                for t in texts
            ]
            name, score, margin = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(name, pa.string()),
                 pa.array(score, pa.float64()), pa.array(margin, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score", "margin"])

    return task


def predict(
    docs: DataFrame, dictionaries: Mapping[str, bytes], margin: float = MARGIN, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), margin, rejected for each row of ``docs``.

    ``margin``: how much more the next language needs, as a share of the smallest size (1 if there
    is one language only); ``rejected`` if that is below ``margin``, or nothing could be predicted.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out_of(F.col(doc_id)).alias("held_out"), letters_of(F.col(text)).alias("words"))
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema[0].dataType.simpleString()
    found = rows.mapInArrow(
        _predict(tuple(sorted(dictionaries.items()))),
        f"doc_id {kind}, held_out boolean, lang_pred string, score double, margin double")
    return found.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("margin") < margin))


def identify_languages(
    docs: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES, sample: int = SAMPLE, margin: float = MARGIN,
    doc_id: str = "doc_id", lang: str = "lang", text: str = "text",
) -> DataFrame:
    """``predict`` for all rows of ``docs``, learned from those whose crc32(doc_id as text) mod 4 is not 2.

    * NULL and empty texts and those without a letter are ``und``, with score and margin 0, rejected; so
      are all texts if no row to learn from has a language and a letter.
    * Languages of equal size: the one whose dictionary holds more of the text's words, then by name.
    * A NULL doc_id is never held out. Rows without a language are predicted, not learned from. Copies
      of a text count once in a dictionary.
    * The dictionaries are bounded by ``dictionary_bytes`` a language and ``TOTAL_BYTES`` in all.
    * One row per row of ``docs``, repeated rows included; other columns are ignored.
    """
    known = docs.filter(~held_out_of(F.col(doc_id))).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return predict(docs, fit_dictionaries(known, dictionary_bytes, sample), margin, doc_id, text)
