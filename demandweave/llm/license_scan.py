"""License scan: short notices in texts, exact and with a bounded number of edits.

A notice that may differ by k edits is cut into k + 1 pieces; one of them at least stands in the
text as it is (the pigeonhole principle). One automaton finds the pieces of all notices in a
single pass; only around them a fuzzy pattern of the regex library decides, and reports where the
notice stands and how many edits it took.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame


class Notice(NamedTuple):
    label: str
    phrase: str  # lower-case words, one space between
    edits: int
    exact: tuple[str, ...] = ()  # words that tell it from other licences: they must stand, in this order, as they are


# Wording of well-known licences, as lower-case words.
NOTICES = (
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 8),
    Notice("mit", "licensed under the mit license", 3, ("mit",)),
    Notice("apache-2", "licensed under the apache license version 2 0", 4, ("apache", "version 2")),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 2, ("cc by nc",)),
    Notice("cc-by-nc", "creative commons attribution noncommercial 4 0 international", 5, ("attribution noncommercial",)),
    Notice("cc-by", "creative commons attribution 4 0 international", 4, ("attribution 4",)),
    Notice("gpl-3", "gnu general public license version 3", 3, ("gnu general", "version 3")),
    Notice("mpl-2", "mozilla public license version 2 0", 3, ("mozilla", "version 2")),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 8),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 7, ("and or",)),
    Notice("all-rights-reserved", "all rights reserved", 1),
)
# Phrases that are found as consecutive words.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Words are digits, letters and all beyond ASCII; A-Z is lower-cased, everything else parts words.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_text(text: bytes) -> bytes:
    """The words of a text with one space between."""
    return b" ".join(text.translate(_TO_WORDS).split())


def exact_places(words: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words at which the phrase starts."""
    padded, look, places = b" " + words + b" ", b" " + phrase + b" ", []
    at, word, counted = padded.find(look), 0, 0
    while at >= 0:
        word += padded.count(b" ", counted, at)
        counted = at
        places.append(word)
        at = padded.find(look, at + 1)
    return places


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 parts of a phrase with their offsets."""
    cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


def holds_in_order(words: str, parts: Sequence[str]) -> bool:
    """Whether the words hold all parts, one behind the other."""
    padded, at = f" {words} ", 0
    for part in parts:
        at = padded.find(f" {part} ", at)
        if at < 0:
            return False
        at += len(part) + 1
    return True


class FuzzyNotices:
    def __init__(self, notices: Sequence[Notice]):
        self.notices = notices
        # The best match in a window, with as few edits as can be.
        # It starts and ends with a word, so an edit can't cut one in two.
        self.patterns = [regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(n.phrase)}){{e<={n.edits}}}(?![^ ])") for n in notices]
        at: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            for offset, piece in pieces(n.phrase, n.edits):
                at.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in at.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of the places where a notice stands; those of one notice don't overlap."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, owners) in self.automaton.iter(text):
            for i, offset in owners:
                n, start = self.notices[i], end + 1 - size - offset
                low, high = max(0, start - n.edits), min(len(text), start + len(n.phrase) + n.edits)
                own = windows.setdefault(i, [])
                if own and low <= own[-1][1] and high >= own[-1][0]:
                    own[-1][0], own[-1][1] = min(own[-1][0], low), max(own[-1][1], high)
                else:
                    own.append([low, high])
        found = []
        for i, spans in windows.items():
            rest = [(low, self._word_end(text, high)) for low, high in spans]
            while rest:
                low, high = rest.pop()
                match = self.patterns[i].search(text, low, high)
                if match is None:
                    continue
                if holds_in_order(match.group().strip(), self.notices[i].exact):
                    found.append((i, match.start(), match.end(), sum(match.fuzzy_counts)))
                # The best match comes first; others may stand before and behind it.
                rest += [(low, match.start()), (max(match.end(), match.start() + 1), high)]
        return sorted(found)

    @staticmethod
    def _word_end(text: str, at: int) -> int:
        end = text.find(" ", at)
        return len(text) if end < 0 else end


def _scan(notices: Sequence[Notice], phrases: Sequence[tuple[str, str]]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fuzzy = FuzzyNotices(notices)
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = word_text(bytes(text.as_buffer())) if text.is_valid else b""
                starts = [(p, label) for phrase, label in phrases for p in exact_places(words, phrase.encode())]
                string = words.decode("utf-8", "replace")
                spans, score = [], 1.0 if starts else 0.0
                for i, start, end, edits in fuzzy.find(string):
                    n = notices[i]
                    score = max(score, 1 - edits / len(n.phrase))
                    spans.append({"label": n.label, "start": string.count(" ", 0, start), "end": string.count(" ", 0, end) + 1, "edits": edits})
                base, places = {label for _, label in starts}, [p for p, _ in starts]
                rows.append((
                    words.count(b" ") + 1 if words else 0, len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base)), ",".join(sorted(base | {s["label"] for s in spans})), score, spans))
            columns = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return task


def scan_licenses(
    docs: DataFrame, notices: Sequence[Notice] = NOTICES, phrases: Sequence[tuple[str, str]] = PHRASES,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Licences that each document names, one row per row of ``docs``.

    doc_id, n_words; n_base, first_word, last_word: places of ``phrases`` (words are counted from
    0; NULL without one); base_labels; labels: with those of the notices found with edits; score:
    1 for a phrase or a notice without edits, less by the share of edited characters, 0 for none;
    spans: label, first word, word behind the last, edits of each notice found.

    * NULL and '' have no words, no labels and a score of 0. Whole texts are read.
    * Edits never fall on the words that name the licence, its variant or version (``Notice.exact``).
    * Overlapping places of phrases count each. Repeated rows are judged alike. Other columns are ignored.
    """
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(
        _scan(tuple(notices), tuple(phrases)),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label: string, start: long, end: long, edits: long>>")
