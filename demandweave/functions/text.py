"""Text cleaning, comparison keys and hashes as column expressions."""

from __future__ import annotations

import html
import string

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandweave.fixed_values import SURROGATE_NULL

# White space of Unicode, and the four ASCII separators that Python strips as well.
_SPACE_SET = r"\s\x1c-\x1f"
SPACES = f"(?U)[{_SPACE_SET}]+"
NOT_SPACE = f"(?U)[^{_SPACE_SET}]"
# White space that is to become one space and is not one already: at a single space nothing has to be replaced.
ODD_SPACES = f"(?U)[{_SPACE_SET}](?<! (?![{_SPACE_SET}]))[{_SPACE_SET}]*+"
OUTER_SPACES = f"(?U)^[{_SPACE_SET}]+|[{_SPACE_SET}]+$"

# One by one, as Java looks single characters up in a table.
NOT_KEY = f"[^{string.ascii_lowercase}{string.digits}]+"

# A character reference as HTML5 reads it: decimal, hexadecimal or named (up to 32 characters).
CHARACTER_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
TAG = r"<[^>]+>"


@F.arrow_udf(T.ArrayType(T.StringType()))
def _decode_references(refs: pa.Array) -> pa.Array:
    """Decode lists of character references; each distinct one of a batch once."""
    values = refs.flatten().dictionary_encode()
    decoded = pa.array([html.unescape(r) for r in values.dictionary.to_pylist()], pa.string())
    ends = pa.compute.cumulative_sum(pa.compute.fill_null(refs.value_lengths(), 0))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, decoded.take(values.indices))


def decode_entities(text: Column) -> Column:
    """Replace HTML character references in one pass (decoded text is not decoded again).

    The text itself stays in the JVM: only the references found in it, mostly none, go to
    Python, where the standard library knows the HTML5 names.
    """
    refs = _decode_references(F.regexp_extract_all(text, F.lit(CHARACTER_REFERENCE), F.lit(0)))
    pieces = F.split(text, CHARACTER_REFERENCE, -1)
    joined = F.array_join(
        F.zip_with(pieces, refs, lambda piece, ref: F.concat(piece, F.coalesce(ref, F.lit("")))), ""
    )
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def strip_html(text: Column) -> Column:
    """HTML, possibly entity-encoded, to plain text: entities first, then tags, then spaces."""
    decoded = decode_entities(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(decoded, TAG, " "), ODD_SPACES, " "))


def normalize_for_key(text: Column) -> Column:
    """Lower case, everything but a-z and 0-9 to single spaces, trimmed; NULL gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_KEY, " "))


def dedup_hash(company: Column, title: Column, location: Column) -> Column:
    """Content hash of a posting, equal across sources: upper-case hex SHA-256."""
    key = F.concat_ws("|", *[normalize_for_key(c) for c in (company, title, location)])
    return F.upper(F.sha2(key, 256))


def make_job_id(source: Column, source_job_id: Column) -> Column:
    """Stable key of a posting: lower-case hex SHA-256 of its source and its id there."""
    return F.sha2(F.concat(source, F.lit("|"), source_job_id), 256)


def surrogate_key(*cols: Column) -> Column:
    """MD5 over the text of the columns, NULL marked."""
    texts = [F.coalesce(c.cast("string"), F.lit(SURROGATE_NULL)) for c in cols]
    return F.md5(F.concat_ws("-", *texts))


def looks_remote(text: Column) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit("remote")), F.lit(False))


def not_blank(text: Column) -> Column:
    """The text if it has anything but white space, else NULL."""
    return F.when(text.rlike(NOT_SPACE), text)


def not_empty(text: Column) -> Column:
    """The text if it is not '', else NULL."""
    return F.nullif(text, F.lit(""))


def fold_name(name: Column) -> Column:
    """A skill name for comparison: outer white space off, lower case."""
    return F.lower(F.regexp_replace(name, OUTER_SPACES, ""))


def contains_ignoring_case(text: Column, part: str) -> Column:
    """Literal substring test; wildcards in ``part`` mean themselves."""
    return F.contains(F.lower(text), F.lit(part.lower()))
