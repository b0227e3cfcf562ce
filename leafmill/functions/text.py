"""Scalar text functions, all JVM-side. Null in, null out unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words to tokens of a language model, a rule of thumb.
TOKENS_PER_WORD = 1.3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is worked out once, however often the body (or a lambda in it) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends (line ends and tabs included)."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space to one space, ends stripped."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def token_estimate(text: Column) -> Column:
    """Word count times 1.3, truncated."""
    return F.floor(word_count(text) * F.lit(TOKENS_PER_WORD)).cast("int")


def search_terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and figures, longer than one character."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) > 1)


def norm_cell(cell: Column) -> Column:
    """A table cell for comparison: ASCII comparison signs and dashes, single spaces, lower case."""
    out = F.replace(F.replace(cell, F.lit("≥"), F.lit(">=")), F.lit("≤"), F.lit("<="))
    out = F.replace(F.translate(out, "–—×", "--x"), F.lit("±"), F.lit("+/-"))
    return F.lower(collapse(out))


def clean_cell(cell: Column) -> Column:
    """Line breaks, also written as tags, to spaces."""
    return collapse(F.regexp_replace(cell, "<br>|\\n", " "))


def any_of(text: Column, terms: Sequence[str]) -> Column:
    """Whether lower-cased `text` holds any term; false for no terms."""
    low, out = F.lower(text), F.lit(False)
    for t in terms:
        out = out | low.contains(t.lower())
    return out


def score_of(text: Column, terms: Sequence[str]) -> Column:
    """How many entries of `terms` occur in lower-cased `text`; an entry listed twice counts twice."""
    low, out = F.lower(text), F.lit(0)
    for t in terms:
        out = out + low.contains(t.lower()).cast("int")
    return out


def found_terms(text: Column, terms: Column) -> Column:
    """The entries of the array `terms` that `text` holds, whatever the case."""
    return F.filter(terms, lambda t: F.contains(F.lower(text), F.lower(t)))


def is_iso_time(text: Column) -> Column:
    """Whether a text is an ISO date or time (a zone may follow, Z included); false for null."""
    whole = "^\\d{4}-\\d{2}-\\d{2}(?:[T ]\\d{2}:\\d{2}(?::\\d{2}(?:\\.\\d{1,6})?)?(?:Z|[+-]\\d{2}:?\\d{2})?)?$"
    return F.coalesce(text.rlike(whole), F.lit(False)) & F.try_to_timestamp(text).isNotNull()


def audit_hash(content: Column) -> Column:
    """SHA-256 of the content; a null content hashes as the empty text."""
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def signature(*parts: Column) -> Column:
    """SHA-256 of the parts joined by bars; null parts are empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def cache_key(*parts: Column) -> Column:
    """16 hexadecimal digits that identify a source by its parts."""
    return F.left(signature(*parts), F.lit(16))
