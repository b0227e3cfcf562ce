"""Weight bands and doses written in table cells, as struct<low double, high double>.

An open band has a null `high`; a cell that is no band is null. The three parsers belong to
three stages and differ on purpose. Numbers that can't be read (such as "1.2.3") give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_N = "([\\d.]+)"


def _double(text: Column) -> Column:
    return text.try_cast("double")


def _band(low: Column, high: Column) -> Column:
    return F.struct(low.alias("low"), high.alias("high"))


def _two(cell: Column, pattern: str) -> Column:
    return _band(_double(F.regexp_extract(cell, pattern, 1)), _double(F.regexp_extract(cell, pattern, 2)))


def _open(cell: Column, pattern: str) -> Column:
    return _band(_double(F.regexp_extract(cell, pattern, 1)), F.lit(None).cast("double"))


def _below(cell: Column, pattern: str) -> Column:
    return _band(F.lit(0.0), _double(F.regexp_extract(cell, pattern, 1)))


def _first(cell: Column, rules: list[tuple[str, str]]) -> Column:
    kinds = {"two": _two, "open": _open, "below": _below}
    out = F.lit(None).cast("struct<low double, high double>")
    for kind, pattern in reversed(rules):
        out = F.when(cell.rlike(pattern), kinds[kind](cell, pattern)).otherwise(out)
    return out


def band_strict(cell: Column) -> Column:
    """The plausibility stage's parser: a footnote letter a-d at the end is dropped."""
    c = F.regexp_replace(F.regexp_replace(cell, "^\\s+|\\s+$", ""), "\\s*[a-dA-D]\\s*$", "")
    c = F.translate(F.replace(F.replace(c, F.lit("≥"), F.lit(">=")), F.lit("≤"), F.lit("<=")), "–—", "--")
    return _first(
        c,
        [
            ("two", f"^>\\s*{_N}\\s*to\\s*<=?\\s*{_N}"),
            ("two", f"^{_N}\\s*(?:to|-)\\s*<=?\\s*{_N}"),
            ("two", f"^{_N}\\s*<\\s*{_N}"),
            ("open", f"^>=?\\s*{_N}"),
            ("below", f"^<=?\\s*{_N}"),
        ],
    )


def band_first(cell: Column) -> Column:
    """The extraction stage's parser: takes "5 to 10" too, but reads "60 < 80" as below 60."""
    c = F.regexp_replace(cell, "^\\s+|\\s+$", "")
    c = F.translate(F.replace(F.replace(c, F.lit("≥"), F.lit(">=")), F.lit("≤"), F.lit("<=")), "–", "-")
    upper = f"^<?=?\\s*{_N}"
    rules = _first(c, [("two", f"^{_N}\\s*(?:to|-)\\s*<?=?\\s*{_N}"), ("open", f"^>=?\\s*{_N}")])
    return F.coalesce(rules, F.when(c.rlike(upper) & c.contains("<"), _below(c, upper)))


def band_loose(cell: Column) -> Column:
    """The chunking stage's parser: a letter and "kg" at the end are dropped, patterns float."""
    c = F.regexp_replace(F.regexp_replace(cell, "^\\s+|\\s+$", ""), "\\s*[a-zA-Z]\\s*$", "")
    c = F.regexp_replace(F.regexp_replace(c, "(?i)\\s*kg\\s*$", ""), "^\\s+|\\s+$", "")
    return _first(
        c,
        [
            ("below", f"^<\\s*{_N}"),
            ("two", f"{_N}\\s*(?:to|–|-)\\s*<\\s*{_N}"),
            ("two", f"{_N}\\s*(?:to|–|-)\\s*{_N}"),
            ("two", f">\\s*{_N}\\s*(?:to|–|-)\\s*≤\\s*{_N}"),
            ("two", f"{_N}\\s*<\\s*{_N}"),
            ("open", f"[≥>]=?\\s*{_N}"),
        ],
    )


def dose_values(cell: Column) -> Column:
    """All numbers of a cell, in order; empty for a cell without any."""
    return F.transform(F.regexp_extract_all(F.coalesce(cell, F.lit("")), F.lit("([0-9]+\\.?[0-9]*)"), F.lit(1)), lambda x: x.try_cast("double"))


def midpoint(band: Column) -> Column:
    """Typical weight of a band: open bands 20 above, bands from 0 half of the upper bound."""
    return (
        F.when(band["high"].isNull(), band["low"] + 20.0).when(band["low"] == 0.0, band["high"] / 2.0).otherwise((band["low"] + band["high"]) / 2.0)
    )
