"""Table classes by keyword scores, and their refinement by the shape of headers and cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.config import Config
from leafmill.functions.text import score_of
from leafmill.operators.markdown import table_lines

# Patterns of dosing tables.
WEIGHT_CELL = "(\\d+\\.?\\d*)\\s*(?:to|[-–])\\s*<?=?\\s*(\\d+\\.?\\d*)|[>≥]=?\\s*\\d+\\.?\\d*|<\\s*\\d+\\.?\\d*"
DOSE_CELL = "(?i)\\d+\\.?\\d*\\s*\\+\\s*\\d+\\.?\\d*|\\d+\\.?\\d*\\s*mg|\\d+\\.?\\d*\\s*/\\s*\\d+\\.?\\d*"
DOSING_HEADER = "(?i)body\\s*weight|weight\\s*\\(kg\\)|dose\\s*\\(mg|single\\s*dose|mg\\s*base|mg/kg|tablet|daily\\s*for\\s*\\d+\\s*days"
# Class to kind of chunk; any other class is another table.
CHUNK_KINDS = {"dosing": "dosing_table", "evidence": "evidence_table", "structural": "structural_table", "clinical_management": "clinical_table"}


def scores(markdown: Column, config: Config) -> dict[str, Column]:
    return {
        "dosing": score_of(markdown, config.table_words),
        "evidence": score_of(markdown, config.evidence_words),
        "structural": score_of(markdown, config.structural_words),
        "clinical_management": score_of(markdown, config.clinical_words),
    }


def table_class(markdown: Column, config: Config) -> Column:
    """The class with most keywords if it has two; of equals the earlier one.

    One clinical keyword is enough where no dosing keyword occurs. Null for null.
    """
    s = scores(markdown, config)
    top = F.greatest(*s.values())
    best = F.lit(None)
    for name, n in reversed(s.items()):
        best = F.when(n == top, F.lit(name)).otherwise(best)
    lone = (s["clinical_management"] >= 1) & (s["dosing"] == 0)
    return F.when(markdown.isNull(), None).when(top >= 2, best).when(lone, F.lit("clinical_management")).otherwise(F.lit("other"))


def refined_class(markdown: Column, old: Column) -> Column:
    """`old`, unless a dosing table lacks the patterns of one."""
    weight, dose = markdown.rlike(WEIGHT_CELL), markdown.rlike(DOSE_CELL)
    header = F.coalesce(F.get(table_lines(markdown), F.lit(0)).rlike(DOSING_HEADER), F.lit(False))
    new = (
        F.when(header & (weight | dose), old).when(~weight & ~dose, F.lit("structural")).when(~weight, F.lit("dosing (no weight bands)")).otherwise(old)
    )
    return F.when(old == "dosing", new).otherwise(old)


def chunk_kind(final_class: Column) -> Column:
    out = F.lit("other_table")
    for name, kind in CHUNK_KINDS.items():
        out = F.when(final_class == name, F.lit(kind)).otherwise(out)
    return out


def table_issues(markdown: Column, klass: Column) -> Column:
    """Quality issues of a table as an array of short codes."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: F.contains(x, F.lit("|")))
    data = F.filter(lines, lambda x: ~F.contains(x, F.lit("---")))
    data = F.slice(data, F.lit(2), F.greatest(F.size(data) - 1, F.lit(0)))

    def gap(line: Column) -> Column:
        cells = F.split(line, "\\|")
        inner = F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 2, F.lit(0)))
        return F.exists(inner, lambda c: F.regexp_replace(c, "^\\s+|\\s+$", "") == "")

    dosing = klass == "dosing"
    return F.array_compact(
        F.array(
            F.when(F.length(F.regexp_replace(markdown, "^\\s+|\\s+$", "")) < 10, F.lit("nearly empty")),
            F.when(F.size(lines) < 2, F.lit("missing header row")),
            F.when(dosing & F.exists(data, gap), F.lit("empty cells")),
            F.when(dosing & ~markdown.rlike("[≥≤<>±]"), F.lit("missing comparison signs")),
        )
    )
