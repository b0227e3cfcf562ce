"""Markdown tables as rows of cells, and their linearisation to sentences.

Lines that hold `---` are separators wherever they stand. All functions are projections:
nothing is shuffled. A null text gives null arrays and no exploded rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import let, strip


def table_lines(markdown: Column) -> Column:
    """Stripped, non-empty lines without separators; the first is the header."""
    lines = F.transform(F.split(markdown, "\n"), strip)
    return F.filter(lines, lambda x: (x != "") & ~F.contains(x, F.lit("---")))


def tight_cells(line: Column) -> Column:
    """Non-empty cells of a line; empty cells vanish, later ones move left."""
    return F.filter(F.transform(F.split(line, "\\|"), strip), lambda c: c != "")


def wide_cells(line: Column) -> Column:
    """Cells of a line with inner empty ones; only an empty first and last one go."""
    cells = F.transform(F.split(line, "\\|"), strip)
    start = F.when(F.get(cells, F.lit(0)) == "", 2).otherwise(1)
    stop = F.size(cells) - F.when(F.element_at(cells, -1) == "", 1).otherwise(0)
    return F.slice(cells, start, F.greatest(stop - start + 1, F.lit(0)))


def table_cells(df: DataFrame, key: str, markdown: str, keep_empty: bool = False) -> DataFrame:
    """(key, row_no, col_no, cell), from 0; row 0 is the header."""
    split = wide_cells if keep_empty else tight_cells
    rows = df.select(key, F.posexplode(table_lines(F.col(markdown))).alias("row_no", "line"))
    return rows.select(key, "row_no", F.posexplode(split(F.col("line"))).alias("col_no", "cell"))


def linearised(markdown: Column) -> Column:
    """One sentence a row: "IF <header> is <cell>, THEN <header> is <cell>, ... ."

    A row with one cell has no full stop; a text without header or data comes back unchanged.
    """
    def sentence(line: Column, heads: Column) -> Column:
        def told(cells: Column) -> Column:
            n = F.least(F.size(heads), F.size(cells))
            pairs = F.zip_with(F.slice(heads, F.lit(1), n), F.slice(cells, F.lit(1), n), lambda h, c: F.concat(h, F.lit(" is "), c))
            rest = lambda x: F.array_join(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), ", ")
            return let(pairs, lambda x: F.when(F.size(x) > 1, F.concat(F.lit("IF "), F.get(x, F.lit(0)), F.lit(", THEN "), rest(x), F.lit("."))).when(F.size(x) == 1, F.concat(F.lit("IF "), F.get(x, F.lit(0)))))

        return let(tight_cells(line), told)

    def whole(lines: Column) -> Column:
        data = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
        made = let(tight_cells(F.get(lines, F.lit(0))), lambda heads: F.array_join(F.array_compact(F.transform(data, lambda x: sentence(x, heads))), "\n"))
        return F.when(F.size(lines) == 0, F.lit("")).when(F.size(lines) == 1, markdown).otherwise(made)

    # the lines and the header's cells are worked out once a table, not once a row
    return F.when(markdown.isNotNull(), let(table_lines(markdown), whole))


def markdown_of(headers: Column, rows: Column) -> Column:
    """A Markdown table from an array of headers and an array of arrays of cells."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))
    rule = F.transform(headers, lambda _: F.lit("---"))
    return F.array_join(F.concat(F.array(line(headers), line(rule)), F.transform(rows, line)), "\n")
