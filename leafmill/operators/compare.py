"""Cell-level comparison of two extractions of the same tables, and joining of tables that a
page break divides. Keys are columns of equality joins throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import clean_cell, norm_cell
from leafmill.operators.markdown import table_cells, table_lines, wide_cells


def _grid(df: DataFrame, on: Sequence[str], key: str, markdown: str, side: str) -> DataFrame:
    """(on, side_key, side_rows): each table's cells as an array of rows."""
    rows = F.transform(table_lines(F.col(markdown)), wide_cells)
    return df.select(*on, F.col(key).alias(f"{side}_key"), rows.alias(f"{side}_rows"))


def cell_agreement(left: DataFrame, right: DataFrame, on: Sequence[str], key: str, markdown: str) -> DataFrame:
    """(on, left_key, right_key, matches, total, agreement): each left table with its best match.

    Tables of both sides that agree in `on` are compared place by place after normalisation; a
    cell missing on one side counts as empty. The right table with most matches is the best,
    of equals the one with the smaller key. Tables without a partner have no row. A pair of tables
    is one row, compared in one pass over their cells.
    """
    normal = lambda df, side: _grid(df, on, key, markdown, side).withColumn(f"{side}_rows", F.transform(f"{side}_rows", lambda r: F.transform(r, norm_cell)))
    count = lambda rows: F.aggregate(rows, F.lit(0).cast("bigint"), lambda n, r: n + F.size(r))
    a = normal(left, "left").withColumn("left_n", count("left_rows")).where("left_n > 0")
    b = normal(right, "right").withColumn("right_n", count("right_rows")).where("right_n > 0")
    least = F.least(F.size("left_rows"), F.size("right_rows"))
    lines = F.zip_with(F.slice("left_rows", F.lit(1), least), F.slice("right_rows", F.lit(1), least), lambda x, y: F.struct(
        F.least(F.size(x), F.size(y)).alias("both"),
        F.size(F.filter(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), lambda same: same)).alias("same"),
    ))
    zero = F.struct(F.lit(0).cast("bigint").alias("both"), F.lit(0).cast("bigint").alias("matches"))
    told = F.aggregate(lines, zero, lambda n, x: F.struct((n["both"] + x["both"]).alias("both"), (n["matches"] + x["same"]).alias("matches")))
    scored = a.join(b, list(on)).select(*on, "left_key", "right_key", "left_n", "right_n", told.alias("told"))
    rank = F.struct((-F.col("told.matches")).alias("worst"), "right_key")
    best = scored.groupBy(*on, "left_key").agg(F.min_by(F.struct("right_key", "told.matches", (F.col("left_n") + F.col("right_n") - F.col("told.both")).alias("total")), rank).alias("b"))
    return best.select(*on, "left_key", "b.right_key", "b.matches", "b.total", F.round(100.0 * F.col("b.matches") / F.col("b.total"), 6).alias("agreement"))


def cell_differences(left: DataFrame, right: DataFrame, best: DataFrame, on: Sequence[str], key: str, markdown: str) -> DataFrame:
    """(left_key, right_key, row_no, col_no, left_cell, right_cell): places where best pairs differ."""
    a, b = _grid(left, [], key, markdown, "left"), _grid(right, [], key, markdown, "right")
    pairs = best.select("left_key", "right_key").join(a, "left_key").join(b, "right_key")
    none = F.array().cast("array<string>")
    # zip_with fills the shorter side with nulls
    lines = F.zip_with("left_rows", "right_rows", lambda x, y: F.zip_with(F.coalesce(x, none), F.coalesce(y, none), lambda p, q: F.struct(F.coalesce(p, F.lit("")).alias("left_cell"), F.coalesce(q, F.lit("")).alias("right_cell"))))
    rows = pairs.select("left_key", "right_key", F.posexplode(lines).alias("row_no", "line"))
    cells = rows.select("left_key", "right_key", "row_no", F.posexplode("line").alias("col_no", "c")).select("left_key", "right_key", "row_no", "col_no", "c.*")
    return cells.where(norm_cell(F.col("left_cell")) != norm_cell(F.col("right_cell")))


def page_break_pairs(tables: DataFrame, page_height: float = 842.0, low: float = 0.90, high: float = 0.10) -> DataFrame:
    """(doc_id, engine, page, upper_id, lower_id, num_cols): tables that a page break divides.

    The upper one ends in the lowest tenth of a page, the lower one begins in the highest tenth
    of the next, and both have as many columns. Every such pair comes out. `tables` has doc_id,
    engine, page, id, num_cols, bbox; rows with a null among these are in no pair.
    """
    t = tables.where(F.size("bbox") >= 4)
    up = t.where(F.get("bbox", F.lit(3)) / page_height >= low).select("doc_id", "engine", "page", "num_cols", F.col("id").alias("upper_id"))
    down = t.where(F.get("bbox", F.lit(1)) / page_height <= high).select("doc_id", "engine", (F.col("page") - 1).alias("page"), "num_cols", F.col("id").alias("lower_id"))
    return up.join(down, ["doc_id", "engine", "page", "num_cols"]).where("upper_id <> lower_id")


def stitched_rows(pairs: DataFrame, tables: DataFrame, key: str, markdown: str) -> DataFrame:
    """(upper_id, lower_id, row_no, col_no, cell): the rows of each divided table in one.

    The upper header stays the header. The lower header becomes a data row unless it repeats
    the upper one. Cells are cleaned of line breaks.
    """
    ids = pairs.select("upper_id", "lower_id")
    divided = ids.select(F.explode(F.array("upper_id", "lower_id")).alias(key)).distinct()
    own = tables.select(key, markdown).join(divided, key, "left_semi")  # only their cells are worked out
    cells = table_cells(own, key, markdown, keep_empty=True).withColumn("cell", clean_cell(F.col("cell")))
    rows = cells.groupBy(key, "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "cell"))), lambda x: x["cell"]).alias("cells"))
    upper = ids.join(rows.withColumnRenamed(key, "upper_id"), "upper_id").select("upper_id", "lower_id", F.lit(0).alias("part"), "row_no", "cells")
    lower = ids.join(rows.withColumnRenamed(key, "lower_id"), "lower_id").select("upper_id", "lower_id", F.lit(1).alias("part"), "row_no", "cells")
    heads = upper.where("row_no = 0").select("upper_id", "lower_id", F.col("cells").alias("head"))
    lower = lower.join(heads, ["upper_id", "lower_id"], "left").where(~((F.col("row_no") == 0) & F.col("cells").eqNullSafe(F.col("head")))).drop("head")
    order = Window.partitionBy("upper_id", "lower_id").orderBy("part", "row_no")
    whole = upper.unionByName(lower).withColumn("row_no", F.row_number().over(order) - 1)
    return whole.select("upper_id", "lower_id", "row_no", F.posexplode("cells").alias("col_no", "cell"))
