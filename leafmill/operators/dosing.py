"""Dosing tables: parsing and six plausibility checks.

A table is one row whose body is an array of rows, so every check is a fold over that row with
higher-order functions: nothing is shuffled, whatever the number of tables.
Checks that don't apply pass and are marked as skipped. Null or headless text: not parsed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.bands import band_strict, dose_values, midpoint
from leafmill.functions.text import let
from leafmill.operators.markdown import table_lines, tight_cells

#: Largest gap between bands; ages covered; tolerance of dose bounds and of ratios.
GAP_KG, LOW_KG, HIGH_KG = 0.5, 10.0, 35.0
BOUND_TIMES, RATIO_SHARE = 2.5, 0.35
CHECKS = ("contiguity", "monotonic", "coverage", "bounds", "ratio", "positive")


def parse_dosing(df: DataFrame, key: str, markdown: str, drugs: Sequence[str] = ()) -> DataFrame:
    """(key, heads, weight_col, dose_cols, body): body is an array of rows with weight cell,
    band and, for each dose column, cell and values."""
    lines = df.select(key, table_lines(F.col(markdown)).alias("lines")).where(F.size("lines") >= 2)
    heads = lines.withColumn("heads", tight_cells(F.get("lines", F.lit(0))))
    places = F.sequence(F.lit(0), F.size("heads") - 1)
    low = lambda i: F.lower(F.get("heads", i))
    weight = F.get(F.filter(places, lambda i: F.contains(low(i), F.lit("weight"))), F.lit(0))
    heads = heads.where(F.size("heads") > 0).withColumn("weight_col", weight)

    def named(i: Column) -> Column:
        hit = F.contains(low(i), F.lit("dose")) | F.contains(low(i), F.lit("mg")) | F.contains(low(i), F.lit("tablet"))
        for d in drugs:
            hit = hit | F.contains(low(i), F.lit(d.lower()))
        return hit

    not_weight = lambda i: F.col("weight_col").isNull() | (i != F.col("weight_col"))
    by_name = F.filter(places, lambda i: not_weight(i) & named(i))
    others = F.filter(places, not_weight)
    dose_cols = F.when((F.size(by_name) == 0) & F.col("weight_col").isNotNull(), others).otherwise(by_name)
    heads = heads.withColumn("dose_cols", dose_cols)

    def row(line: Column) -> Column:
        def read(cells: Column, weight_cell: Column) -> Column:
            doses = F.transform("dose_cols", lambda c: F.coalesce(F.get(cells, c), F.lit("")))
            return F.struct(
                weight_cell.alias("weight_cell"),
                F.when(weight_cell != "", band_strict(weight_cell)).alias("band"),
                F.transform(doses, lambda d: F.struct(d.alias("cell"), dose_values(d).alias("values"))).alias("doses"),
                F.size(cells).alias("n_cells"),
            )

        return let(tight_cells(line), lambda cells: let(F.coalesce(F.get(cells, F.col("weight_col")), F.lit("")), lambda w: read(cells, w)))

    data = F.slice("lines", F.lit(2), F.size("lines") - 1)
    body = F.filter(F.transform(data, row), lambda r: r["n_cells"] > 0)
    return heads.select(key, "heads", "weight_col", "dose_cols", body.alias("body"))


def _count(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda x: x))


def with_arrays(parsed: DataFrame) -> DataFrame:
    """`parsed` with `bands`, and `columns`: for each dose column, the array of value arrays by row.

    All checks read these, so no check goes over the body again.
    """
    places = F.when(F.size("dose_cols") > 0, F.sequence(F.lit(0), F.size("dose_cols") - 1)).otherwise(F.array().cast("array<int>"))
    columns = F.transform(places, lambda j: F.transform("body", lambda r: F.get(r["doses"], j)["values"]))
    return parsed.withColumn("bands", F.filter(F.transform("body", lambda r: r["band"]), lambda b: b.isNotNull())).withColumn("columns", columns)


def contiguity_issues() -> Column:
    """Gaps or overlaps of more than half a kilogram, and open bands before the last."""
    b = F.col("bands")
    bad = lambda x, y: x["high"].isNull() | (F.abs(x["high"] - y["low"]) > GAP_KG)
    pairs = F.zip_with(F.slice(b, F.lit(1), F.greatest(F.size(b) - 1, F.lit(0))), F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))), lambda x, y: F.coalesce(bad(x, y), F.lit(False)))
    return F.when(F.size(b) < 2, 0).otherwise(_count(pairs))


def _per_dose_column(count: callable) -> Column:
    return F.aggregate(F.transform("columns", count), F.lit(0), lambda a, x: a + x)


def monotonic_issues() -> Column:
    """Strict decreases of a component against the last row that has it."""

    def column(vals: Column) -> Column:
        width = F.coalesce(F.array_max(F.transform(vals, F.size)), F.lit(0))
        parts = let(width, lambda w: F.when(w > 0, F.sequence(F.lit(0), w - 1)).otherwise(F.array().cast("array<int>")))

        def part(k: Column) -> Column:
            line = F.transform(F.filter(vals, lambda v: F.size(v) > k), lambda v: F.get(v, k))
            pairs = lambda x: F.zip_with(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), lambda p, q: F.coalesce(q < p, F.lit(False)))
            return let(line, lambda x: _count(pairs(x)))

        return F.aggregate(F.transform(parts, part), F.lit(0), lambda a, x: a + x)

    return _per_dose_column(column)


def coverage_issues() -> Column:
    """A first band that starts too high; a last one that ends too low or opens too early."""
    b = F.col("bands")
    low, last = F.get(b, F.lit(0))["low"], F.element_at(b, -1)
    late = (low > LOW_KG).cast("int")
    short = F.when(last["high"].isNotNull(), (last["high"] < HIGH_KG).cast("int")).otherwise((last["low"] < HIGH_KG * 0.5).cast("int"))
    return F.when(F.size(b) == 0, 0).otherwise(F.coalesce(late, F.lit(0)) + F.coalesce(short, F.lit(0)))


def bounds_issues(ranges: dict[str, tuple[float, float]]) -> Column:
    """Doses per kilogram outside the widened range of the drug named in the header.

    The k-th component belongs to the k-th drug of the header in the order of `ranges`.
    """
    if not ranges:
        return F.lit(0)
    known = F.array(*(F.struct(F.lit(d.lower()).alias("d"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for d, (lo, hi) in ranges.items()))

    def column(vals: Column, j: Column) -> Column:
        def checked(drugs: Column) -> Column:
            def row(v: Column, r: Column) -> Column:
                n = F.least(F.size(v), F.size(drugs))
                out = lambda x, k, mid: (x > 0) & ((x / mid < k["lo"] / BOUND_TIMES) | (x / mid > k["hi"] * BOUND_TIMES))
                bad = lambda mid: F.zip_with(F.slice(v, F.lit(1), n), F.slice(drugs, F.lit(1), n), lambda x, k: F.coalesce(out(x, k, mid), F.lit(False)))
                return F.when(r["band"].isNull() | (n <= 0), 0).otherwise(let(midpoint(r["band"]), lambda mid: F.when(mid <= 0, 0).otherwise(_count(bad(mid)))))

            # tables of drugs that no range is known for need no look at their rows
            return F.when(F.size(drugs) == 0, 0).otherwise(F.aggregate(F.zip_with(vals, F.col("body"), row), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))))

        return let(F.lower(F.get("heads", F.get("dose_cols", j))), lambda head: let(F.filter(known, lambda k: F.contains(head, k["d"])), checked))

    return F.aggregate(F.transform("columns", column), F.lit(0), lambda a, x: a + x)


def ratio_issues() -> Column:
    """Rows whose second to first component deviates from the upper median ratio."""

    def column(vals: Column) -> Column:
        def judged(ratios: Column) -> Column:
            mid = F.get(F.array_sort(ratios), F.floor(F.size(ratios) / F.lit(2)).cast("int"))
            return let(mid, lambda m: F.when((F.size(ratios) == 0) | (m <= 0), 0).otherwise(_count(F.transform(ratios, lambda r: F.abs(r - m) / m > RATIO_SHARE))))

        def of_two(two: Column) -> Column:
            ratios = F.transform(F.filter(two, lambda v: F.get(v, F.lit(0)) > 0), lambda v: F.get(v, F.lit(1)) / F.get(v, F.lit(0)))
            return F.when(F.size(two) < 2, 0).otherwise(let(ratios, judged))

        return let(F.filter(vals, lambda v: F.size(v) >= 2), of_two)

    return _per_dose_column(column)


def positive_issues() -> Column:
    """Empty weight and dose cells, and values that are not positive."""

    def row(r: Column) -> Column:
        dose = lambda d: F.when(d["cell"] == "", 1).otherwise(_count(F.transform(d["values"], lambda v: v <= 0)))
        return F.when(r["weight_cell"] == "", 1).otherwise(0) + F.aggregate(F.transform(r["doses"], dose), F.lit(0), lambda a, x: a + x)

    return F.aggregate(F.transform("body", row), F.lit(0), lambda a, x: a + x)


def dosing_checks(df: DataFrame, key: str, markdown: str, ranges: dict[str, tuple[float, float]], drugs: Sequence[str] = ()) -> DataFrame:
    """One row per table: parsed, bands, and the number of issues of each check."""
    parsed = with_arrays(parse_dosing(df, key, markdown, drugs or tuple(ranges))).withColumn("parsed", F.col("weight_col").isNotNull())
    counts = dict(zip(CHECKS, (contiguity_issues(), monotonic_issues(), coverage_issues(), bounds_issues(ranges), ratio_issues(), positive_issues()), strict=True))
    out = parsed.select(key, "parsed", F.size("bands").alias("bands"), F.size("body").alias("body_rows"), *(F.when(F.col("parsed"), c).otherwise(0).alias(n) for n, c in counts.items()))
    total = sum((F.col(n) for n in CHECKS), F.lit(0))
    return out.withColumn("passed", F.col("parsed") & (total == 0))


def check_report(checks: DataFrame) -> DataFrame:
    """(check, passed, failed): over all parsed tables."""
    long = checks.where("parsed").select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), (F.col(n) == 0).alias("ok")) for n in CHECKS))).alias("c")).select("c.*")
    return long.groupBy("check").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))
