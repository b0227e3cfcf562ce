"""Reports that combine other operators' results, and smaller rules that stand alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.config import CLINICAL_WORDS, Config
from leafmill.functions.bands import band_first
from leafmill.functions.text import any_of
from leafmill.operators.markdown import linearised, table_lines, tight_cells

# Words added to every generated list of clinical table words.
GENERIC_CLINICAL_WORDS = (
    "management", "clinical presentation", "diagnosis", "differential diagnosis", "classification", "assessment", "prevention",
    "counselling", "follow-up", "emergency", "stabilize", "stabilise",
)


def discrepancies(agreement: DataFrame, divided: DataFrame, changed: DataFrame) -> DataFrame:
    """(kind, id, detail): tables that agree less than fully, tables that a page break divides,
    and tables whose class changed (flagged ones are no discrepancy)."""
    a = agreement.where("agreement < 100").select(F.lit("cells").alias("kind"), F.col("left_key").alias("id"), F.floor("agreement").cast("string").alias("detail"))
    d = divided.select(F.lit("divided").alias("kind"), F.col("upper_id").alias("id"), F.col("lower_id").cast("string").alias("detail"))
    c = changed.where("new <> 'dosing (no weight bands)'").select(F.lit("class").alias("kind"), F.col("report_id").alias("id"), F.col("new").alias("detail"))
    return a.unionByName(d).unionByName(c)


def fingerprint(markdown: Column) -> Column:
    """The header line, bars as spaces, single spaces, lower case."""
    head = F.get(table_lines(markdown), F.lit(0))
    return F.lower(F.trim(F.regexp_replace(F.translate(head, "|", " "), "\\s+", " ")))


def first_checks(df: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, gaps, drops): the extraction stage's quick checks of a dosing table, on the first
    dose column and the first number of each cell, with its own band parser."""
    lines = df.select(key, table_lines(F.col(markdown)).alias("lines")).where(F.size("lines") >= 2).withColumn("heads", tight_cells(F.get("lines", F.lit(0)))).where(F.size("heads") > 0)
    places = F.sequence(F.lit(0), F.size("heads") - 1)
    low = lambda i: F.lower(F.get("heads", i))
    lines = lines.withColumn("w", F.get(F.filter(places, lambda i: F.contains(low(i), F.lit("weight"))), F.lit(0))).where("w is not null")
    dosed = F.filter(places, lambda i: (i != F.col("w")) & (F.contains(low(i), F.lit("dose")) | F.contains(low(i), F.lit("mg")) | F.contains(low(i), F.lit("tablet"))))
    lines = lines.withColumn("d", F.get(dosed, F.lit(0)))
    body = F.transform(F.slice("lines", F.lit(2), F.size("lines") - 1), tight_cells)
    bands = F.filter(F.transform(body, lambda r: band_first(F.get(r, F.col("w")))), lambda b: b.isNotNull())
    doses = F.filter(F.transform(body, lambda r: F.regexp_extract(F.coalesce(F.get(r, F.col("d")), F.lit("")), "([\\d.]+)", 1).try_cast("double")), lambda v: v.isNotNull())
    lines = lines.withColumn("bands", bands).withColumn("doses", doses)

    def count(items: str, bad) -> Column:
        n = F.greatest(F.size(items) - 1, F.lit(0))
        return F.size(F.filter(F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(2), n), bad), lambda x: F.coalesce(x, F.lit(False))))

    return lines.select(key, count("bands", lambda a, b: F.abs(a["high"] - b["low"]) > 0.5).alias("gaps"), count("doses", lambda a, b: b < a).alias("drops"))


def stitched_sentences(cells: DataFrame) -> DataFrame:
    """(upper_id, lower_id, nll, num_rows): divided tables, joined and linearised."""
    rows = cells.groupBy("upper_id", "lower_id", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "cell"))), lambda x: x["cell"]), " | ").alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", F.concat(F.lit("| "), F.col("line"), F.lit(" |")).alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("upper_id", "lower_id").agg(text.alias("md"), (F.count(F.lit(1)) - 1).alias("num_rows")).select("upper_id", "lower_id", linearised(F.col("md")).alias("nll"), "num_rows")


def tables_of_chunks(chunks: DataFrame, tables: DataFrame, on: Sequence[str], key: str, table_key: str) -> DataFrame:
    """(key, tables, n_tables): every chunk of a page gets all tables of the page."""
    per_page = tables.groupBy(*on).agg(F.array_join(F.array_sort(F.collect_list(F.col(table_key))), ",").alias("tables"), F.count(F.lit(1)).alias("n_tables"))
    return chunks.select(*on, key).join(per_page, list(on)).select(key, "tables", "n_tables")


def tables_without_chunk(tables: DataFrame, chunks: DataFrame, on: Sequence[str], rows: str = "num_rows") -> DataFrame:
    """Tables of more than one row on pages without any chunk."""
    return tables.where(F.col(rows) > 1).join(chunks.select(*on).distinct(), list(on), "left_anti")


def review_flags(tables: DataFrame, pages: DataFrame, doc: str, page: str, text: str, markdown: str) -> DataFrame:
    """(doc, page, kind, n): tables and pages that a person should look at."""
    dosing = tables.where(any_of(F.col(markdown), ("dose", "mg", "tablet", "administration"))).select(doc, page, F.lit("dosing_table").alias("kind"))
    warned = pages.where(any_of(F.coalesce(F.col(text), F.lit("")), ("contraindication", "not recommended"))).select(doc, page, F.lit("contraindication").alias("kind")).distinct()
    return dosing.unionByName(warned).groupBy(doc, page, "kind").agg(F.count(F.lit(1)).alias("n"))


def few_numbers(tables: DataFrame, key: str, markdown: str, least: int = 3) -> DataFrame:
    """(key, numbers): tables that speak of doses but hold fewer than `least` numbers."""
    n = F.regexp_count(F.col(markdown), F.lit("\\d+\\.?\\d*"))
    return tables.where(any_of(F.col(markdown), ("dose", "mg"))).select(key, n.alias("numbers")).where(F.col("numbers") < least)


def condition_of(headings: Column, conditions: Sequence[tuple[str, str]]) -> Column:
    """The label of the first pattern that the deepest possible heading matches; null for none."""
    found = F.lit(None).cast("string")

    def label(h: Column) -> Column:
        out = found
        for pattern, name in reversed(conditions):
            out = F.when(h.rlike("(?i)" + pattern), F.lit(name)).otherwise(out)
        return out

    return F.get(F.filter(F.transform(F.reverse(headings), label), lambda x: x.isNotNull()), F.lit(0))


def section_type_of(headings: Column, words: dict[str, Sequence[str]]) -> Column:
    """The first type (in the order of `words`) that the outermost possible heading names."""

    def kind(h: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, ws in reversed(list(words.items())):
            out = F.when(any_of(h, ws), F.lit(name)).otherwise(out)
        return out

    return F.get(F.filter(F.transform(headings, kind), lambda x: x.isNotNull()), F.lit(0))


def fenced_json(text: Column, schema: str) -> Column:
    """JSON that may stand inside a code fence; null if it can't be parsed."""
    return F.from_json(F.regexp_replace(F.regexp_replace(text, "^\\s*```(?:json)?\\s*", ""), "\\s*```\\s*$", ""), schema, {"mode": "PERMISSIVE"})


def consistency(scores: DataFrame, doc: str, score: str, least: float = 0.9) -> DataFrame:
    """(doc, confidence, passed): mean similarity of two extractions, 1.0 where there is none."""
    out = scores.groupBy(doc).agg(F.round(F.coalesce(F.avg(score), F.lit(1.0)), 6).alias("confidence"))
    return out.withColumn("passed", F.col("confidence") >= least)


def short_name(title: Column) -> Column:
    """Six letters of each of the first three words, or the first 30 characters."""
    words = F.regexp_extract_all(title, F.lit("([A-Za-z]+)"), F.lit(1))
    joined = F.array_join(F.transform(F.slice(words, 1, 3), lambda w: F.left(w, F.lit(6))), "-")
    return F.when(F.size(words) >= 3, joined).otherwise(F.replace(F.left(title, F.lit(30)), F.lit(" "), F.lit("-")))


def seconds_per_page(seconds: Column, pages: Column) -> Column:
    return F.try_divide(seconds, F.nullif(pages, F.lit(0)))


def proposed_config(base: Config, drugs: Sequence[str], section_words: dict[str, Sequence[str]], care_levels: Sequence[str]) -> Config:
    """A draft for a person to review: discovered lists merged into `base`, first mention kept."""
    from dataclasses import replace

    words = [*CLINICAL_WORDS, *(w for ws in section_words.values() for w in ws), *care_levels, *GENERIC_CLINICAL_WORDS]
    return replace(
        base,
        drugs=tuple(dict.fromkeys([*base.drugs, *drugs])),
        section_words={k: tuple(v) for k, v in section_words.items()},
        care_levels=tuple(dict.fromkeys([*base.care_levels, *care_levels])),
        clinical_words=tuple(dict.fromkeys(words)),
    )
