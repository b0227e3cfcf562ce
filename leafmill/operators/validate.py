"""Validators of an extracted document: one row a document, with issues counted and a confidence.

Documents come from their own table, so one without pages, tables or scores has its row too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import any_of

#: Least confidence to pass; pages whose headings are looked at; share of terms that may be missing.
PASS, HEADING_PAGES, MISSING_SHARE = 0.8, 10, 0.3


def structure(documents: DataFrame, chunks: DataFrame, doc: str, page: str, order: str, level: str = "level") -> DataFrame:
    """(doc, pages, misnumbered, skipped_levels, confidence, passed).

    Pages must be 1..n; a heading in the first `HEADING_PAGES` pages must not lie more than one
    level below the one before. Without issues 0.9, else 0.7; 0.0 without pages.
    """
    pages = chunks.where(F.col(page).isNotNull()).select(doc, page).distinct()
    counted = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), F.min(page).alias("lo"), F.max(page).alias("hi"))
    first = pages.withColumn("_no", F.row_number().over(Window.partitionBy(doc).orderBy(page))).where(F.col("_no") <= HEADING_PAGES).select(doc, page)
    heads = chunks.where(F.col(level).isNotNull()).join(first, [doc, page], "left_semi")
    jump = F.lead(level).over(Window.partitionBy(doc).orderBy(page, order)) > F.col(level) + 1
    skipped = heads.withColumn("_jump", jump).groupBy(doc).agg(F.count_if("_jump").alias("skipped_levels"))
    out = documents.select(doc).distinct().join(counted, doc, "left").join(skipped, doc, "left")
    out = out.select(doc, F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce((F.col("lo") != 1) | (F.col("hi") != F.col("pages")), F.lit(False)).alias("misnumbered"), F.coalesce("skipped_levels", F.lit(0)).alias("skipped_levels"))
    clean = ~F.col("misnumbered") & (F.col("skipped_levels") == 0)
    confidence = F.when(F.col("pages") == 0, 0.0).when(clean, 0.9).otherwise(0.7)
    return out.withColumn("confidence", confidence).withColumn("passed", clean & (F.col("pages") > 0))


def tables(documents: DataFrame, readings: DataFrame, estimated: DataFrame, doc: str, markdown: str, columns: str = "num_cols") -> DataFrame:
    """(doc, tables, narrow, few_numbers, confidence, passed).

    The confidence is the share of tables with two columns or more; without any table it is 0.3 if
    `estimated` (doc, estimated) expects some, else 1.0. Tables that speak of doses but hold fewer than three numbers are
    counted.
    """
    few = any_of(F.col(markdown), ("dose", "mg")) & (F.regexp_count(F.col(markdown), F.lit("\\d+\\.?\\d*")) < 3)
    told = readings.groupBy(doc).agg(F.count(F.lit(1)).alias("tables"), F.count_if(F.coalesce(F.col(columns), F.lit(0)) < 2).alias("narrow"), F.count_if(few).alias("few_numbers"))
    out = documents.select(doc).distinct().join(told, doc, "left").join(estimated.select(doc, "estimated"), doc, "left").na.fill(0, ["tables", "narrow", "few_numbers", "estimated"])
    share = F.try_divide(F.col("tables") - F.col("narrow"), F.col("tables"))
    confidence = F.when(F.col("tables") > 0, F.round(share, 6)).when(F.col("estimated") > 0, 0.3).otherwise(1.0)
    return out.withColumn("confidence", confidence).drop("estimated").withColumn("passed", F.col("confidence") >= PASS)


def consistency(documents: DataFrame, scores: DataFrame, doc: str, score: str, least: float = 0.9) -> DataFrame:
    """(doc, confidence, passed): mean score of two extractions, 1.0 where there is none."""
    told = scores.groupBy(doc).agg(F.avg(score).alias("_score"))
    out = documents.select(doc).distinct().join(told, doc, "left").select(doc, F.round(F.coalesce("_score", F.lit(1.0)), 6).alias("confidence"))
    return out.withColumn("passed", F.col("confidence") >= least)


def terms(documents: DataFrame, texts: DataFrame, doc: str, text: str, critical: Sequence[str]) -> DataFrame:
    """(doc, missing, many_missing, confidence, passed): critical terms that no text of the document holds."""
    held = [F.bool_or(F.contains(F.lower(F.col(text)), F.lit(t.lower()))).alias(f"t{i}") for i, t in enumerate(critical)]
    out = documents.select(doc).distinct().join(texts.groupBy(doc).agg(*held), doc, "left")
    missing = sum((F.when(F.col(f"t{i}"), 0).otherwise(1) for i in range(len(critical))), F.lit(0))
    out = out.select(doc, missing.alias("missing")).withColumn("many_missing", F.col("missing") > len(critical) * MISSING_SHARE)
    out = out.withColumn("confidence", F.round(1.0 - F.col("missing") / F.lit(float(len(critical))), 6))
    return out.withColumn("passed", F.col("confidence") >= PASS)


def human_review(documents: DataFrame, readings: DataFrame, chunks: DataFrame, scanned: DataFrame, doc: str, page: str, text: str, markdown: str) -> DataFrame:
    """(doc, dosing_tables, warning_pages, scanned_pages, confidence, passed): what a person should look at.

    Tables that speak of doses, pages with a contraindication, and pages whose text needs
    recognition (`scanned`: doc, page); each takes a tenth off the confidence.
    """
    dosing = readings.where(any_of(F.col(markdown), ("dose", "mg", "tablet", "administration"))).groupBy(doc).agg(F.count(F.lit(1)).alias("dosing_tables"))
    warned = chunks.where(any_of(F.coalesce(F.col(text), F.lit("")), ("contraindication", "not recommended"))).select(doc, page).distinct().groupBy(doc).agg(F.count(F.lit(1)).alias("warning_pages"))
    unread = scanned.select(doc, page).distinct().groupBy(doc).agg(F.count(F.lit(1)).alias("scanned_pages"))
    out = documents.select(doc).distinct()
    for one in (dosing, warned, unread):
        out = out.join(one, doc, "left")
    out = out.na.fill(0)
    items = F.col("dosing_tables") + F.col("warning_pages") + F.col("scanned_pages")
    return out.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - items * 0.1)), 6)).withColumn("passed", items == 0)


def overall(stages: Sequence[DataFrame], doc: str, review: DataFrame) -> DataFrame:
    """(doc, confidence, passed, needs_review): the mean of all stages' confidences."""
    every = None
    for s in stages:
        one = s.select(doc, "confidence")
        every = one if every is None else every.unionByName(one)
    out = every.groupBy(doc).agg(F.round(F.avg("confidence"), 6).alias("confidence")).withColumn("passed", F.col("confidence") >= PASS)
    return out.join(review.select(doc, (~F.col("passed")).alias("needs_review")), doc)
