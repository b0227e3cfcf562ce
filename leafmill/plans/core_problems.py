"""Queries of the general problems: units (3) and differences between copies (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.lookalike import fold_sql
from leafmill.operators import units
from leafmill.operators.diff import table_differences
from leafmill.session import cut
from leafmill.sources.tables import table

READING = ["report_id", "doc_id", "page", "extracted_at", "markdown"]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of one page that state the same quantities in different units."""
    pairs = units.unit_pairs(table(spark, folder, "cross_validation_report"), READING)
    return pairs.select(F.col("a").alias("report_id_a"), F.col("b").alias("report_id_b"))


def p3_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of `p3_found` by what tells the other unit: a marked level shift, or the name alone."""
    return units.unit_pairs(table(spark, folder, "cross_validation_report"), READING).groupBy("evidence").agg(F.count(F.lit(1)).alias("pairs"))


def p3_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every quantity of every reading in the common unit of its kind."""
    parsed = cut(units.parse_readings(units.readings(table(spark, folder, "cross_validation_report"), *READING), keep_places=True))
    out = units.common_quantities(parsed, units.mark_unit_changes(parsed))
    return out.withColumnRenamed("id", "report_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Differences between the readings and their mirror, field by field."""
    return table_differences(
        table(spark, folder, "cross_validation_report"),
        table(spark, folder, "cross_validation_mirror"),
        "report_id",
        ["markdown", "headers", "num_rows"],
        left_version="loaded_at",
        right_version="synced_at",
        only_left="only_report",
        only_right="only_mirror",
    )


def _latest(name: str, version: str) -> str:
    heads = f"case when headers is null then null else to_json(list_transform(headers, lambda h: {fold_sql('h')})) end"
    return (
        f"(select report_id, {fold_sql('markdown')} as m, {heads} as h, num_rows as n from {name} "
        f"qualify row_number() over (partition by report_id order by {version} desc nulls last) = 1)"
    )


QUERIES = {"p3_found": p3_found, "p3_evidence": p3_evidence, "p3_values": p3_values, "p5_found": p5_found}
SQL = {
    "p5_found": f"with a as {_latest('cross_validation_report', 'loaded_at')}, b as {_latest('cross_validation_mirror', 'synced_at')} "
    "select report_id, 'only_report' as difference from a where report_id not in (select report_id from b) "
    "union all select report_id, 'only_mirror' from b where report_id not in (select report_id from a) "
    "union all select a.report_id, 'markdown' from a join b using (report_id) where a.m is distinct from b.m "
    "union all select a.report_id, 'headers' from a join b using (report_id) where a.h is distinct from b.h "
    "union all select a.report_id, 'num_rows' from a join b using (report_id) where a.n is distinct from b.n"
}
