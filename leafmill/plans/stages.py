"""The stages of a whole run in their order: each query's result is written once and timed.

A result is kept under a key of the input files and the config, so a run with the same input
reads what an earlier one wrote.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from leafmill.config import Config
from leafmill.plans import catalogue
from leafmill.sources import sinks

STAGES: dict[str, tuple[str, ...]] = {
    "extract": ("markdown_export", "table_classify", "table_linearise", "image_inventory", "ground_truth_kinds", "quality_counts"),
    "cross-validate": ("cell_agreement", "discrepancies", "stitch_tables", "class_refine", "truth_recheck", "accuracy_kinds"),
    "check": ("dosing_checks", "check_report"),
    "chunk": ("all_chunks", "table_enrichment", "clinical_metadata", "age_limits", "links", "chunk_summary"),
    "validate": ("structure_report", "tables_report", "consistency_report", "terms_report", "human_review", "overall_report"),
}
TIMES = "stage string, query string, seconds double, reused boolean"


def run_stages(
    spark: SparkSession, folder: str, out: str, tables: Sequence[str], config: Config | None = None, stages: Mapping[str, Sequence[str]] = STAGES, queries: Mapping[str, Callable] | None = None
) -> DataFrame:
    """(stage, query, seconds, reused): runs the stages over `folder`; results lie in `out`/key/query."""
    queries = queries or catalogue.QUERIES
    key = sinks.content_key(spark, [f"{folder}/{t}.parquet" for t in tables], config or Config())
    rows = []
    for stage, names in stages.items():
        for name in names:
            begun, built = time.time(), []
            sinks.read_or_build(spark, f"{out}/{key}/{name}", lambda n=name, b=built: b.append(n) or queries[n](spark, folder))
            rows.append((stage, name, round(time.time() - begun, 3), not built))
    return spark.createDataFrame(rows, TIMES)


def scorecard(times: DataFrame, pages: int) -> DataFrame:
    """(stage, seconds, per_page): none for no pages."""
    from pyspark.sql import functions as F

    from leafmill.operators.reports import seconds_per_page

    whole = times.groupBy("stage").agg(F.round(F.sum("seconds"), 3).alias("seconds"))
    return whole.withColumn("per_page", F.round(seconds_per_page(F.col("seconds"), F.lit(pages)), 6))
