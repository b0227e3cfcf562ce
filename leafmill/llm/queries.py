"""Queries of the problems tagged llm, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.lookalike import fold_sql
from leafmill.llm import leakage, lookalike, ocr, split, tokenize, truncation
from leafmill.sources.tables import table


def _scans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Records and guidelines."""
    images = table(spark, folder, "images").select(F.lit("images").alias("rec_table"), F.col("image_id").alias("rec_id"), "doc_id", F.col("page_no").alias("page"), F.col("ocr_text").alias("text"))
    chunk = table(spark, folder, "chunk").select(F.lit("chunk").alias("rec_table"), F.col("chunk_id").alias("rec_id"), "doc_id", "page", "text")
    return images.unionByName(chunk), table(spark, folder, "guideline_docs").select("doc_id", "title", "short_name")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records and the kinds of scan noise in their text."""
    return ocr.found_noise(*_scans(spark, folder))


def p1_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every record's text as continuous paragraphs."""
    return ocr.continuous_text(*_scans(spark, folder))


def p1_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """How often the decoder had a choice, changed a form, and went against the most frequent option."""
    return ocr.decisions(*_scans(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of one page that print alike but are stored with different characters."""
    report = table(spark, folder, "cross_validation_report").select("report_id", "doc_id", "page", "markdown", "headers")
    pairs = lookalike.alike_pairs(report, "report_id", ["doc_id", "page"], ["markdown", "headers"])
    return pairs.select(F.col("a").alias("report_id_a"), F.col("b").alias("report_id_b"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Readings in a class of several stored forms, with the class's smallest reading."""
    report = table(spark, folder, "cross_validation_report").select("report_id", "doc_id", "page", "markdown", "headers")
    return lookalike.classes_of_looks(report, "report_id", ["doc_id", "page"], ["markdown", "headers"])


def p2_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Each reading with the canonical stored form of its markdown."""
    report = table(spark, folder, "cross_validation_report").select("report_id", "markdown").distinct()
    return lookalike.canonical_text(report, "markdown", out="canonical")


def p2_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Each reading with the canonical stored form of its headers."""
    report = table(spark, folder, "cross_validation_report").select("report_id", "headers").distinct()
    return lookalike.canonical_elements(report, "headers", out="canonical")


def _oversized(spark: SparkSession, folder: str, only_oversized: bool) -> DataFrame:
    chunk = table(spark, folder, "chunk").select(F.lit("chunk").alias("rec_table"), F.col("chunk_id").alias("rec_id"), "text")
    report = table(spark, folder, "cross_validation_report").select(
        F.lit("cross_validation_report").alias("rec_table"), F.col("report_id").cast("string").alias("rec_id"), F.col("markdown").alias("text")
    )
    rows = chunk.unionByName(report).select(F.struct("rec_table", "rec_id").alias("rec"), "text")
    return split.split_texts(rows, "rec", "text", only_oversized=only_oversized).select("rec.*", "piece_no", "start_at", "piece")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that had to be cut: those whose text came out in more than one piece."""
    return _oversized(spark, folder, True).where("piece_no = 1").select("rec_table", "rec_id").distinct()


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all records."""
    return _oversized(spark, folder, False)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.token_ids(table(spark, folder, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the held-out passages they leak."""
    return leakage.leaked_items(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "passage")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that were cut."""
    return truncation.cut_texts(table(spark, folder, "documents"), "doc_id", "text", "source").select("doc_id").distinct()


def p8_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that were cut, told apart by the evidence: a length spike, or the corpus alone."""
    return truncation.cut_texts(table(spark, folder, "documents"), "doc_id", "text", "source").distinct()


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source cuts its documents."""
    return truncation.cut_shares(table(spark, folder, "documents"), "doc_id", "text", "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_text": p1_text,
    "p1_decisions": p1_decisions,
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p2_canonical": p2_canonical,
    "p2_headers": p2_headers,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_cuts": p8_cuts,
    "p8_shares": p8_shares,
}

_LOOKS = (
    "with v as (select distinct report_id, doc_id, page, markdown, headers::varchar as stored, "
    f"{fold_sql('markdown')} as m, to_json(list_transform(headers, lambda h: {fold_sql('h')})) as h "
    "from cross_validation_report where markdown is not null and headers is not null and doc_id is not null and page is not null) "
)

SQL: dict[str, str] = {
    "p2_found": _LOOKS + "select a.report_id as report_id_a, b.report_id as report_id_b from v a join v b on a.doc_id = b.doc_id and a.page = b.page and a.m = b.m and a.h = b.h and a.report_id < b.report_id where a.markdown <> b.markdown or a.stored <> b.stored",
    "p2_classes": _LOOKS + "select report_id, min(report_id) over (partition by doc_id, page, m, h) as class_id from v where (doc_id, page, m, h) in (select (doc_id, page, m, h) from v group by doc_id, page, m, h having count(distinct (markdown, stored)) > 1)",
    "p2_canonical": f"with t as (select distinct report_id, markdown from cross_validation_report), n as (select markdown, {fold_sql('markdown')} as look, count(*) as n from t where markdown is not null group by 1), "
    "k as (select look, first(markdown order by n desc, length(markdown), markdown) as canonical from n group by 1) select report_id, t.markdown, canonical from t left join n on n.markdown = t.markdown left join k on k.look = n.look",
    "p2_headers": "with t as (select row_number() over () as row_no, report_id, headers from (select distinct report_id, headers from cross_validation_report)), e as (select row_no, unnest(range(len(headers))) as place, unnest(headers) as h from t where headers is not null), "
    f"n as (select h, {fold_sql('h')} as look, count(*) as n from e where h is not null group by 1), k as (select look, first(h order by n desc, length(h), h) as canonical from n group by 1), "
    "c as (select row_no, list(canonical order by place) as canonical from e left join n on n.h = e.h left join k on k.look = n.look group by 1) select report_id, headers, coalesce(canonical, headers) as canonical from t left join c on c.row_no = t.row_no",
    "p4_found": "select distinct 'chunk' as rec_table, chunk_id as rec_id from chunk where length(text) > 2000 union select distinct 'cross_validation_report', report_id::varchar from cross_validation_report where length(markdown) > 2000",
}
