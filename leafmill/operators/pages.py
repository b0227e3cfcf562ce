"""Pages and parts of documents: page lists, parts for parallel work, exports and unions in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import score_of
from leafmill.operators.chunks import numbered

# Words that tell a dosing table in the scan of a collection.
DOSING_SCAN_WORDS = ("mg", "dose", "kg", "tablet", "mg/kg", "daily", "twice", "body weight", "weight (kg)")
#: Least area of an embedded image, in square pixels.
LEAST_AREA = 400


def dosing_pages(tables: DataFrame, doc: str, page: str, markdown: str, words: Sequence[str] = DOSING_SCAN_WORDS, least: int = 3) -> DataFrame:
    """(doc, page, score): pages with a table that holds at least `least` of the words; the best table's score."""
    scored = tables.select(doc, page, score_of(F.col(markdown), words).alias("score"))
    return scored.groupBy(doc, page).agg(F.max("score").alias("score")).where(F.col("score") >= least)


def on_pages(tables: DataFrame, pages: DataFrame, on: Sequence[str]) -> DataFrame:
    """The tables of listed pages; the list prunes what is read."""
    return tables.join(pages.select(*on).distinct(), list(on), "left_semi")


def recognition_requests(chunks: DataFrame, images: DataFrame, doc: str, page: str, text: str, least: int = 100) -> DataFrame:
    """(doc, page, status): pages with an image and fewer than `least` characters, to be recognised or read by a person."""
    long = chunks.groupBy(doc, page).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).alias("_n"))
    some = images.where(F.col(page).isNotNull()).select(doc, page).distinct().join(long, [doc, page], "left")
    return some.where(F.coalesce("_n", F.lit(0)) < least).select(doc, page, F.lit("requires_manual_review").alias("status"))


def embedded_images(images: DataFrame, doc: str, page: str, order: str, least_area: int = LEAST_AREA) -> DataFrame:
    """`images` of at least `least_area` with their number on the page, from 0; smaller ones are not numbered."""
    large = images.where(F.col("width").cast("bigint") * F.col("height") >= least_area)
    return large.withColumn("number", F.row_number().over(Window.partitionBy(doc, page).orderBy(order)) - 1)


def page_parts(documents: DataFrame, doc: str, pages: str, parts: int) -> DataFrame:
    """(doc, part, first, last, offset): at most `parts` stretches of pages of equal length (rounded up),
    and what to add to a page of the stretch for its page in the document."""
    size = F.ceil(F.col(pages) / F.lit(parts)).cast("int")
    known = documents.where(F.col(pages) > 0).withColumn("_size", size)
    starts = known.select(doc, F.col(pages).alias("_n"), "_size", F.posexplode(F.sequence(F.lit(1), F.col(pages), F.col("_size"))).alias("part", "first"))
    return starts.select(doc, "part", "first", F.least(F.col("first") + F.col("_size") - 1, F.col("_n")).alias("last"), (F.col("first") - 1).alias("offset"))


def markdown_export(chunks: DataFrame, doc: str, order: list[str], content: Column) -> DataFrame:
    """(doc, part_no, part): a document's parts in order, without null ones; joined by blank lines they are
    the document. Rows, so that no document is one value."""
    kept = chunks.withColumn("part", content).where(F.col("part").isNotNull())
    return numbered(kept, doc, order, "part_no").select(doc, "part_no", "part")


#: Kinds of chunks in the order in which a page gives them; stitched tables come after all pages.
KINDS = ("narrative", "table", "image", "stitched")


def chunk_rows(kind: str, df: DataFrame, doc: str, page: Column, key: Column, content: Column, **more: Column) -> DataFrame:
    """Chunks of one kind in the form common to all."""
    extra = {n: more.get(n, F.lit(None).cast("string")) for n in ("nll", "caption")}
    rank = F.lit(KINDS.index(kind))
    return df.select(F.col(doc).alias("doc_id"), F.lit(kind).alias("kind"), rank.alias("rank"), page.cast("int").alias("page"), key.cast("string").alias("key"), content.alias("content"), *(c.alias(n) for n, c in extra.items()))


def in_order(kinds: Sequence[DataFrame]) -> DataFrame:
    """All chunks, numbered in their document: by page, kind and key; stitched tables last."""
    every = kinds[0]
    for one in kinds[1:]:
        every = every.unionByName(one)
    place = F.struct(F.when(F.col("rank") == KINDS.index("stitched"), 1).otherwise(0).alias("late"), "page")
    return numbered(every.withColumn("_place", place), "doc_id", ["_place", "rank", "key"], "chunk_no").drop("_place", "rank")
