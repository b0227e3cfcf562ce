"""Scans: page texts, styled lines, tables and images of a parsed document, JSON artefacts.

Parsing of page files themselves is left to an adapter that yields these tables (see
`DocumentAdapter`): no such parser is at hand here.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Schemas of the tables an adapter yields.
PAGES = "doc_id string, page int, raw_text string, page_height double"
SPANS = "doc_id string, page int, block_no int, line_no int, span_no int, y_pos double, text string, font string, size double, flags int"
TABLES = "doc_id string, engine string, page int, table_index_on_page int, num_rows int, num_cols int, markdown string, headers array<string>, bbox array<double>, error string"
IMAGES = "doc_id string, page int, image_index int, width int, height int, caption string, ocr_text string, error string"

#: Flag bits of a span's style.
BOLD, ITALIC = 16, 2


class DocumentAdapter(Protocol):
    """Turns files into the tables above, one call a file, inside a Python worker."""

    def pages(self, name: str, content: bytes) -> Iterable[tuple]: ...


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content): files as bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def parsed_pages(raw: DataFrame, adapter: DocumentAdapter) -> DataFrame:
    """Pages of files, by an adapter; a file that can't be parsed gives a page with null text."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [tuple(r) for r in adapter.pages(path, content)]
                except Exception:  # noqa: BLE001  one bad file must not end the scan
                    rows.append((path, None, None, None))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "raw_text", "page_height"]).astype({"page": "Int32"})

    return raw.select("path", "content").mapInPandas(run, PAGES)


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """A stage's JSON artefact with a declared schema. A broken record is kept as a row of nulls with
    its text in `_corrupt_record`, which is null for all others."""
    broken = f"{schema}, _corrupt_record string"
    return spark.read.schema(broken).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): a text file's lines."""
    return spark.read.text(path)


def text_lines(spans: DataFrame) -> DataFrame:
    """(doc_id, page, block_no, line_no, y_pos, text, is_bold, is_italic): spans joined to lines in their
    order, blank ones dropped."""
    keys = ["doc_id", "page", "block_no", "line_no"]
    ordered = F.array_sort(F.collect_list(F.struct("span_no", "text")))
    out = spans.groupBy(*keys).agg(
        F.min("y_pos").alias("y_pos"),
        F.trim(F.array_join(F.transform(ordered, lambda s: s["text"]), "")).alias("text"),
        F.bool_or(F.col("flags").bitwiseAND(BOLD) != 0).alias("is_bold"),
        F.bool_or(F.col("flags").bitwiseAND(ITALIC) != 0).alias("is_italic"),
    )
    return out.where("text <> ''").select(*keys, "y_pos", "text", "is_bold", "is_italic")


def heading_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, page, block_no, line_no, span_no, y_pos, text, level): short spans that are large or bold."""
    bold = F.col("flags").bitwiseAND(BOLD) != 0
    level = F.when(F.col("size") > 16, 1).when(F.col("size") > 14, 2).otherwise(3)
    s = spans.withColumn("text", F.trim("text")).where((F.length("text").between(1, 99)) & ((F.col("size") > 12) | bold))
    return s.select("doc_id", "page", "block_no", "line_no", "span_no", "y_pos", "text", level.alias("level"))


def page_sections(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, page, section_no, heading, level, text): lines of a page under their heading.

    Headings and lines are merged by height; of equals the heading comes first, then they keep the
    order of the page. Lines before the first heading have section 0 and no heading.
    """
    place = ["block_no", "line_no", "span_no"]
    both = headings.select("doc_id", "page", "y_pos", F.lit(0).alias("kind"), *place, "text", "level").unionByName(
        lines.withColumn("span_no", F.lit(0)).select("doc_id", "page", "y_pos", F.lit(1).alias("kind"), *place, "text", F.lit(None).cast("int").alias("level"))
    )
    w = Window.partitionBy("doc_id", "page").orderBy("y_pos", "kind", *place)
    numbered = both.withColumn("section_no", F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(w))
    body = F.array_sort(F.collect_list(F.when(F.col("kind") == 1, F.struct("n", "text"))))
    return numbered.groupBy("doc_id", "page", "section_no").agg(
        F.max(F.when(F.col("kind") == 0, F.col("text"))).alias("heading"), F.max("level").alias("level"), F.array_join(F.transform(body, lambda x: x["text"]), "\n\n").alias("text")
    )


def with_fallbacks(tables: Sequence[DataFrame], methods: Sequence[str], confidences: Sequence[float]) -> DataFrame:
    """The first extraction that yields any table for a document, with method and confidence; missing texts are empty."""
    ranked = None
    for rank, (t, m, c) in enumerate(zip(tables, methods, confidences, strict=True)):
        one = t.withColumn("method", F.lit(m)).withColumn("confidence", F.lit(c)).withColumn("_rank", F.lit(rank))
        ranked = one if ranked is None else ranked.unionByName(one)
    best = F.min("_rank").over(Window.partitionBy("doc_id"))
    return ranked.withColumn("_best", best).where("_rank = _best").drop("_rank", "_best").na.fill("")


def page_ranges(ranges: DataFrame) -> DataFrame:
    """(doc_id, new_page, page): pages of (first, last) ranges, renumbered in order."""
    pages = ranges.select("doc_id", F.explode(F.sequence("first", "last")).alias("page")).distinct()
    return pages.withColumn("new_page", F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))).select("doc_id", "new_page", "page")


def remapped_page(page: Column, offset: Column, mapped: Column) -> Column:
    """A page of a part in the whole document: the mapped one if there is a map."""
    return F.coalesce(mapped, page + F.coalesce(offset, F.lit(0)))


def nll_records(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """(table_key, nll): records of a linearised-tables text file, the last of a key wins.

    A record begins with a line like "--- Table 7 (page 3) ---" or "--- Stitched S1 ---".
    """
    head = "^-+\\s*(?:Table|Stitched)\\s+(\\w+).*-*$"
    # heads are counted in stretches of the file, then the stretches' offsets are added
    marked = lines.withColumn("is_head", F.col("line").rlike(head)).withColumn("_stretch", F.floor(F.col(order) / F.lit(10_000)))
    heads = marked.groupBy("_stretch").agg(F.sum(F.col("is_head").cast("int")).alias("_n"))
    before = heads.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.sum(F.col("is_head").cast("int")).over(Window.partitionBy("_stretch").orderBy(order))
    marked = marked.withColumn("_inside", inside).join(before, "_stretch").withColumn("record", F.col("_inside") + F.col("_before"))
    key = F.max(F.when(F.col("is_head"), F.regexp_extract("line", head, 1)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_head") & ~F.col("line").rlike("^[=\\s]*$"), F.struct(order, "line")))), lambda x: x["line"]), "\n")
    records = marked.where("record > 0").groupBy("record").agg(key.alias("table_key"), text.alias("nll"))
    return records.groupBy("table_key").agg(F.max_by("nll", "record").alias("nll"))
