"""Ground truth, images, document profiles, similarity of page texts, and package validators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators import substrings
from leafmill.operators.chunks import numbered
from leafmill.session import counted_side, cut


def share(part: Column, whole: Column, places: int = 1) -> Column:
    """Percentage, 0.0 of nothing."""
    return F.coalesce(F.round(F.try_divide(100.0 * part, whole), places), F.lit(0.0))


#: Most words of a space that its texts are searched for one by one.
WORDS = 100


def held_words(items: DataFrame, spaces: DataFrame, on: list[str]) -> DataFrame:
    """(on, word): the distinct words of items that some text of their search space holds, whatever the case.

    Texts of a space with more than `WORDS` words are searched for all words of all such spaces in one
    pass, so the work grows with the texts, not with the texts times the words.
    """
    words = cut(items.select(*on, F.explode("words").alias("word")).where("word <> ''").distinct().withColumn("_low", F.lower("word")))
    n = words.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    texts = spaces.where("space is not null").select(*on, F.lower("space").alias("_text"))
    lists = words.join(n.where(F.col("_n") <= WORDS), on, "left_semi").groupBy(*on).agg(F.collect_list("_low").alias("_words"))
    hits = texts.join(lists, on).select(*on, F.explode(F.filter("_words", lambda w: F.contains("_text", w))).alias("_low"))
    many = cut(n.where(F.col("_n") > WORDS).select(*on))
    if not many.isEmpty():
        asked = substrings.broadcast_words(words.join(counted_side(many), on, "left_semi").select("_low").distinct(), "_low")
        hits = hits.union(substrings.candidates(texts.join(counted_side(many), on, "left_semi"), on, "_text", "_low", asked))
    return words.join(hits.distinct(), [*on, "_low"], "left_semi").select(*on, "word")


def ground_truth(items: DataFrame, spaces: DataFrame, on: list[str], key: str) -> DataFrame:
    """(key, found, missing, passed): which of an item's words its search space holds.

    `items` has key, the `on` columns and words (array); `spaces` the `on` columns and space, any
    number of rows. An item without a space misses everything but empty words; one without words passes.
    """
    held = held_words(items, spaces, on).withColumn("_held", F.lit(True))
    asked = items.select(key, *on, F.explode_outer("words").alias("word"))
    hit = F.coalesce("_held", F.col("word") == "", F.lit(False))
    out = asked.join(held, [*on, "word"], "left").groupBy(key).agg(F.count_if(hit).cast("int").alias("found"), F.count("word").cast("int").alias("n"))
    return out.select(key, "found", (F.col("n") - F.col("found")).alias("missing"), (F.col("n") == F.col("found")).alias("passed"))


def accuracy(results: DataFrame) -> DataFrame:
    """One row: items, passed, percentage."""
    return results.agg(F.count(F.lit(1)).alias("items"), F.count_if("passed").alias("passed")).withColumn("accuracy", share(F.col("passed"), F.col("items")))


def image_issues(ocr_text: Column, width: Column, height: Column, caption: Column) -> Column:
    text = F.regexp_replace(F.coalesce(ocr_text, F.lit("")), "^\\s+|\\s+$", "")
    return F.array_compact(
        F.array(
            F.when(F.length(text) < 5, F.lit("no text")),
            F.when((F.coalesce(width, F.lit(0)) < 50) | (F.coalesce(height, F.lit(0)) < 50), F.lit("very small")),
            F.when(F.coalesce(caption, F.lit("")) == "", F.lit("no caption")),
        )
    )


def image_inventory(images: DataFrame, doc: str, order: list[str], least_side: int = 50) -> DataFrame:
    """Images of at least `least_side` on both sides, numbered before the small ones go (so
    numbers have gaps)."""
    return numbered(images, doc, order, "number").where((F.col("width") >= least_side) & (F.col("height") >= least_side))


def document_profile(pages: DataFrame, first_pages: int = 20) -> DataFrame:
    """(doc_id, pages_seen, table_pages, image_pages, likely_scanned) over the first pages.

    `pages` has doc_id, page, text_length, n_tables, n_images. A page looks scanned if it has
    images and less than 100 characters.
    """
    p = pages.where(F.col("page") <= first_pages)
    scanned = (F.col("text_length") < 100) & (F.col("n_images") > 0)
    return p.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages_seen"),
        F.count_if(F.col("n_tables") > 0).alias("table_pages"),
        F.count_if(F.col("n_images") > 0).alias("image_pages"),
        F.bool_or(scanned).alias("likely_scanned"),
    )


def indel_ratio(a: str, b: str) -> float:
    """Normalised similarity 2 * LCS / (len a + len b), by bit-parallel longest common subsequence."""
    if not a and not b:
        return 1.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return 2.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def text_similarity(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, similarity): of two texts; null counts as empty."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "similarity": [indel_ratio(x or "", y or "") for x, y in zip(b["x"], b["y"], strict=True)]})

    rows = pairs.select(F.col(key).alias("k"), F.col(left).alias("x"), F.col(right).alias("y"))
    return rows.mapInPandas(run, f"k {kind}, similarity double").withColumnRenamed("k", key)


def structure_check(headings: DataFrame, doc: str, order: list[str], level: str = "level") -> DataFrame:
    """(doc, skipped_levels, confidence): headings more than one level below the one before."""
    w = Window.partitionBy(doc).orderBy(*order)
    jump = (F.lead(level).over(w) > F.col(level) + 1).cast("int")
    out = headings.where(F.col(level).isNotNull()).withColumn("_jump", jump).groupBy(doc).agg(F.coalesce(F.sum("_jump"), F.lit(0)).alias("skipped_levels"))
    return out.withColumn("confidence", F.when(F.col("skipped_levels") == 0, 0.9).otherwise(0.7))


def table_check(tables: DataFrame, doc: str, columns: str = "num_cols") -> DataFrame:
    """(doc, tables, valid, confidence, passed): the share of tables with two columns or more."""
    out = tables.groupBy(doc).agg(F.count(F.lit(1)).alias("tables"), F.count_if(F.col(columns) >= 2).alias("valid"))
    out = out.withColumn("confidence", F.round(F.col("valid") / F.col("tables"), 6))
    return out.withColumn("passed", F.col("confidence") >= 0.8)


def term_check(texts: DataFrame, doc: str, text: str, terms: list[str]) -> DataFrame:
    """(doc, missing, confidence): critical terms that no text of the document holds."""
    held = [F.bool_or(F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(t.lower()))).alias(f"t{i}") for i, t in enumerate(terms)]
    out = texts.groupBy(doc).agg(*held)
    missing = sum((F.when(F.col(f"t{i}"), 0).otherwise(1) for i in range(len(terms))), F.lit(0))
    return out.select(doc, missing.alias("missing"), F.round(1.0 - missing / F.lit(float(len(terms))), 6).alias("confidence"))


def overall(stages: DataFrame, doc: str, confidence: str = "confidence", least: float = 0.8) -> DataFrame:
    """(doc, confidence, passed): mean confidence of the stages."""
    out = stages.groupBy(doc).agg(F.round(F.avg(confidence), 6).alias("confidence"))
    return out.withColumn("passed", F.col("confidence") >= least)
