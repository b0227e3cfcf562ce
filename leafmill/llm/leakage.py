"""Held-out passages that turn up in a corpus.

Words are runs of letters and figures of the folded, lower-cased text, so case, punctuation,
spacing, line breaks and character forms don't matter. A document leaks an item if it holds
at least `MIN_WORDS` consecutive words of its passage (words as the passage writes them: one
written with a hyphen is one word).

Prefix-filtered set join: every window of `MIN_WORDS` words of a passage is a set of
five-word shingles, all of which a document must hold to contain the window. Shingles are
ordered by their corpus count, and the rarest one of each window is its necessary prefix:
only documents that hold it are candidates. Position of the shingle in document and window
fixes where the window would lie; it must lie within the document. Each candidate is then
verified over a window of the item's size at that place: the matching shingles there are
joined into runs, and a run must cover `MIN_WORDS` whole words. Shingles are compared by
64-bit digests; a run of ten words is six digests in sequence.

Null and empty texts hold nothing. Items with fewer than `MIN_WORDS` words can't leak.
Repeated rows of a document give one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.lookalike import fold
from leafmill.session import counted_side, cut

MIN_WORDS, SHINGLE = 10, 5
_GAP = "[^\\p{L}\\p{N}]+"


def plain_words(text: Column) -> Column:
    """The words of a text, as an array."""
    return F.filter(F.split(F.lower(fold(text)), _GAP), lambda w: w != "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(words: Column, size: int = SHINGLE) -> Column:
    """Digests of all runs of `size` words, given as `hashed` column; null if there are fewer.

    `words` must be a column, not an expression: inside the lambda an expression would be
    worked out again for each run.
    """
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size))
    return F.transform(places, lambda i: F.xxhash64(F.slice(words, i + 1, size)))


def passage_words(items: DataFrame, item: str, passage: str) -> DataFrame:
    """(item, words, starts, ends): plain words, and where each written word starts and ends."""
    written = F.filter(
        F.transform(F.split(F.lower(fold(F.col(f"`{passage}`"))), "\\s+"), lambda w: F.size(F.filter(F.split(w, _GAP), lambda x: x != ""))),
        lambda n: n > 0,
    )
    rows = items.where(F.col(f"`{passage}`").isNotNull()).select(
        F.col(f"`{item}`").alias("item"), plain_words(F.col(f"`{passage}`")).alias("words"), written.alias("sizes")
    )
    total = lambda n: F.aggregate(F.slice("sizes", 1, n), F.lit(0), lambda a, x: a + x)
    places = F.when(F.size("sizes") > 0, F.sequence(F.lit(0), F.size("sizes") - 1)).otherwise(F.array().cast("array<int>"))
    return rows.dropDuplicates(["item"]).select(
        "item", "words", F.transform(places, total).alias("starts"), F.transform(places, lambda i: total(i + 1)).alias("ends")
    )


def leaked_items(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, passage: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, item): every document and item whose passage it holds for `min_words` words."""
    passages = cut(passage_words(items, item, passage))
    item_words = passages.select("item", hashed(F.col("words")).alias("words"))
    item_shingles = item_words.select("item", F.posexplode(shingles(F.col("words"))).alias("ipos", "h")).where("h is not null")

    # one pass over the corpus: shingles that any passage holds
    wanted = counted_side(item_shingles.select("h").distinct())
    spread = documents.where(F.length(F.col(f"`{text}`")) > 0).select(F.col(f"`{doc}`").alias("doc"), hashed(plain_words(F.col(f"`{text}`"))).alias("words"))
    spread = spread.select("doc", F.size("words").alias("n"), F.posexplode(shingles(F.col("words"))).alias("pos", "h"))
    held = cut(spread.join(wanted, "h").select("doc", "n", "pos", "h"))

    # the rarest shingle of each window of min_words words
    counts = held.groupBy("h").agg(F.count(F.lit(1)).alias("found"))
    last = F.size("starts") - min_words
    windows = passages.where(last >= 0).select("item", F.explode(F.sequence(F.lit(0), last)).alias("w"), "starts", "ends")
    windows = windows.select("item", "w", F.get("starts", F.col("w")).alias("a"), F.get("ends", F.col("w") + (min_words - 1)).alias("b"))
    places = windows.where(F.col("b") - F.col("a") >= SHINGLE).select("item", "w", "a", "b", F.explode(F.expr(f"sequence(a, b - {SHINGLE})")).alias("ipos"))
    ranked = places.join(item_shingles, ["item", "ipos"]).join(counts, "h", "left")
    rarity = F.struct(F.coalesce("found", F.lit(0)).alias("n"), F.col("ipos").alias("p"))
    prefix = ranked.groupBy("item", "w").agg(F.min_by(F.struct("h", "ipos", "a", "b"), rarity).alias("x")).select("item", "x.*")

    # candidates: length and positional bounds
    at = F.col("pos") - F.col("ipos")
    near = held.join(counted_side(prefix), "h").select("doc", "item", at.alias("diag")).where((at + F.col("a") >= 0) & (at + F.col("b") <= F.col("n")))
    near = near.distinct()

    # verification over a window of the item's size
    expected = near.join(counted_side(item_shingles), "item").withColumn("pos", F.col("diag") + F.col("ipos"))
    same = expected.join(held.select("doc", "pos", "h").distinct(), ["doc", "pos", "h"])
    run = F.col("ipos") - F.row_number().over(Window.partitionBy("doc", "item", "diag").orderBy("ipos"))
    runs = same.withColumn("run", run).groupBy("doc", "item", "diag", "run").agg(F.min("ipos").alias("a"), (F.max("ipos") + SHINGLE).alias("b"))
    runs = runs.join(counted_side(passages.select("item", "starts", "ends")), "item")
    whole = F.size(F.filter(F.arrays_zip("starts", "ends"), lambda x: (x["starts"] >= F.col("a")) & (x["ends"] <= F.col("b"))))
    return runs.where(whole >= min_words).select(F.col("doc").alias(doc), F.col("item").alias(item)).distinct()
