"""Visually identical text with different characters.

Look-alike-mapped values are grouped in SQL under the accent-sensitive Unicode collation;
each class gets a deterministic canonical member (the stored value found most often, of
equals the shortest in characters, then the smallest in code point order), which is joined
back to every row, on digests of the stored value (128 bits), so texts are grouped once and
never the key of a join. Pairs are made between stored variants and expanded to rows last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.lookalike import COLLATION, fold, printed_as


def canonical_text(df: DataFrame, column: str, within: Sequence[str] = (), out: str = "canonical", times: str | None = None) -> DataFrame:
    """`df` with `out`: the canonical stored form of `column` among values printing alike.

    Null gives null, an empty text is its own class together with text made of invisible
    characters only. `within` restricts classes to rows equal in those columns; a row counts `times` its
    number in that column. Extra columns pass through; `out` must be a new name.
    """
    if out in df.columns:
        raise ValueError(f"column {out} exists")
    keys = [F.col(f"`{k}`").alias(f"_w{i}") for i, k in enumerate(within)]
    names = [f"_w{i}" for i in range(len(within))]
    col = F.col(f"`{column}`")
    stored = df.where(col.isNotNull()).groupBy(*keys, col.alias("_value")).agg(F.sum(F.col(f"`{times}`") if times else F.lit(1)).alias("_n"))
    looked = stored.select(*names, printed_as(F.col("_value")).alias("_look"), _rank("_n", ["_value"]).alias("_rank"), _digest(F.col("_value")).alias("_digest"))
    classes = looked.groupBy(*names, "_look").agg(F.min("_rank")["t0"].alias(out), F.collect_list("_digest").alias("_members"))
    # a form that is alone in its class is its own canonical member
    best = classes.where(F.size("_members") > 1).select(*names, out, F.explode("_members").alias("_member"))
    on = F.col("_member") == _digest(F.col(f"d.`{column}`"))
    for i, k in enumerate(within):
        on &= F.col(f"_w{i}").eqNullSafe(F.col(f"d.`{k}`"))
    return df.alias("d").join(best, on, "left").select(*(F.col(f"d.`{c}`") for c in df.columns), F.coalesce(best[out], F.col(f"d.`{column}`")).alias(out))


def _digest(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))


def _rank(n: str, texts: Sequence[str]) -> Column:
    """The canonical member has the least: most often, then shortest, then smallest in code points."""
    length = sum((F.length(t) for t in texts), F.lit(0))
    return F.struct((-F.col(n)).alias("n"), length.alias("l"), *(F.col(t).alias(f"t{i}") for i, t in enumerate(texts)))


def canonical_elements(df: DataFrame, column: str, out: str = "canonical") -> DataFrame:
    """`df` with `out`: the array `column` with each element in its canonical stored form.

    Classes are over all elements of all rows, so arrays printing alike get one form. A null
    array and null elements stay null. Equal arrays are rewritten once and joined back.
    """
    if out in df.columns:
        raise ValueError(f"column {out} exists")
    col = F.col(f"`{column}`")
    stored = df.where(col.isNotNull()).groupBy(col.alias("_array")).agg(F.count(F.lit(1)).alias("_times"))
    elements = stored.select("_array", "_times", F.posexplode("_array").alias("_at", "_element"))
    canonical = canonical_text(elements, "_element", out="_canonical", times="_times")
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_canonical")))
    arrays = canonical.groupBy("_array").agg(F.transform(ordered, lambda x: x["_canonical"]).alias(out))
    # an empty array has no elements to join back
    whole = df.alias("d").join(arrays, F.col(f"d.`{column}`") == F.col("_array"), "left")
    return whole.select(*(F.col(f"d.`{c}`") for c in df.columns), F.coalesce(arrays[out], F.col(f"d.`{column}`")).alias(out))


def _variants(df: DataFrame, key: str, within: Sequence[str], texts: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with their stored variant, variants of classes that hold more than one, with the class's `_look`).

    Rows are first aggregated to their stored variants, so a form repeated in a third of all
    rows is one row of the collated grouping. `_look` is the canonical variant.
    """
    kinds = dict(df.dtypes)
    as_text = [F.to_json(F.col(f"`{t}`")) if kinds[t].startswith("array") else F.col(f"`{t}`") for t in texts]
    rows = df.select(
        F.col(f"`{key}`").alias("_key"),
        *(F.col(f"`{w}`").alias(f"_w{i}") for i, w in enumerate(within)),
        *(t.alias(f"_t{i}") for i, t in enumerate(as_text)),
    )
    ws, ts = [f"_w{i}" for i in range(len(within))], [f"_t{i}" for i in range(len(texts))]
    rows = rows.withColumn("_variant", F.xxhash64(*ts))
    variants = rows.groupBy(*ws, "_variant").agg(*(F.first(t).alias(t) for t in ts), F.count(F.lit(1)).alias("_n"))
    looked = variants.select(*ws, "_variant", _rank("_n", ts).alias("_rank"), *(F.collate(fold(F.col(t)), COLLATION).alias(f"_l{i}") for i, t in enumerate(ts)))
    looks = [f"_l{i}" for i in range(len(ts))]
    classes = looked.groupBy(*ws, *looks).agg(F.min_by("_variant", "_rank").alias("_look"), F.collect_list("_variant").alias("_variants")).where(F.size("_variants") > 1)
    return rows.select("_key", *ws, "_variant"), classes.select(*ws, F.explode("_variants").alias("_variant"), "_look")


def classes_of_looks(df: DataFrame, key: str, within: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """(key, class_id): rows whose `texts` all print like another stored form's, with the class's smallest key.

    `texts` are text or array-of-text columns. Rows with a null key, text or `within` value are in no class.
    """
    rows, member = _variants(df.dropna(subset=[key, *within, *texts]), key, within, texts)
    ws = [f"_w{i}" for i in range(len(within))]
    m = rows.join(member, [*ws, "_variant"]).select("_key", *ws, "_look").distinct()
    first = m.groupBy(*ws, "_look").agg(F.min("_key").alias("class_id"))
    return m.join(first, [*ws, "_look"]).select(F.col("_key").alias(key), "class_id").distinct()


def alike_pairs(df: DataFrame, key: str, within: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """(a, b), a < b: rows that print alike in all `texts` but are stored differently in one.

    Rows with a null key, text or `within` value are in no pair. A row delivered again under the
    same key counts once. Variants are paired first, so rows of one variant never meet.
    """
    rows, member = _variants(df.dropna(subset=[key, *within, *texts]), key, within, texts)
    ws = [f"_w{i}" for i in range(len(within))]
    left, right = (member.withColumnRenamed("_variant", v) for v in ("_va", "_vb"))
    pairs = left.join(right, [*ws, "_look"]).where("_va < _vb").drop("_look")
    a, b = (rows.withColumnRenamed("_variant", v).withColumnRenamed("_key", k) for v, k in (("_va", "_a"), ("_vb", "_b")))
    both = pairs.join(a, [*ws, "_va"]).join(b, [*ws, "_vb"]).where("_a <> _b")
    return both.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
