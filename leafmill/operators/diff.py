"""Differences between two copies of one dataset.

Both copies are reduced to narrow normalised rows (key, one digest per field), so text
never crosses the network. `EXCEPT ALL` in both directions on those rows leaves the two
residues, which are small when the copies agree; a full join of the residues by key lists
one-sided keys and, for keys on both sides, each field that differs.

Nulls: a null field equals a null field and differs from an empty one. A null array element
differs from an empty one and from an absent one. Rows with a null key are compared by
that null key. Repeated deliveries of a key count once: the latest by `version`, and of
equal versions the one with the greatest digests. Empty tables give an empty result or,
against a full one, only one-sided rows. Extra columns on either side are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from leafmill.functions.lookalike import COLLATION, fold, printed_as


def field_digest(df: DataFrame, name: str) -> Column:
    """64-bit digest of a field's printed form, null for null.

    Text is folded and hashed under the accent-sensitive collation; arrays of text go through
    JSON, which keeps order and tells null, empty and absent elements apart.
    """
    kind, col = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, StringType):
        value = printed_as(col)
    elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
        value = F.collate(F.to_json(F.transform(col, fold)), COLLATION)
    elif isinstance(kind, ArrayType):
        value = F.to_json(col)
    else:
        return col
    return F.when(col.isNotNull(), F.xxhash64(value))


def normalised(df: DataFrame, key: str, fields: Sequence[str], version: str | None = None) -> DataFrame:
    """One row per key: `_k` and `_f0.._fn`, the latest delivery's digests."""
    rows = df.select(
        F.col(f"`{key}`").alias("_k"),
        F.struct(
            *([F.col(f"`{version}`").alias("_v")] if version else []),
            *(field_digest(df, f).alias(f"_f{i}") for i, f in enumerate(fields)),
        ).alias("_row"),
    )
    last = rows.groupBy("_k").agg(F.max("_row").alias("_row"))
    return last.select("_k", *(F.col("_row")[f"_f{i}"].alias(f"_f{i}") for i in range(len(fields))))


def table_differences(
    left: DataFrame,
    right: DataFrame,
    key: str,
    fields: Sequence[str],
    left_version: str | None = None,
    right_version: str | None = None,
    only_left: str = "only_left",
    only_right: str = "only_right",
) -> DataFrame:
    """(key, difference): `only_left` / `only_right`, else one row for each differing field."""
    a, b = normalised(left, key, fields, left_version), normalised(right, key, fields, right_version)
    ra = a.exceptAll(b).withColumn("_in", F.lit(True)).alias("a")
    rb = b.exceptAll(a).withColumn("_in", F.lit(True)).alias("b")
    both = ra.join(rb, F.col("a._k").eqNullSafe(F.col("b._k")), "full")
    found = F.array_compact(
        F.array(
            F.when(F.col("b._in").isNull(), F.lit(only_left)).when(F.col("a._in").isNull(), F.lit(only_right)),
            *(
                F.when(
                    F.col("a._in") & F.col("b._in") & ~F.col(f"a._f{i}").eqNullSafe(F.col(f"b._f{i}")), F.lit(f)
                )
                for i, f in enumerate(fields)
            ),
        )
    )
    return both.select(
        F.when(F.col("a._in"), F.col("a._k")).otherwise(F.col("b._k")).alias(key),
        F.explode(found).alias("difference"),
    )
