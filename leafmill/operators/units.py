"""Quantities recorded in different units, brought to common units.

1. Each reading's table is parsed in Arrow batches: a skeleton (the grid without numbers
   and units) and the quantities with the unit named in the cell, the header or a note.
2. Readings of one source and skeleton form a history, ordered by time. Each quantity's
   log values are segmented by exact penalised changepoint search (optimal partitioning,
   squared error). A level shift that equals the factor between two units of the kind
   proposes a unit change, counted from the first reading whose unit is named. Where a
   reading names no unit the proposed change is reversed; where it names one, the name
   confirms or refutes the proposal.
3. Readings of one history whose common values agree within a tolerance are pairs
   (`same_in_other_units`) by one of two kinds of evidence: `shift`, confirmed unit changes at
   a level shift between them; or `name`, for what no factor can tell: units of one size
   (mg/mL and g/L), degrees Fahrenheit, and changes that no level shift marks.

A history longer than `BLOCK` readings is cut into consecutive stretches of time, each searched
with `OVERLAP` readings of its neighbours and with the history's first reading, so a history that
holds a third of all rows is spread over tasks. Places in time are counted by slices of time,
never in one task for the history. Levels of a segment that reaches over more than one stretch
are means of the part that the stretch sees.
Stored variants (values and units) are paired, not rows, with a band join on the first
quantity; rows are expanded last.

Null or empty tables, and tables without quantities, are in no history. A reading delivered
again counts once. A reading without time comes last. A null id, source or page never pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.units import ALL_UNITS, COMMON, PER, factor_of, parse_table
from leafmill.session import counted_side, cut

#: Readings of one history that one changepoint search takes at a time, and more on both sides.
BLOCK, OVERLAP = 64, 16
#: Cost of a further segment, in squared log units; a shift of five per cent pays for itself.
PENALTY = 0.001
#: Relative difference up to which two values are the same.
TOLERANCE = 0.02

PARSED = "id bigint, page int, history bigint, at timestamp, kinds array<string>, codes array<int>, raws array<double>, places array<string>"


def parse_readings(report: DataFrame, keep_places: bool = False) -> DataFrame:
    """One row per reading that states quantities; arrays are parallel, one entry a quantity.

    `history` is a digest of source, page and skeleton. `kinds` is kept only where a unit is
    not named (otherwise the code tells the kind), `places` (row:column:part) on request.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for id_, source, page, at, md in zip(b["id"], b["source"], b["page"], b["at"], b["markdown"], strict=True):
                got = parse_table(md)
                if got is None:
                    continue
                shape, qs = got
                digest = hashlib.blake2b(f"{source}\0{page}\0{shape}".encode(), digest_size=8).digest()
                named = all(q.code >= 0 for q in qs)
                out.append(
                    (
                        id_,
                        page,
                        int.from_bytes(digest, "big", signed=True),
                        at,
                        None if named else [q.kind for q in qs],
                        [q.code for q in qs],
                        [q.raw for q in qs],
                        [f"{q.row}:{q.col}:{q.part}" for q in qs] if keep_places else None,
                    )
                )
            yield pd.DataFrame(out, columns=["id", "page", "history", "at", "kinds", "codes", "raws", "places"])

    whole = report.dropna(subset=["id", "source", "page", "markdown"])
    return whole.select("id", "source", "page", "at", "markdown").mapInPandas(run, PARSED)


def segment_levels(values: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Level of each point after exact penalised changepoint search, column by column.

    `values` is (points, histories); optimal partitioning minimises the squared error plus
    `penalty` a segment, and is run over all histories at once.
    """
    n, m = values.shape
    s1 = np.vstack([np.zeros((1, m)), np.cumsum(values, axis=0)])
    s2 = np.vstack([np.zeros((1, m)), np.cumsum(values**2, axis=0)])
    best = np.full((n + 1, m), np.inf)
    best[0] = -penalty
    last = np.zeros((n + 1, m), dtype=np.int64)
    for t in range(1, n + 1):
        for s in range(t):
            total = s1[t] - s1[s]
            cost = best[s] + (s2[t] - s2[s]) - total**2 / (t - s) + penalty
            better = cost < best[t] - 1e-12
            best[t] = np.where(better, cost, best[t])
            last[t] = np.where(better, s, last[t])
    levels = np.empty_like(values)
    cols, end = np.arange(m), np.full(m, n)
    for t in range(n, 0, -1):  # walk back: point t-1 belongs to the segment ending at `end`
        start = last[end, cols]
        levels[t - 1] = (s1[end, cols] - s1[start, cols]) / (end - start)
        end = np.where(t - 1 == start, start, end)
    return levels


_BY_KIND: dict[str, list] = {}
for _u in ALL_UNITS:
    _BY_KIND.setdefault(_u.kind, []).append(_u)


@lru_cache(maxsize=50_000)
def unit_from_shift(kind: str, code: int, shift: float, tolerance: float = TOLERANCE) -> int:
    """The unit whose values lie `shift` (log) above those of unit `code`, -1 if none does."""
    if code < 0 or ALL_UNITS[code % PER].name == "°F":
        return -1
    for u in _BY_KIND.get(kind, ()):
        if u.name != "°F" and abs(shift - math.log(factor_of(code) / u.factor)) <= tolerance:
            return u.code
    return -1


def proposed_units(codes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Units that the level shifts of a history propose, -1 where they propose none.

    Both are (readings, quantities); each quantity's shifts are counted from the first reading
    that names its unit. A reading at that level is proposed the same unit.
    """
    named = codes >= 0
    columns = np.arange(codes.shape[1])
    first = named.argmax(axis=0)
    code = np.where(named.any(axis=0), codes[first, columns], -1)
    shift = levels - levels[first, columns]
    out = np.where(np.abs(shift) <= TOLERANCE, code, -1)
    for i, j in zip(*np.nonzero((np.abs(shift) > TOLERANCE) & (code >= 0)), strict=True):
        out[i, j] = unit_from_shift(ALL_UNITS[code[j] % PER].kind, int(code[j]), round(float(shift[i, j]), 4))
    return out


def _mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per stretch of a history: segment, propose units by level shifts, confirm them by the named units."""
    factors = np.array([u.factor for u in ALL_UNITS])
    fahrenheit = next(u.code for u in ALL_UNITS if u.name == "°F")
    for b in batches:
        blocks, by_size = [], {}
        for k, (rows, anchor) in enumerate(zip(b["readings"], b["anchor"], strict=True)):
            rows = sorted(rows, key=lambda r: (r["at"], r["id"]))
            if anchor is not None:
                rows.insert(0, {"id": None, "own": False, **anchor})
            blocks.append(rows)
            by_size.setdefault(len(rows), []).append(k)
        out = []
        for ks in by_size.values():
            # all histories of one length side by side
            raws, named = (np.concatenate([np.array([r[n] for r in blocks[k]]) for k in ks], axis=1) for n in ("raws", "codes"))
            proposed = proposed_units(named, segment_levels(np.log(np.maximum(np.abs(raws), 1e-9))))
            codes = np.where(named < 0, proposed, named)
            size, told = (factors[np.maximum(c, 0) % PER] / np.maximum(1, c // PER) for c in (codes, proposed))
            # a proposal that the name refutes marks nothing
            confirmed = (named < 0) | ((np.abs(size - told) <= 1e-9 * size) & (codes != fahrenheit))
            marks = np.where((proposed >= 0) & confirmed, proposed, -1)
            common = np.where(codes < 0, np.nan, np.where(codes == fahrenheit, (raws - 32.0) / 1.8, raws * size))
            at = 0
            for k in ks:
                rows = blocks[k]
                mine = slice(at, at + len(rows[0]["raws"]))
                at = mine.stop
                out += [(r["id"], b["page"][k], b["history"][k], codes[i, mine], marks[i, mine], common[i, mine]) for i, r in enumerate(rows) if r["own"]]
        yield pd.DataFrame(out, columns=["id", "page", "history", "codes", "marks", "commons"])


MARKED = "id bigint, page int, history bigint, codes array<int>, marks array<int>, commons array<double>"
KEYS = ["page", "history"]
_NO_TIME = 2**62


def in_stretches(timed: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Readings of long histories with their consecutive stretch of time, and those beside it.

    `timed` has the keys, id and at; `sizes` the keys, n, lo and hi. Places are counted in
    slices of time of about a stretch each, then the slices' offsets are added.
    """
    share = (F.col("at") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1)
    sliced = timed.join(counted_side(sizes), KEYS).withColumn("slice", F.floor(share * F.ceil(F.col("n") / block)))
    before = Window.partitionBy(*KEYS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(*KEYS, "slice").agg(F.count(F.lit(1)).alias("m")).withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    inside = F.row_number().over(Window.partitionBy(*KEYS, "slice").orderBy("at", "id")) - 1
    placed = sliced.withColumn("inside", inside).join(offsets, [*KEYS, "slice"]).withColumn("place", F.col("inside") + F.col("offset"))
    own, rest = F.floor(F.col("place") / block), F.pmod("place", F.lit(block))
    near = F.array_compact(F.array(own, F.when((rest < OVERLAP) & (own > 0), own - 1), F.when(rest >= block - OVERLAP, own + 1)))
    return placed.withColumn("mine", own).withColumn("block", F.explode(near)).withColumn("own", F.col("block") == F.col("mine"))


def mark_unit_changes(parsed: DataFrame, block: int = BLOCK, only_changes: bool = False) -> DataFrame:
    """Each reading's units, confirmed marks and common values after segmentation of its history.

    With `only_changes`, histories that write the same units throughout are left out: they hold
    no pair in different units, and nothing that would tell a unit left unnamed by all.

    `marks` has the unit that a level shift proposes, where the named unit doesn't refute it,
    else -1. `parsed` should be checkpointed: it is read more than once.
    """
    one = parsed.select(*KEYS, "id", F.coalesce(F.unix_micros("at"), F.lit(_NO_TIME)).alias("at"), "codes", "raws").dropDuplicates([*KEYS, "id"])
    timed = parsed.select(*KEYS, "id", F.coalesce(F.unix_micros("at"), F.lit(_NO_TIME)).alias("at"))
    first = F.min(F.struct("at", "id"))["id"].alias("id")
    sizes = cut(timed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max(F.when(F.col("at") < _NO_TIME, F.col("at"))).alias("hi"), first).where(F.col("n") > block))
    reading = F.collect_list(F.struct("at", "id", "codes", "raws", "own")).alias("readings")
    if sizes.isEmpty():
        whole = one.withColumn("own", F.lit(True)).groupBy(*KEYS).agg(reading)
        whole = whole.where(_changes()) if only_changes else whole
        return whole.withColumn("anchor", F.lit(None).cast("struct<codes:array<int>,raws:array<double>>")).select(*KEYS, "readings", "anchor").mapInPandas(_mark, MARKED)
    # only histories longer than a stretch need the first reading beside it
    keys = counted_side(sizes.select(*KEYS))
    short = one.join(keys, KEYS, "left_anti").select("*", F.lit(0).cast("bigint").alias("block"), F.lit(True).alias("own"))
    columns = short.columns
    # a long history may change its units from one stretch to the next
    wanted = _changes() | (F.col("block") > 0) | F.col("anchor").isNotNull() if only_changes else F.lit(True)
    bounds = sizes.select(*KEYS, "n", "lo", F.coalesce("hi", "lo").alias("hi"))
    long = in_stretches(one, bounds, block).select(*columns)
    anchors = sizes.select(*KEYS, "id").join(one, [*KEYS, "id"]).select(*KEYS, F.struct("codes", "raws").alias("anchor"))
    blocks = short.unionByName(long).groupBy(*KEYS, "block").agg(reading).join(counted_side(anchors), KEYS, "left")
    return blocks.where(wanted).select(*KEYS, "readings", "anchor").mapInPandas(_mark, MARKED)


def _changes():
    return F.size(F.array_distinct(F.transform("readings", lambda r: r["codes"]))) > 1


def same_in_other_units(marked: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(a, b, evidence), a < b: readings of one history with equal quantities, one of them in another unit.

    `evidence` is `shift` if a confirmed unit change at a level shift lies between the two, else `name`.
    """
    keys = KEYS
    rows = marked.where(~F.exists("commons", lambda v: v.isNull() | F.isnan(v))).withColumn("variant", F.xxhash64("codes", "marks", "commons"))
    variants = rows.groupBy(*keys, "variant").agg(*(F.any_value(c).alias(c) for c in ("codes", "marks", "commons")))
    first = F.element_at("commons", 1)
    width = -math.log(1.0 - tolerance)
    band = F.when(first > 0, F.floor(F.log(first) / width)).otherwise(F.lit(None))
    variants = variants.withColumn("band", F.coalesce(band, F.lit(-(2**40))))
    a = variants.withColumn("near", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).alias("a")
    b = variants.alias("b")
    on = F.col("a.near") == F.col("b.band")
    for k in keys:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    on &= (F.col("a.variant") < F.col("b.variant")) & (F.size("a.commons") == F.size("b.commons")) & (F.col("a.codes") != F.col("b.codes"))
    gap = F.zip_with("a.commons", "b.commons", lambda x, y: F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y)) + 1e-12)
    sizes = F.create_map(*(F.lit(x) for u in ALL_UNITS for x in (u.code, u.factor)))
    size = lambda c: F.try_element_at(sizes, F.pmod(c, F.lit(PER))) / F.greatest(F.lit(1), F.floor(c / F.lit(PER)))
    moved = F.zip_with("a.marks", "b.marks", lambda x, y: (x >= 0) & (y >= 0) & (x != y) & (F.abs(F.log(size(x) / size(y))) > tolerance))
    evidence = F.when(F.exists(moved, lambda m: m), "shift").otherwise("name").alias("evidence")
    alike = a.join(b, on).where(F.forall(gap, lambda ok: ok)).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.variant").alias("va"), F.col("b.variant").alias("vb"), evidence)
    members = rows.select(*keys, "variant", "id")
    left = alike.join(members.withColumnRenamed("variant", "va").withColumnRenamed("id", "ia"), [*keys, "va"])
    both = left.join(members.withColumnRenamed("variant", "vb").withColumnRenamed("id", "ib"), [*keys, "vb"])
    found = both.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "evidence").where("a < b")
    return found.groupBy("a", "b").agg(F.max("evidence").alias("evidence"))


def common_quantities(parsed: DataFrame, marked: DataFrame) -> DataFrame:
    """(id, row_no, col_no, part, kind, value, unit): every quantity in its kind's common unit.

    `parsed` needs its places. A quantity for which neither a named unit nor a marked shift
    gives a unit has a null kind, value and unit.
    """
    names = F.create_map(*(F.lit(x) for u in ALL_UNITS for x in (u.code, COMMON[u.kind])))
    kinds = F.create_map(*(F.lit(x) for u in ALL_UNITS for x in (u.code, u.kind)))
    places = parsed.select("id", "places").dropDuplicates(["id"])
    long = marked.dropDuplicates(["id"]).join(places, "id").select("id", F.inline(F.arrays_zip("places", "codes", "commons")))
    at = F.split("places", ":")
    code = F.pmod("codes", F.lit(PER))
    return long.select(
        "id",
        at[0].cast("int").alias("row_no"),
        at[1].cast("int").alias("col_no"),
        at[2].cast("int").alias("part"),
        F.when(F.col("codes") >= 0, F.try_element_at(kinds, code)).alias("kind"),
        F.when(F.col("codes") >= 0, F.round("commons", 6)).alias("value"),
        F.when(F.col("codes") >= 0, F.try_element_at(names, code)).alias("unit"),
    )


def readings(report: DataFrame, id_: str, source: str, page: str, at: str, text: str) -> DataFrame:
    """`report` in the column names used here."""
    return report.select(
        F.col(f"`{id_}`").alias("id"), F.col(f"`{source}`").alias("source"), F.col(f"`{page}`").alias("page"), F.col(f"`{at}`").alias("at"), F.col(f"`{text}`").alias("markdown")
    )


def unit_pairs(report: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parse, segment, pair; `columns` are id, source, page, time and text column of `report`."""
    parsed = cut(parse_readings(readings(report, *columns)))
    return same_in_other_units(cut(mark_unit_changes(parsed, only_changes=True)))
