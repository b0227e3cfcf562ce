"""Queries of the table operators, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.config import Config
from leafmill.functions import bands
from leafmill.functions.text import audit_hash, cache_key, clean_cell, norm_cell, signature
from leafmill.operators import classify, compare, dosing, markdown
from leafmill.sources.tables import latest, table

#: The library's own lists; drug names come from the table of dose ranges.
CONFIG = Config()
MAX_SETTINGS = 10_000


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Readings without error, each in its latest delivery."""
    t = table(spark, folder, "cross_validation_report").where(F.col("error").isNull() & F.col("markdown").isNotNull())
    return latest(t, "report_id", ["report_id", "doc_id", "engine", "page", "table_index_on_page", "classification", "num_rows", "num_cols", "markdown", "bbox"])


def dose_ranges(spark: SparkSession, folder: str) -> dict[str, tuple[float, float]]:
    """The dose ranges as settings, by drug name; a settings table, not data."""
    rows = table(spark, folder, "dose_ranges").orderBy("drug").limit(MAX_SETTINGS + 1).collect()
    if len(rows) > MAX_SETTINGS:
        raise ValueError("too many dose ranges for settings")
    return {r["drug"]: (r["min_mg_per_kg"], r["max_mg_per_kg"]) for r in rows}


def md_cells(spark, folder):
    return markdown.table_cells(readings(spark, folder), "report_id", "markdown")


def md_cells_keep_empty(spark, folder):
    return markdown.table_cells(readings(spark, folder), "report_id", "markdown", keep_empty=True)


def table_linearise(spark, folder):
    r = readings(spark, folder).where(F.col("classification").isin("dosing", "clinical_management"))
    return r.select("report_id", markdown.linearised(F.col("markdown")).alias("nll"))


def table_classify(spark, folder):
    r = readings(spark, folder)
    k = classify.table_class(F.col("markdown"), CONFIG)
    return r.select("report_id", k.alias("class")).withColumn("kind", classify.chunk_kind(F.col("class")))


def class_counts(spark, folder):
    t = table(spark, folder, "cross_validation_report").dropDuplicates(["report_id"])
    k = F.when(F.col("error").isNotNull(), "error").otherwise(F.coalesce("classification", F.lit("none")))
    return t.groupBy(k.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def class_refine(spark, folder):
    r = readings(spark, folder).withColumn("old", F.coalesce("classification", F.lit("other")))
    out = r.select("report_id", "old", classify.refined_class(F.col("markdown"), F.col("old")).alias("new"))
    return out.where("old <> new")


def table_quality(spark, folder):
    r = readings(spark, folder)
    issues = classify.table_issues(F.col("markdown"), F.coalesce("classification", F.lit("other")))
    return r.select("report_id", F.array_join(issues, ", ").alias("issues"), (F.size(issues) == 0).alias("passed"))


def first_cells(spark, folder):
    cells = table(spark, folder, "cross_validation_report").where(F.col("error").isNull()).select(F.explode("cells").alias("c")).where("c.col_no = 0")
    return cells.select(F.col("c.cell_value").alias("cell")).where("cell is not null").distinct()


def band_parse(spark, folder):
    c = F.col("cell")
    out = first_cells(spark, folder).withColumn("a", bands.band_strict(c)).withColumn("b", bands.band_first(c)).withColumn("d", bands.band_loose(c))
    return out.select("cell", *(F.col(f"{k}.{x}").alias(f"{n}_{x}") for k, n in (("a", "strict"), ("b", "first"), ("d", "loose")) for x in ("low", "high")))


def dose_numbers(spark, folder):
    cells = table(spark, folder, "cross_validation_report").where(F.col("error").isNull()).select(F.explode("cells.cell_value").alias("cell")).where("cell is not null").distinct()
    return cells.select("cell", F.posexplode(bands.dose_values(F.col("cell"))).alias("place", "value"))


def cell_norm(spark, folder):
    cells = table(spark, folder, "cross_validation_report").where(F.col("error").isNull()).select(F.explode("cells.cell_value").alias("cell")).where("cell is not null").distinct()
    return cells.select("cell", norm_cell(F.col("cell")).alias("normal"), clean_cell(F.col("cell")).alias("clean"))


def dosing_checks(spark, folder):
    r = readings(spark, folder).where("classification = 'dosing'")
    return dosing.dosing_checks(r, "report_id", "markdown", dose_ranges(spark, folder))


def check_report(spark, folder):
    return dosing.check_report(dosing_checks(spark, folder))


def check_table_kinds(spark, folder):
    """Dosing tables by what could be checked."""
    c = dosing_checks(spark, folder)
    kind = F.when(~F.col("parsed"), "skipped").when(F.col("passed"), "passed_all").otherwise("with_issues")
    return c.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _engines(spark, folder):
    r = readings(spark, folder)
    return r.where("engine = 'docling'"), r.where("engine = 'pymupdf'")


def cell_agreement(spark, folder):
    a, b = _engines(spark, folder)
    return compare.cell_agreement(a, b, ["doc_id", "page"], "report_id", "markdown")


def cell_diff(spark, folder):
    a, b = _engines(spark, folder)
    return compare.cell_differences(a, b, compare.cell_agreement(a, b, ["doc_id", "page"], "report_id", "markdown"), ["doc_id", "page"], "report_id", "markdown")


def mean_agreement(spark, folder):
    return cell_agreement(spark, folder).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("agreement"), 4).alias("mean_agreement"))


def page_break_pairs(spark, folder):
    return compare.page_break_pairs(readings(spark, folder).withColumnRenamed("report_id", "id"))


def stitch_tables(spark, folder):
    r = readings(spark, folder)
    return compare.stitched_rows(page_break_pairs(spark, folder), r, "report_id", "markdown")


def class_enrich(spark, folder):
    """Final class and chunk kind of each reading, refined classes and the document's name joined."""
    r = readings(spark, folder).select("report_id", "doc_id", F.coalesce("classification", F.lit("other")).alias("stage1"))
    changed = class_refine(spark, folder).select("report_id", F.col("new").alias("stage2"))
    docs = table(spark, folder, "guideline_docs").select("doc_id", "short_name")
    out = r.join(changed, "report_id", "left").join(docs, "doc_id", "left").withColumn("final", F.coalesce("stage2", "stage1"))
    return out.select("report_id", "short_name", "stage1", "stage2", "final", classify.chunk_kind(F.col("final")).alias("kind"))


def anti_reclass(spark, folder):
    """Dosing tables that the refinement left as they were."""
    r = readings(spark, folder).where("classification = 'dosing'").select("report_id", "page")
    return r.join(class_refine(spark, folder).select("report_id"), "report_id", "left_anti")


def semi_pages(spark, folder):
    """Readings on pages of which there is an image."""
    pages = table(spark, folder, "images").select("doc_id", F.col("page_no").alias("page")).distinct()
    return readings(spark, folder).select("report_id", "doc_id", "page").join(pages, ["doc_id", "page"], "left_semi")


def audit_hashes(spark, folder):
    r = readings(spark, folder)
    return r.select(
        "report_id",
        audit_hash(F.col("markdown")).alias("content_hash"),
        signature(F.col("doc_id"), F.col("engine"), F.col("report_id"), audit_hash(F.col("markdown"))).alias("signature"),
        cache_key(F.col("doc_id"), F.col("page")).alias("cache_key"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        md_cells, md_cells_keep_empty, table_linearise, table_classify, class_counts, class_refine, table_quality, band_parse, dose_numbers,
        cell_norm, dosing_checks, check_report, check_table_kinds, cell_agreement, cell_diff, mean_agreement, page_break_pairs, stitch_tables,
        class_enrich, anti_reclass, semi_pages, audit_hashes,
    )
}

# --- SQL -------------------------------------------------------------------------------------


def _s(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_R = (
    "r as (select report_id, doc_id, engine, page, table_index_on_page, classification, num_rows, num_cols, markdown, bbox "
    "from cross_validation_report where error is null and markdown is not null qualify row_number() over (partition by report_id order by loaded_at desc nulls last) = 1)"
)
_LINES = f"ln as (select report_id, list_filter(list_transform(string_split(markdown, chr(10)), x -> {_s('x')}), x -> x <> '' and not contains(x, '---')) as ls from r)"
_TIGHT = f"list_filter(list_transform(string_split(line, '|'), x -> {_s('x')}), x -> x <> '')"
_WIDE_RAW = f"list_transform(string_split(line, '|'), x -> {_s('x')})"
_WIDE = "w[(case when w[1] = '' then 2 else 1 end):(len(w) - (case when w[len(w)] = '' then 1 else 0 end))]"
_ROWS = "rw as (select report_id, unnest(range(len(ls))) as row_no, unnest(ls) as line from ln)"


def _score(words) -> str:
    return "(" + " + ".join(f"contains(lower(markdown), '{w.lower()}')::int" for w in words) + ")"


def _kind(col: str) -> str:
    return f"case {col} " + " ".join(f"when '{k}' then '{v}'" for k, v in classify.CHUNK_KINDS.items()) + " else 'other_table' end"


_CLASS = (
    f"case when greatest(d, e, s, c) >= 2 then (case greatest(d, e, s, c) when d then 'dosing' when e then 'evidence' when s then 'structural' else 'clinical_management' end) "
    f"when c >= 1 and d = 0 then 'clinical_management' else 'other' end"
)
_REFINE = (
    f"rf as (select r.report_id, coalesce(classification, 'other') as old, "
    f"regexp_matches(markdown, '{classify.WEIGHT_CELL}') as wt, regexp_matches(markdown, '{classify.DOSE_CELL}') as ds, "
    f"coalesce(regexp_matches(ln.ls[1], '{classify.DOSING_HEADER}'), false) as hd from r join ln using (report_id)), "
    "rn as (select report_id, old, case when old <> 'dosing' then old when hd and (wt or ds) then old when not wt and not ds then 'structural' "
    "when not wt then 'dosing (no weight bands)' else old end as new from rf)"
)
_N = "([\\d.]+)"


def _band_sql(rules, col: str) -> tuple[str, str]:
    """low and high by the first rule whose pattern matches."""
    low = high = "case "
    for kind, p in rules:
        test = f"when regexp_matches({col}, '{p}')" + (f" and contains({col}, '<')" if kind == "holds <" else "") + " then "
        low += test + (f"try_cast(regexp_extract({col}, '{p}', 1) as double) " if kind in ("two", "open") else "0.0 ")
        high += test + ("null " if kind == "open" else f"try_cast(regexp_extract({col}, '{p}', {2 if kind == 'two' else 1}) as double) ")
    return low + "end", high + "end"


_STRICT = [("two", f"^>\\s*{_N}\\s*to\\s*<=?\\s*{_N}"), ("two", f"^{_N}\\s*(?:to|-)\\s*<=?\\s*{_N}"), ("two", f"^{_N}\\s*<\\s*{_N}"), ("open", f"^>=?\\s*{_N}"), ("below", f"^<=?\\s*{_N}")]
_FIRST = [("two", f"^{_N}\\s*(?:to|-)\\s*<?=?\\s*{_N}"), ("open", f"^>=?\\s*{_N}"), ("holds <", f"^<?=?\\s*{_N}")]
_LOOSE = [("below", f"^<\\s*{_N}"), ("two", f"{_N}\\s*(?:to|–|-)\\s*<\\s*{_N}"), ("two", f"{_N}\\s*(?:to|–|-)\\s*{_N}"), ("two", f">\\s*{_N}\\s*(?:to|–|-)\\s*≤\\s*{_N}"), ("two", f"{_N}\\s*<\\s*{_N}"), ("open", f"[≥>]=?\\s*{_N}")]
_CELLS = "cl as (select distinct c.cell_value as cell from (select unnest(cells) as c from cross_validation_report where error is null) where c.cell_value is not null {more})"
_STRICT_FORM = "translate(replace(replace(regexp_replace({s}, '\\s*[a-dA-D]\\s*$', ''), '≥', '>='), '≤', '<='), '–—', '--')".replace("{s}", _s("{x}"))


def _norm(x: str) -> str:
    return (
        "lower(trim(regexp_replace(replace(translate(replace(replace(" + x + ", '≥', '>='), '≤', '<='), '–—×', '--x'), '±', '+/-'), '\\s+', ' ', 'g')))"
    )


_sl, _sh = _band_sql(_STRICT, "c1")
_fl, _fh = _band_sql(_FIRST, "c2")
_ll, _lh = _band_sql(_LOOSE, "c3")

_DOSING = f"""with {_R}, {_LINES},
hd as (select ln.report_id, ls, list_filter(list_transform(string_split(ls[1], '|'), x -> {_s('x')}), x -> x <> '') as heads from ln join r using (report_id) where classification = 'dosing' and len(ls) >= 2),
dr as (select list(struct_pack(d := lower(drug), lo := min_mg_per_kg, hi := max_mg_per_kg) order by drug) as known from dose_ranges),
wc as (select report_id, ls, heads, list_position(list_transform(heads, h -> contains(lower(h), 'weight')), true) as w, known from hd, dr where len(heads) > 0),
dc0 as (select *, list_filter(range(1, len(heads) + 1), i -> (w is null or i <> w) and (contains(lower(heads[i]), 'dose') or contains(lower(heads[i]), 'mg') or contains(lower(heads[i]), 'tablet') or len(list_filter(known, k -> contains(lower(heads[i]), k.d))) > 0)) as named,
  list_filter(range(1, len(heads) + 1), i -> w is null or i <> w) as others from wc),
dc as (select report_id, ls, heads, w, known, case when len(named) = 0 and w is not null then others else named end as cols from dc0),
bd as (select report_id, heads, w, known, cols, unnest(range(1, len(ls))) as n, unnest(ls[2:]) as line from dc),
bc as (select * from (select report_id, heads, w, known, cols, n, {_TIGHT} as cells from bd) where len(cells) > 0),
bw as (select *, coalesce(cells[w], '') as wcell from bc),
b1 as (select *, {_STRICT_FORM.format(x='wcell')} as c1, row_number() over (partition by report_id order by n) as rn from bw),
bb as (select *, {_sl} as low, {_sh} as high, (wcell <> '' and ({' or '.join(f"regexp_matches(c1, '{p}')" for _, p in _STRICT)})) as is_band from b1),
bands as (select report_id, low, high, row_number() over (partition by report_id order by rn) as k, count(*) over (partition by report_id) as n from bb where is_band),
pairs as (select report_id, low, high, k, n, lead(low) over (partition by report_id order by k) as nlow from bands),
x1 as (select report_id, count(*) filter (where n >= 2 and k < n and (high is null or abs(high - nlow) > 0.5)) as contiguity, max(n) as bands from pairs group by 1),
x3 as (select report_id, max(case when k = 1 and low > 10.0 then 1 else 0 end) + max(case when k = n and ((high is not null and high < 35.0) or (high is null and low < 17.5)) then 1 else 0 end) as coverage from bands group by 1),
dl as (select report_id, rn, wcell, low, high, is_band, heads, known, unnest(range(1, len(cols) + 1)) as j, unnest(cols) as cidx, cells from bb),
dv as (select report_id, rn, low, high, is_band, heads[cidx] as head, known, j, coalesce(cells[cidx], '') as cell from dl),
dn as (select *, list_transform(regexp_extract_all(cell, '([0-9]+\\.?[0-9]*)', 1), x -> try_cast(x as double)) as vals from dv),
dx as (select report_id, rn, low, high, is_band, head, known, j, unnest(range(1, len(vals) + 1)) as comp, unnest(vals) as v from dn),
x2 as (select report_id, count(*) filter (where v < pv) as monotonic from (select report_id, v, lag(v) over (partition by report_id, j, comp order by rn) as pv from dx) group by 1),
db as (select *, list_filter(known, k -> contains(lower(head), k.d))[comp] as ref, case when high is null then low + 20.0 when low = 0.0 then high / 2.0 else (low + high) / 2.0 end as mid from dx),
x4 as (select report_id, count(*) filter (where is_band and ref is not null and mid > 0 and v > 0 and (v / mid < ref.lo / 2.5 or v / mid > ref.hi * 2.5)) as bounds from db group by 1),
rt as (select report_id, j, count(*) as rows2, list_sort(list(vals[2] / vals[1]) filter (where vals[1] > 0)) as ratios from dn where len(vals) >= 2 group by 1, 2),
x5 as (select report_id, sum(case when rows2 < 2 or len(ratios) = 0 or ratios[len(ratios) // 2 + 1] <= 0 then 0 else len(list_filter(ratios, q -> abs(q - ratios[len(ratios) // 2 + 1]) / ratios[len(ratios) // 2 + 1] > 0.35)) end) as ratio from rt where ratios is not null group by 1),
x6a as (select report_id, count(*) filter (where wcell = '') as e from bb group by 1),
x6b as (select report_id, sum(case when cell = '' then 1 else len(list_filter(vals, v -> v <= 0)) end) as e from dn group by 1),
sz as (select report_id, count(*) as body_rows from bb group by 1),
al as (select dc.report_id, w is not null as parsed, coalesce(bands, 0) as bands, coalesce(body_rows, 0) as body_rows,
 case when w is null then 0 else coalesce(contiguity, 0) end as contiguity, case when w is null then 0 else coalesce(monotonic, 0) end as monotonic,
 case when w is null then 0 else coalesce(coverage, 0) end as coverage, case when w is null then 0 else coalesce(bounds, 0) end as bounds,
 case when w is null then 0 else coalesce(ratio, 0) end as ratio, case when w is null then 0 else coalesce(x6a.e, 0) + coalesce(x6b.e, 0) end as positive
 from dc left join x1 using (report_id) left join x2 using (report_id) left join x3 using (report_id) left join x4 using (report_id) left join x5 using (report_id)
 left join x6a on x6a.report_id = dc.report_id left join x6b on x6b.report_id = dc.report_id left join sz on sz.report_id = dc.report_id),
chk as (select report_id, parsed, bands::int as bands, body_rows::int as body_rows, contiguity::int as contiguity, monotonic::int as monotonic, coverage::int as coverage, bounds::int as bounds, ratio::int as ratio, positive::int as positive,
 parsed and contiguity + monotonic + coverage + bounds + ratio + positive = 0 as passed from al)
"""

_PAIR_SQL = f"""with {_R}, cells as (select report_id, doc_id, page, engine, row_no, unnest(range(len(w2))) as col_no, unnest(w2) as cell from (
 select report_id, doc_id, page, engine, row_no, {_WIDE} as w2 from (select report_id, doc_id, page, engine, row_no, {_WIDE_RAW} as w from (
 select report_id, doc_id, page, engine, unnest(range(len(ls))) as row_no, unnest(ls) as line from (select report_id, doc_id, page, engine,
 list_filter(list_transform(string_split(markdown, chr(10)), x -> {_s('x')}), x -> x <> '' and not contains(x, '---')) as ls from r))))),
a as (select doc_id, page, report_id as left_key, row_no, col_no, cell from cells where engine = 'docling'),
b as (select doc_id, page, report_id as right_key, row_no, col_no, cell from cells where engine = 'pymupdf'),
an as (select doc_id, page, left_key, count(*) as ln from a group by all), bn as (select doc_id, page, right_key, count(*) as rn from b group by all),
sm as (select doc_id, page, left_key, right_key, count(*) as placed, count(*) filter (where {_norm('a.cell')} = {_norm('b.cell')}) as matches from a join b using (doc_id, page, row_no, col_no) group by all),
sc as (select doc_id, page, left_key, right_key, coalesce(matches, 0) as matches, ln + rn - coalesce(placed, 0) as total from an join bn using (doc_id, page) left join sm using (doc_id, page, left_key, right_key)),
best as (select * from sc qualify row_number() over (partition by doc_id, page, left_key order by matches desc, right_key) = 1)
"""

_BREAKS = f"""with {_R}, pb as (select u.doc_id, u.engine, u.page, u.num_cols, u.report_id as upper_id, d.report_id as lower_id from r u join r d
 on u.doc_id = d.doc_id and u.engine = d.engine and d.page = u.page + 1 and u.num_cols = d.num_cols
 where u.bbox[4] / 842.0 >= 0.90 and d.bbox[2] / 842.0 <= 0.10 and u.report_id <> d.report_id)
"""

_SQL = {
    "md_cells": f"with {_R}, {_LINES}, {_ROWS} select report_id, row_no, unnest(range(len(cs))) as col_no, unnest(cs) as cell from (select report_id, row_no, {_TIGHT} as cs from rw)",
    "md_cells_keep_empty": f"with {_R}, {_LINES}, {_ROWS} select report_id, row_no, unnest(range(len(cs))) as col_no, unnest(cs) as cell from (select report_id, row_no, {_WIDE} as cs from (select report_id, row_no, {_WIDE_RAW} as w from rw))",
    "table_linearise": f"""with {_R}, {_LINES}, {_ROWS}, hd as (select report_id, {_TIGHT.replace('line', 'ls[1]')} as heads, len(ls) as n from ln),
 bd as (select rw.report_id, row_no, heads, {_TIGHT} as cs from rw join hd using (report_id) where row_no > 0),
 se as (select report_id, row_no, case when least(len(heads), len(cs)) = 0 then null else 'IF ' || heads[1] || ' is ' || cs[1] || case when least(len(heads), len(cs)) > 1
 then ', THEN ' || array_to_string(list_transform(range(2, least(len(heads), len(cs)) + 1), i -> heads[i] || ' is ' || cs[i]), ', ') || '.' else '' end end as s from bd),
 js as (select report_id, string_agg(s, chr(10) order by row_no) as nll from se where s is not null group by 1)
 select r.report_id, case when hd.n = 0 then '' when hd.n = 1 then markdown else coalesce(nll, '') end as nll from r join hd using (report_id) left join js using (report_id)
 where classification in ('dosing', 'clinical_management')""",
    "table_classify": f"with {_R}, sc as (select report_id, {_score(CONFIG.table_words)} as d, {_score(CONFIG.evidence_words)} as e, {_score(CONFIG.structural_words)} as s, {_score(CONFIG.clinical_words)} as c from r), "
    f"k as (select report_id, {_CLASS} as class from sc) select report_id, class, {_kind('class')} as kind from k",
    "class_counts": "select case when error is not null then 'error' else coalesce(classification, 'none') end as class, count(distinct report_id) as n from cross_validation_report group by 1",
    "class_refine": f"with {_R}, {_LINES}, {_REFINE} select report_id, old, new from rn where old <> new",
    "table_quality": f"""with {_R}, q as (select report_id, markdown, coalesce(classification, 'other') = 'dosing' as dz, list_filter(string_split(markdown, chr(10)), x -> contains(x, '|')) as ls from r),
 q2 as (select *, list_filter(ls, x -> not contains(x, '---'))[2:] as data from q),
 q3 as (select report_id, list_filter([case when length({_s('markdown')}) < 10 then 'nearly empty' end, case when len(ls) < 2 then 'missing header row' end,
 case when dz and len(list_filter(data, y -> len(list_filter(string_split(y, '|')[2:-2], z -> {_s('z')} = '')) > 0)) > 0 then 'empty cells' end,
 case when dz and not regexp_matches(markdown, '[≥≤<>±]') then 'missing comparison signs' end], i -> i is not null) as iss from q2)
 select report_id, array_to_string(iss, ', ') as issues, len(iss) = 0 as passed from q3""",
    "band_parse": f"with {_CELLS.format(more='and c.col_no = 0')}, f as (select cell, {_STRICT_FORM.format(x='cell')} as c1, translate(replace(replace({_s('cell')}, '≥', '>='), '≤', '<='), '–', '-') as c2, "
    + _s("regexp_replace(regexp_replace(" + _s("cell") + ", '\\s*[a-zA-Z]\\s*$', ''), '(?i)\\s*kg\\s*$', '')")
    + f" as c3 from cl), g as (select * from f) select cell, {_sl} as strict_low, {_sh} as strict_high, {_fl} as first_low, {_fh} as first_high, {_ll} as loose_low, {_lh} as loose_high from g",
    "dose_numbers": f"with {_CELLS.format(more='')} select cell, unnest(range(len(v))) as place, unnest(v) as value from (select cell, list_transform(regexp_extract_all(cell, '([0-9]+\\.?[0-9]*)', 1), x -> try_cast(x as double)) as v from cl)",
    "cell_norm": f"with {_CELLS.format(more='')} select cell, {_norm('cell')} as normal, trim(regexp_replace(regexp_replace(cell, '<br>|\\n', ' ', 'g'), '\\s+', ' ', 'g')) as clean from cl",
    "dosing_checks": _DOSING + "select * from chk",
    "check_report": _DOSING + "select c as check, count(*) filter (where n = 0) as passed, count(*) filter (where n > 0) as failed from (unpivot (select contiguity, monotonic, coverage, bounds, ratio, positive from chk where parsed) on contiguity, monotonic, coverage, bounds, ratio, positive into name c value n) group by 1",
    "check_table_kinds": _DOSING + "select case when not parsed then 'skipped' when passed then 'passed_all' else 'with_issues' end as kind, count(*) as n from chk group by 1",
    "cell_agreement": _PAIR_SQL + "select doc_id, page, left_key, right_key, matches, total, round(100.0::double * matches / total, 6) as agreement from best",
    "mean_agreement": _PAIR_SQL + "select count(*) as pairs, round(avg(100.0::double * matches / total), 4) as mean_agreement from best",
    "cell_diff": _PAIR_SQL
    + f", la as (select best.left_key, best.right_key, row_no, col_no, cell from best join a using (left_key)), rb as (select best.left_key, best.right_key, row_no, col_no, cell from best join b using (right_key)), "
    f"fd as (select left_key, right_key, row_no, col_no, coalesce(la.cell, '') as left_cell, coalesce(rb.cell, '') as right_cell from la full join rb using (left_key, right_key, row_no, col_no)) select * from fd where {_norm('left_cell')} <> {_norm('right_cell')}",
    "page_break_pairs": _BREAKS + "select doc_id, engine, page, num_cols, upper_id, lower_id from pb",
    "stitch_tables": _BREAKS
    + f""", {_LINES}, {_ROWS}, cw as (select report_id, row_no, list_transform({_WIDE}, x -> trim(regexp_replace(regexp_replace(x, '<br>|\\n', ' ', 'g'), '\\s+', ' ', 'g'))) as cells from (select report_id, row_no, {_WIDE_RAW} as w from rw)),
 up as (select upper_id, lower_id, 0 as part, row_no, cells from pb join cw on cw.report_id = upper_id),
 lo as (select pb.upper_id, pb.lower_id, 1 as part, cw.row_no, cw.cells, u.cells as head from pb join cw on cw.report_id = pb.lower_id left join up u on u.upper_id = pb.upper_id and u.lower_id = pb.lower_id and u.row_no = 0),
 al as (select * from up union all select upper_id, lower_id, part, row_no, cells from lo where not (row_no = 0 and cells is not distinct from head)),
 nu as (select upper_id, lower_id, row_number() over (partition by upper_id, lower_id order by part, row_no) - 1 as row_no, cells from al)
 select upper_id, lower_id, row_no, unnest(range(len(cells))) as col_no, unnest(cells) as cell from nu""",
    "class_enrich": f"with {_R}, {_LINES}, {_REFINE} select rn.report_id, g.short_name, rn.old as stage1, case when rn.new <> rn.old then rn.new end as stage2, rn.new as final, {_kind('rn.new')} as kind "
    "from rn join r on r.report_id = rn.report_id left join guideline_docs g on g.doc_id = r.doc_id",
    "anti_reclass": f"with {_R}, {_LINES}, {_REFINE} select rn.report_id, r.page from rn join r using (report_id) where classification = 'dosing' and old = new",
    "semi_pages": f"with {_R} select report_id, doc_id, page from r where exists (select 1 from images i where i.doc_id = r.doc_id and i.page_no = r.page)",
    "audit_hashes": f"with {_R} select report_id, sha256(markdown) as content_hash, sha256(concat(doc_id, '|', engine, '|', report_id, '|', sha256(markdown))) as signature, left(sha256(concat(doc_id, '|', page)), 16) as cache_key from r",
}

#: Lambdas are written short above.
SQL = {k: re.sub(r"\b([a-z]) -> ", r"lambda \1: ", v) for k, v in _SQL.items()}
