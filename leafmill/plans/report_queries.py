"""Queries of the report operators, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from leafmill.operators import reports
from leafmill.plans import table_queries as t
from leafmill.plans import text_queries as x
from leafmill.sources.tables import table


def discrepancies(spark, folder):
    return reports.discrepancies(t.cell_agreement(spark, folder), t.page_break_pairs(spark, folder), t.class_refine(spark, folder))


def table_fingerprints(spark, folder):
    """Header lines and the number of readings that share them."""
    r = t.readings(spark, folder).select(reports.fingerprint(F.col("markdown")).alias("fingerprint"))
    return r.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


def first_checks(spark, folder):
    return reports.first_checks(t.readings(spark, folder).where("classification = 'dosing'"), "report_id", "markdown")


def stitched_sentences(spark, folder):
    return reports.stitched_sentences(t.stitch_tables(spark, folder))


def tables_of_chunks(spark, folder):
    return reports.tables_of_chunks(x.chunk_rows(spark, folder), t.readings(spark, folder), ["doc_id", "page"], "chunk_id", "report_id")


def tables_without_chunk(spark, folder):
    return reports.tables_without_chunk(t.readings(spark, folder).select("report_id", "doc_id", "page", "num_rows"), x.chunk_rows(spark, folder), ["doc_id", "page"])


def review_flags(spark, folder):
    return reports.review_flags(t.readings(spark, folder), x.chunk_rows(spark, folder), "doc_id", "page", "text", "markdown")


def few_numbers(spark, folder):
    return reports.few_numbers(t.readings(spark, folder), "report_id", "markdown")


def conditions(spark, folder):
    """Condition and section type told by each guideline's title and each chunk's heading."""
    titles = table(spark, folder, "guideline_docs").select("doc_id", "title")
    c = x.chunk_rows(spark, folder).join(titles, "doc_id", "left")
    heads = F.array(F.coalesce("title", F.lit("")), F.coalesce("heading", F.lit("")))
    return c.select("chunk_id", reports.condition_of(heads, x.TOPICS).alias("condition"), reports.section_type_of(heads, {"monitoring": ("monitoring", "follow-up"), "safety": ("contraindication", "adverse")}).alias("section_type"))


def short_names(spark, folder):
    return table(spark, folder, "guideline_docs").select("doc_id", reports.short_name(F.col("title")).alias("name"))


QUERIES = {f.__name__: f for f in (discrepancies, table_fingerprints, first_checks, stitched_sentences, tables_of_chunks, tables_without_chunk, review_flags, few_numbers, conditions, short_names)}

_FB = (("two", "^([\\d.]+)\\s*(?:to|-)\\s*<?=?\\s*([\\d.]+)"), ("open", "^>=?\\s*([\\d.]+)"), ("holds <", "^<?=?\\s*([\\d.]+)"))
_fl, _fh = t._band_sql(_FB, "c2")
_is_band = "(" + " or ".join(f"regexp_matches(c2, '{p}')" + (" and contains(c2, '<')" if k == "holds <" else "") for k, p in _FB) + ")"


def _label(col: str) -> str:
    return "case " + " ".join(f"when regexp_matches({col}, '(?i){p}') then '{name}'" for p, name in x.TOPICS) + " end"


def _type(col: str) -> str:
    return f"case when contains(lower({col}), 'monitoring') or contains(lower({col}), 'follow-up') then 'monitoring' when contains(lower({col}), 'contraindication') or contains(lower({col}), 'adverse') then 'safety' end"


_SQL = {
    "discrepancies": t._PAIR_SQL.replace(t._R, t._R + f", {t._LINES}, {t._REFINE}")
    + ", pb as (select u.report_id as upper_id, d.report_id as lower_id from r u join r d on u.doc_id = d.doc_id and u.engine = d.engine and d.page = u.page + 1 and u.num_cols = d.num_cols where u.bbox[4] / 842.0 >= 0.90 and d.bbox[2] / 842.0 <= 0.10 and u.report_id <> d.report_id) "
    "select 'cells' as kind, left_key as id, floor(round(100.0::double * matches / total, 6))::bigint::varchar as detail from best where round(100.0::double * matches / total, 6) < 100 "
    "union all select 'divided', upper_id, lower_id::varchar from pb union all select 'class', report_id, new from rn where old <> new and new <> 'dosing (no weight bands)'",
    "table_fingerprints": f"with {t._R}, {t._LINES} select lower(trim(regexp_replace(replace(ls[1], '|', ' '), '\\s+', ' ', 'g'))) as fingerprint, count(*) as n from ln group by 1",
    "first_checks": f"""with {t._R}, {t._LINES}, h as (select ln.report_id, ls, list_filter(list_transform(string_split(ls[1], '|'), z -> {t._s('z')}), z -> z <> '') as heads from ln join r using (report_id) where classification = 'dosing' and len(ls) >= 2),
 w as (select *, list_position(list_transform(heads, z -> contains(lower(z), 'weight')), true) as w from h where len(heads) > 0),
 d as (select *, list_filter(range(1, len(heads) + 1), i -> i <> w and (contains(lower(heads[i]), 'dose') or contains(lower(heads[i]), 'mg') or contains(lower(heads[i]), 'tablet')))[1] as d from w where w is not null),
 b as (select report_id, n, w, d, list_filter(list_transform(string_split(line, '|'), z -> {t._s('z')}), z -> z <> '') as cs from (select report_id, w, d, unnest(range(1, len(ls))) as n, unnest(ls[2:]) as line from d)),
 c as (select report_id, n, cs[d] as dose, translate(replace(replace({t._s('cs[w]')}, '≥', '>='), '≤', '<='), '–', '-') as c2 from b),
 bd as (select report_id, n, {_fl} as low, {_fh} as high from c where {_is_band}), g as (select report_id, count(*) filter (where abs(high - nl) > 0.5) as gaps from (select report_id, high, lead(low) over (partition by report_id order by n) as nl from bd) group by 1),
 dv as (select report_id, n, try_cast(regexp_extract(coalesce(dose, ''), '([\\d.]+)', 1) as double) as v from c), q as (select report_id, count(*) filter (where v < pv) as drops from (select report_id, v, lag(v) over (partition by report_id order by n) as pv from dv where v is not null) group by 1)
 select d.report_id, coalesce(gaps, 0) as gaps, coalesce(drops, 0) as drops from d left join g using (report_id) left join q using (report_id)""",
    "stitched_sentences": f"""with ss as ({t.SQL['stitch_tables']}), rw as (select upper_id, lower_id, row_no, list(cell order by col_no) as w from ss group by 1, 2, 3),
 hd as (select upper_id, lower_id, list_filter(w, z -> z <> '') as heads from rw where row_no = 0), bd as (select rw.upper_id, rw.lower_id, row_no, heads, list_filter(w, z -> z <> '') as cs from rw join hd on hd.upper_id = rw.upper_id and hd.lower_id = rw.lower_id where row_no > 0),
 se as (select upper_id, lower_id, row_no, case when least(len(heads), len(cs)) = 0 then null else 'IF ' || heads[1] || ' is ' || cs[1] || case when least(len(heads), len(cs)) > 1 then ', THEN ' || array_to_string(list_transform(range(2, least(len(heads), len(cs)) + 1), i -> heads[i] || ' is ' || cs[i]), ', ') || '.' else '' end end as s from bd)
 select upper_id, lower_id, string_agg(s, chr(10) order by row_no) as nll, count(*) as num_rows from se group by 1, 2""",
    "tables_of_chunks": f"with {t._R}, {x._C}, p as (select doc_id, page, string_agg(report_id, ',' order by report_id) as tables, count(*) as n_tables from r group by 1, 2) select chunk_id, tables, n_tables from c join p using (doc_id, page)",
    "tables_without_chunk": f"with {t._R}, {x._C} select report_id, doc_id, page, num_rows from r where num_rows > 1 and not exists (select 1 from c where c.doc_id = r.doc_id and c.page = r.page)",
    "review_flags": f"with {t._R}, {x._C}, f as (select doc_id, page, 'dosing_table' as kind from r where contains(lower(markdown), 'dose') or contains(lower(markdown), 'mg') or contains(lower(markdown), 'tablet') or contains(lower(markdown), 'administration') "
    "union all select distinct doc_id, page, 'contraindication' from c where contains(lower(coalesce(text, '')), 'contraindication') or contains(lower(coalesce(text, '')), 'not recommended')) select doc_id, page, kind, count(*) as n from f group by 1, 2, 3",
    "few_numbers": f"with {t._R} select report_id, len(regexp_extract_all(markdown, '\\d+\\.?\\d*')) as numbers from r where (contains(lower(markdown), 'dose') or contains(lower(markdown), 'mg')) and len(regexp_extract_all(markdown, '\\d+\\.?\\d*')) < 3",
    "conditions": f"with {x._C}, h as (select chunk_id, coalesce(title, '') as a, coalesce(heading, '') as b from c left join guideline_docs g on g.doc_id = c.doc_id) select chunk_id, coalesce({_label('b')}, {_label('a')}) as condition, coalesce({_type('a')}, {_type('b')}) as section_type from h",
    "short_names": "with w as (select doc_id, title, regexp_extract_all(title, '([A-Za-z]+)', 1) as ws from guideline_docs) select doc_id, case when len(ws) >= 3 then left(ws[1], 6) || '-' || left(ws[2], 6) || '-' || left(ws[3], 6) else replace(left(title, 30), ' ', '-') end as name from w",
}
SQL = {k: re.sub(r"\b([a-z]) -> ", r"lambda \1: ", v) for k, v in _SQL.items()}
