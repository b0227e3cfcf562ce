"""Queries over small literal tables, for rules whose cases the test tables don't hold, and their SQL.

The tables stand in `TABLES` once; both sides are built from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import is_iso_time
from leafmill.operators import chunks, compare, lines, reports, retrieval
from leafmill.sources import readers

_TABLE_A = "| Body weight (kg) | Dose (mg) |\n|---|---|\n| < 9 | 25 |\n| 9 to < 18 | 50 |"
_TABLE_B = "| 18 to < 30 | 100<br>mg |\n|---|---|\n| ≥ 30 | 200 |"
_TABLE_C = "| Body weight (kg) | Dose (mg) |\n|---|---|\n| 30 to < 60 | 300 |"

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "tables": (
        "id long, doc_id string, engine string, page int, num_cols int, markdown string, bbox array<double>",
        [
            (1, "d", "e", 3, 2, _TABLE_A, [50.0, 600.0, 500.0, 800.0]),
            (2, "d", "e", 4, 2, _TABLE_B, [50.0, 40.0, 500.0, 120.0]),
            (3, "d", "e", 4, 2, _TABLE_A, [50.0, 600.0, 500.0, 790.0]),
            (4, "d", "e", 5, 2, _TABLE_C, [50.0, 60.0, 500.0, 120.0]),
            (5, "d", "e", 5, 3, _TABLE_C, [50.0, 60.0, 500.0, 120.0]),
            (6, "d", "f", 6, 2, _TABLE_C, [50.0, 60.0, 500.0, 120.0]),
            (7, "d", "e", 6, 2, _TABLE_A, None),
            (8, "d", "e", 7, 2, _TABLE_A, [50.0, 85.0, 500.0, 700.0]),
        ],
    ),
    "spans": (
        readers.SPANS,
        [
            ("d", 1, 1, 0, 0, 70.0, "The ", "f", 10.0, 0), ("d", 1, 1, 0, 1, 70.0, "dose", "f", 10.0, 16), ("d", 1, 1, 0, 2, 70.0, " is given", "f", 10.0, 0),
            ("d", 1, 1, 1, 0, 70.0, "again.", "f", 10.0, 2), ("d", 1, 0, 0, 0, 50.0, "Dosing", "f", 18.0, 0), ("d", 1, 2, 0, 0, 90.0, "Children", "f", 15.0, 0),
            ("d", 1, 2, 1, 0, 90.0, "World", "f", 11.0, 0), ("d", 1, 2, 1, 1, 90.0, "Again", "f", 11.0, 0), ("d", 1, 3, 0, 0, 95.0, "   ", "f", 20.0, 16),
            ("d", 1, 4, 0, 0, 20.0, "before all", "f", 9.0, 0), ("d", 2, 0, 0, 0, 30.0, "x" * 100, "f", 20.0, 0), ("d", 2, 1, 0, 0, 40.0, "Bold heading", "f", 12.0, 16), ("d", 2, 1, 1, 0, 60.0, "Text", "f", 12.0, 0),
        ],
    ),
    "footed": ("doc_id string, line_no int, line string", [("d", k, x) for k, x in enumerate(["title", "1 of 3", "## 1 A", "text", "2 of 3", "more", "3 of 3", "end"])] + [("e", k, x) for k, x in enumerate(["no", "footer", "4 of"])]),
    "headed": ("doc_id string, n int, heading string", [("d", k, x) for k, x in enumerate(["1 Fever", "1.1 Children", "1.1.1 Doses", "Remark", "1.2 Adults", "2 Cough", "2.1.1 Deep", "2.1 Less deep", "Rationale and more", "3 Last"])]),
    "aged": (
        "id int, text string",
        [
            (1, "Children under 5 years; later children aged 12 months. Adults ≥ 18 years."), (2, "Infants < 6 months and 2 to 11 months"), (3, "6–59 months, then infants under 8 weeks"),
            (4, "patients aged 65 yrs, adults > 70 years"), (5, "nothing of that kind"), (6, None), (7, "CHILDREN BELOW 3 YEARS and 10 - 14 years"),
        ],
    ),
    "cited": ("doc_id string, response string", [("a", "See Page 3 and Page: 9. Also p. 12"), ("b", "Page 3"), ("c", "no page"), ("d", None), ("e", "p.7 and Page 7")]),
    "known_pages": ("page int", [(3,), (12,), (None,)]),
    "told": ("line_no int, line string", list(enumerate(["=====", "--- Table 7 (page 3) ---", "IF a", "", "--- Stitched S1 ---", "IF b", "IF c", "--- Table 7 (page 3) ---", "IF d", "====="]))),
    "times": ("value string", [("2025-03-01",), ("2025-03-01T10:11:12Z",), ("2025-03-01T10:11:12+00:00",), ("2025-02-30",), ("1 March 2025",), ("",), ("2025-03-01T25:00:00",), (None,)]),
    "found_tables": ("doc_id string, rank int, page int", [("a", 1, 3), ("a", 1, 4), ("a", 2, 9), ("b", 2, 1), ("c", 2, 1)]),
}


def literal(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _sql_value(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list):
        return "[" + ", ".join(map(_sql_value, v)) + "]"
    return str(v)


def _sql(name: str) -> str:
    """The table as a step of a SQL text."""
    schema, rows = TABLES[name]
    kinds = {"long": "bigint", "int": "int", "string": "varchar", "double": "double", "bigint": "bigint", "array<double>": "double[]"}
    fields = [f.split(" ") for f in schema.split(", ")]
    values = ", ".join("(" + ", ".join(_sql_value(v) for v in r) + ")" for r in rows)
    return f"{name} as (select " + ", ".join(f"{n}::{kinds[k]} as {n}" for n, k in fields) + f" from (values {values}) z({', '.join(n for n, _ in fields)}))"


def golden_breaks(spark, _folder):
    return compare.page_break_pairs(literal(spark, "tables"))


def golden_stitched(spark, _folder):
    return compare.stitched_rows(golden_breaks(spark, _folder), literal(spark, "tables").drop("bbox"), "id", "markdown")


def golden_sentences(spark, _folder):
    return reports.stitched_sentences(golden_stitched(spark, _folder))


def golden_lines(spark, _folder):
    return readers.text_lines(literal(spark, "spans"))


def golden_headings(spark, _folder):
    return readers.heading_spans(literal(spark, "spans")).select("doc_id", "page", "y_pos", "text", "level")


def golden_sections(spark, _folder):
    s = literal(spark, "spans")
    return readers.page_sections(readers.text_lines(s), readers.heading_spans(s))


def golden_pages(spark, _folder):
    return lines.with_pages(literal(spark, "footed"), "doc_id").select("doc_id", "line_no", "page")


def golden_hierarchy(spark, _folder):
    return lines.with_hierarchy(literal(spark, "headed"), "doc_id", "n").select("doc_id", "n", F.array_join("hierarchy", " > ").alias("path"), lines.clinical_domain(F.col("hierarchy")).alias("domain"))


def golden_ages(spark, _folder):
    return literal(spark, "aged").select("id", *chunks.age_limits(F.col("text")))


def golden_citations(spark, _folder):
    return retrieval.unknown_citations(literal(spark, "cited"), "doc_id", "response", literal(spark, "known_pages")).distinct()


def golden_records(spark, _folder):
    return readers.nll_records(literal(spark, "told"))


def golden_times(spark, _folder):
    return literal(spark, "times").select("value", is_iso_time(F.col("value")).alias("valid"))


def golden_fallback(spark, _folder):
    one = literal(spark, "found_tables")
    tables = [one.where(F.col("rank") == k).select("doc_id", "page") for k in (1, 2)]
    return readers.with_fallbacks(tables, ["first", "lattice"], [0.9, 0.95])


QUERIES = {
    f.__name__: f
    for f in (
        golden_breaks, golden_stitched, golden_sentences, golden_lines, golden_headings, golden_sections, golden_pages, golden_hierarchy, golden_ages,
        golden_citations, golden_records, golden_times, golden_fallback,
    )
}

# --- SQL -------------------------------------------------------------------------------------------

_TB = _sql("tables")
_BREAK_STEPS = f"""{_TB}, pb as (select u.doc_id, u.engine, u.page, u.num_cols, u.id as upper_id, d.id as lower_id from tables u join tables d on u.doc_id = d.doc_id and u.engine = d.engine and d.page = u.page + 1 and u.num_cols = d.num_cols
 where u.bbox[4] / 842.0 >= 0.90 and d.bbox[2] / 842.0 <= 0.10 and u.id <> d.id)"""
_CUT = "list_transform(string_split(line, '|'), lambda v: trim(regexp_replace(regexp_replace(v, '<br>|\\n', ' ', 'g'), '\\s+', ' ', 'g')))"
_STITCH_STEPS = f"""{_BREAK_STEPS}, ln as (select id, list_filter(string_split(markdown, chr(10)), lambda v: not contains(v, '---')) as ls from tables),
 rw as (select id, unnest(range(len(ls))) as row_no, unnest(ls) as line from ln), cw as (select id, row_no, {_CUT}[2:-2] as cells from rw),
 up as (select upper_id, lower_id, 0 as part, row_no, cells from pb join cw on id = upper_id), lo as (select pb.upper_id, pb.lower_id, 1 as part, cw.row_no, cw.cells, h.cells as head from pb join cw on cw.id = pb.lower_id join cw h on h.id = pb.upper_id and h.row_no = 0),
 al as (select * from up union all select upper_id, lower_id, part, row_no, cells from lo where not (row_no = 0 and cells = head)),
 nu as (select upper_id, lower_id, row_number() over (partition by upper_id, lower_id order by part, row_no) - 1 as row_no, cells from al)"""
_SP = _sql("spans")
_LINE_STEPS = f"{_SP}, tl as (select doc_id, page, block_no, line_no, min(y_pos) as y_pos, trim(string_agg(text, '' order by span_no)) as text, bool_or(flags & 16 <> 0) as is_bold, bool_or(flags & 2 <> 0) as is_italic from spans group by 1, 2, 3, 4)"
_HEAD_STEPS = "hs as (select doc_id, page, block_no, line_no, span_no, y_pos, trim(text) as text, case when size > 16 then 1 when size > 14 then 2 else 3 end as level from spans where length(trim(text)) between 1 and 99 and (size > 12 or flags & 16 <> 0))"
_NUMBER = "^(\\d+(?:\\.\\d+)*)\\s+(.*)"

SQL = {
    "golden_breaks": f"with {_BREAK_STEPS} select doc_id, engine, page, num_cols, upper_id, lower_id from pb",
    "golden_stitched": f"with {_STITCH_STEPS} select upper_id, lower_id, row_no, unnest(range(len(cells))) as col_no, unnest(cells) as cell from nu",
    "golden_sentences": f"with {_STITCH_STEPS}, h as (select upper_id, lower_id, cells as head from nu where row_no = 0), s as (select nu.upper_id, nu.lower_id, row_no, 'IF ' || head[1] || ' is ' || cells[1] || ', THEN ' || head[2] || ' is ' || cells[2] || '.' as s from nu join h on h.upper_id = nu.upper_id and h.lower_id = nu.lower_id where row_no > 0) "
    "select upper_id, lower_id, string_agg(s, chr(10) order by row_no) as nll, count(*) as num_rows from s group by 1, 2",
    "golden_lines": f"with {_LINE_STEPS} select * from tl where text <> ''",
    "golden_headings": f"with {_SP}, {_HEAD_STEPS} select doc_id, page, y_pos, text, level from hs",
    "golden_sections": f"with {_LINE_STEPS}, {_HEAD_STEPS}, b as (select doc_id, page, y_pos, 0 as kind, block_no, line_no, span_no, text, level from hs union all select doc_id, page, y_pos, 1, block_no, line_no, 0, text, null from tl where text <> ''), "
    "n as (select *, sum((kind = 0)::int) over w as section_no, row_number() over w as n from b window w as (partition by doc_id, page order by y_pos, kind, block_no, line_no, span_no)) "
    "select doc_id, page, section_no::bigint as section_no, max(case when kind = 0 then text end) as heading, max(level) as level, coalesce(string_agg(text, chr(10) || chr(10) order by n) filter (where kind = 1), '') as text from n group by 1, 2, 3",
    "golden_pages": f"with {_sql('footed')}, mk as (select *, try_cast(regexp_extract(line, '^(\\d+) of \\d+$', 1) as int) as m from footed) select doc_id, line_no, coalesce(last_value(m ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding), first_value(m ignore nulls) over (partition by doc_id order by line_no rows between current row and unbounded following)) as page from mk",
    "golden_hierarchy": f"""with {_sql('headed')}, h as (select *, case when regexp_matches(heading, '{_NUMBER}') then len(string_split(regexp_extract(heading, '{_NUMBER}', 1), '.')) end as depth from headed),
 o as (select a.doc_id, a.n, b.heading, b.depth, b.n as m from h a join h b on a.doc_id = b.doc_id and b.n <= a.n and b.depth is not null where not exists (select 1 from h z where z.doc_id = a.doc_id and z.n > b.n and z.n <= a.n and z.depth <= b.depth))
 select h.doc_id, h.n, coalesce(string_agg(o.heading, ' > ' order by m), '') as path, max_by(regexp_extract(o.heading, '{_NUMBER}', 2), m) as domain from h left join o on o.doc_id = h.doc_id and o.n = h.n group by 1, 2""",
    "golden_ages": f"with {_sql('aged')}, m as (select id, regexp_extract_all(text, '{chunks.AGES}', 1) as ms from aged), k as (select id, list_filter(ms, lambda v: regexp_matches(v, '(?i)^(?:adult|patient|\\d)'))[-1] as lo, list_filter(ms, lambda v: not regexp_matches(v, '(?i)^(?:adult|patient)'))[-1] as hi from m) "
    "select id, {lo} as age_min, {hi} as age_max from k".replace("{lo}", "case when regexp_matches(lo, '^\\d+\\D+\\d') then regexp_extract(lo, '^(\\d+)', 1) || ' ' || regexp_extract(lo, '([A-Za-z]+)$', 1) when lo is not null then regexp_extract(lo, '(\\d+)\\s*[A-Za-z]+$', 1) || ' ' || regexp_extract(lo, '([A-Za-z]+)$', 1) end").replace("{hi}", "case when hi is not null then regexp_extract(hi, '(\\d+)\\s*[A-Za-z]+$', 1) || ' ' || regexp_extract(hi, '([A-Za-z]+)$', 1) end"),
    "golden_citations": f"with {_sql('cited')}, {_sql('known_pages')}, ci as (select distinct doc_id, try_cast(unnest(regexp_extract_all(response, 'Page:?\\s*(\\d+)', 1) || regexp_extract_all(response, 'p\\.?\\s*(\\d+)', 1)) as int) as page from cited) select doc_id, page from ci where not exists (select 1 from known_pages k where k.page = ci.page)",
    "golden_records": f"with {_sql('told')}, a as (select *, regexp_matches(line, '^-+\\s*(?:Table|Stitched)\\s+(\\w+).*-*$') as head from told), b as (select *, sum(head::int) over (order by line_no) as rec from a), "
    "c as (select rec, max(case when head then regexp_extract(line, '^-+\\s*(?:Table|Stitched)\\s+(\\w+).*-*$', 1) end) as table_key, string_agg(line, chr(10) order by line_no) filter (where not head and not regexp_matches(line, '^[=\\s]*$')) as nll from b where rec > 0 group by 1) select table_key, max_by(nll, rec) as nll from c group by 1",
    "golden_times": f"with {_sql('times')} select value, coalesce(regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') and try_cast(value as timestamptz) is not null, false) as valid from times",
    "golden_fallback": f"with {_sql('found_tables')} select doc_id, page, case rank when 1 then 'first' else 'lattice' end as method, case rank when 1 then 0.9 else 0.95 end::double as confidence from found_tables f where rank = (select min(rank) from found_tables g where g.doc_id = f.doc_id)",
}
