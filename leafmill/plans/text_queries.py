"""Queries of the line, chunk, retrieval, quality and discovery operators, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.config import Config
from leafmill.operators import chunks, discover, lines, quality, retrieval
from leafmill.plans.table_queries import QUERIES as TABLE_QUERIES
from leafmill.plans.table_queries import readings
from leafmill.sources import readers
from leafmill.sources.tables import latest, table

#: Lists for this project's own tables.
SETTINGS = Config(
    care_levels=("health-centre level II", "health centre", "district hospital", "village health post", "dispensary", "referral unit"),
    high_preservation_terms=("mg/kg", "contraindicat", "do not combine", "not recommended", "first-line treatment", "never doubled"),
)
TOPICS = (
    ("marsh\\s+fever", "Marsh fever"),
    ("an(a)?emia", "Anaemia"),
    ("meningitis", "Meningitis"),
    ("malnutrition", "Malnutrition"),
    ("pregnan", "Maternal health"),
    ("neonatal|newborn", "Neonatal care"),
    ("kidney|renal", "Renal disease"),
    ("diabetes", "Diabetes"),
)
ASSESSMENT_WORDS = ("clinical", "symptom", "danger", "immediately", "suspected", "persists", "monitoring")
CRITICAL_TERMS = ["dose", "fever", "children", "pregnan", "kidney", "oxygen", "referral", "contraindications"]
DRUG_ENDINGS = ("feron", "quone", "pramide", "mycol", "cillan", "doxate", "vudil", "soline", "nate", "trine", "zoline")
LABEL = "^(Q|A|Page|Note):"


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", "text", "source", "kind", "lang", "guideline_id")


def chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks, each in its latest delivery."""
    return latest(table(spark, folder, "chunk"), "chunk_id", ["chunk_id", "doc_id", "page", "heading", "level", "text", "has_tables", "is_table_only"])


def image_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Images, each in its latest delivery."""
    return latest(table(spark, folder, "images"), "image_id", ["image_id", "doc_id", "image_index", "page_no", "caption", "ocr_text", "width", "height", "error"])


def doc_lines(spark, folder):
    return lines.document_lines(docs(spark, folder), "doc_id", "text")


def sections(spark, folder):
    return lines.section_table(doc_lines(spark, folder), "doc_id")


def page_asof(spark, folder):
    """Each line with the page of the last footer up to it."""
    return lines.with_pages(doc_lines(spark, folder), "doc_id").select("doc_id", "line_no", "page")


def elements(spark, folder):
    """Elements of the sections with their lines counted."""
    s = lines.with_sections(doc_lines(spark, folder), "doc_id")
    e = lines.with_elements(s, "doc_id")
    return e.groupBy("doc_id", "section_no", "element_no", "kind").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"))


def hierarchy(spark, folder):
    """Headings of each guideline as a stack by their level."""
    c = chunk_rows(spark, folder).where("heading is not null and level is not null")
    return lines.with_hierarchy(c, "doc_id", ["page", "chunk_id"], depth=F.col("level")).select("chunk_id", F.array_join("hierarchy", " > ").alias("path"), lines.clinical_domain(F.col("hierarchy")).alias("domain"))


def pack_paragraphs(spark, folder):
    return docs(spark, folder).select("doc_id", F.posexplode(lines.packed(F.col("text"), 100, 20)).alias("piece_no", "piece"))


def chunk_records(spark, folder):
    c = chunks.chunk_records(chunk_rows(spark, folder), "doc_id", "heading", "level", "text", ["page", "chunk_id"])
    return c.select("chunk_id", "chunk_no", "content", "n_chars", "n_words", "n_tokens")


def clinical_metadata(spark, folder):
    return docs(spark, folder).select("doc_id", *chunks.clinical_metadata(F.col("text")))


def care_levels(spark, folder):
    return docs(spark, folder).select("doc_id", F.array_join(chunks.care_levels(F.col("text"), SETTINGS), ", ").alias("levels")).where("levels <> ''")


def _typed(spark, folder):
    c = chunk_rows(spark, folder)
    kind = F.when(F.coalesce("is_table_only", F.lit(False)), "other_table").when(F.coalesce("has_tables", F.lit(False)), "dosing_table").otherwise("narrative")
    return c.withColumn("kind", kind)


def safety_level(spark, folder):
    c = _typed(spark, folder)
    return c.select("chunk_id", "kind", chunks.preservation(F.col("kind"), F.lit(None).cast("string"), F.col("text"), SETTINGS).alias("level"))


def links(spark, folder):
    out = chunks.linked(_typed(spark, folder), "doc_id", ["page", "chunk_id"], "chunk_id", F.col("kind") == "narrative")
    return out.select("chunk_id", "previous", "next", "narrative_before", "narrative_after")


def link_dependents(spark, folder):
    out = chunks.linked(_typed(spark, folder), "doc_id", ["page", "chunk_id"], "chunk_id", F.col("kind") == "narrative")
    return chunks.dependents(out, "chunk_id")


def section_siblings(spark, folder):
    """Number of chunks under the same heading of a guideline, instead of the pairs."""
    c = chunk_rows(spark, folder).where("heading is not null")
    n = c.groupBy("doc_id", "heading").agg(F.count(F.lit(1)).alias("in_section"))
    return c.join(n, ["doc_id", "heading"]).select("chunk_id", (F.col("in_section") - 1).alias("siblings"))


def chunk_problems(spark, folder):
    c = table(spark, folder, "chunk").select("chunk_id", "text").withColumn("ref", F.regexp_replace("chunk_id", "c0000001$", "c9999999"))
    return chunks.chunk_problems(c, "chunk_id", "ref", F.coalesce(chunks.token_estimate(F.col("text")), F.lit(0)), 300)


def chunk_kind_counts(spark, folder):
    return _typed(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNull()).alias("without_text"))


def image_match(spark, folder):
    """The k-th image of a page with the k-th chunk of the page."""
    i = image_rows(spark, folder).select("doc_id", F.col("page_no").alias("page"), "image_id")
    c = chunk_rows(spark, folder).select("doc_id", "page", "chunk_id")
    return chunks.positional_match(i, c, ["doc_id", "page"], ["image_id"], ["chunk_id"], "image_id", "chunk_id")


def table_match(spark, folder):
    """Chunks with tables against the readings of one engine, greedily by page."""
    w = F.row_number().over(lines.Window.partitionBy("doc_id").orderBy("page", "chunk_id"))
    e = chunk_rows(spark, folder).where("has_tables").withColumn("element_no", w.cast("bigint")).select("doc_id", "element_no", "page")
    i = readings(spark, folder).where("engine = 'docling'").select("doc_id", "page", F.col("report_id").alias("table_index"))
    return chunks.greedy_match(e, i)


def question_rows(spark, folder):
    """Questions asked in the documents, each text once."""
    q = docs(spark, folder).select(F.explode(F.regexp_extract_all("text", F.lit("(?m)^Q: ([^\\n]+)$"), F.lit(1))).alias("question"))
    return q.groupBy("question").agg(F.count(F.lit(1)).alias("asked")).withColumn("query_id", F.sha2("question", 256))


def bm25_scores(spark, folder):
    out = retrieval.bm25(question_rows(spark, folder), "query_id", "question", chunk_rows(spark, folder).where("text is not null"), "chunk_id", "text")
    return retrieval.top_hits(out, "query_id", "chunk_id", 5).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def answers(spark, folder):
    c = chunk_rows(spark, folder).select("chunk_id", "heading", "text", "page")
    hits = bm25_scores(spark, folder).join(c, "chunk_id").join(question_rows(spark, folder).select("query_id", "question"), "query_id")
    return retrieval.answers(hits, "query_id", "question")


def guardrail(spark, folder):
    a = answers(spark, folder)
    return a.select("query_id", *retrieval.response_checks(a, "question", "response"))


def unknown_citations(spark, folder):
    """Pages cited in the documents that no chunk has."""
    r = docs(spark, folder).select("doc_id", "text")
    return retrieval.unknown_citations(r, "doc_id", "text", chunk_rows(spark, folder).select("page")).distinct()


def ground_truth(spark, folder):
    """Are the words of each chunk's heading in the documents of its guideline?"""
    items = chunk_rows(spark, folder).where("heading is not null").select("chunk_id", "doc_id", F.split(F.lower("heading"), " ").alias("words"))
    spaces = docs(spark, folder).where("guideline_id is not null").select(F.col("guideline_id").alias("doc_id"), F.col("text").alias("space"))
    return quality.ground_truth(items, spaces, ["doc_id"], "chunk_id")


def ground_truth_page(spark, folder):
    """Are the caption's words of each image in the text of its page?"""
    items = image_rows(spark, folder).where("caption is not null").select("image_id", "doc_id", F.col("page_no").alias("page"), F.split(F.lower("caption"), " ").alias("words"))
    spaces = chunk_rows(spark, folder).where("text is not null").select("doc_id", "page", F.col("text").alias("space"))
    return quality.ground_truth(items, spaces, ["doc_id", "page"], "image_id")


def accuracy(spark, folder):
    return quality.accuracy(ground_truth(spark, folder))


def image_quality(spark, folder):
    i = image_rows(spark, folder)
    issues = quality.image_issues(F.col("ocr_text"), F.col("width"), F.col("height"), F.col("caption"))
    return i.select("image_id", F.array_join(issues, ", ").alias("issues"), (F.size(issues) == 0).alias("passed"))


def image_inventory(spark, folder):
    out = quality.image_inventory(image_rows(spark, folder), "doc_id", ["page_no", "image_id"])
    return out.select("image_id", "number", "width", "height")


def document_profile(spark, folder):
    """Profiles over every page that has a chunk, a table or an image."""
    none = F.lit(0)
    t = readings(spark, folder).select("doc_id", "page", none.alias("length"), F.lit(1).alias("table"), none.alias("image"))
    i = image_rows(spark, folder).select("doc_id", F.col("page_no").alias("page"), none.alias("length"), none.alias("table"), F.lit(1).alias("image"))
    c = chunk_rows(spark, folder).select("doc_id", "page", F.coalesce(F.length("text"), none).alias("length"), none.alias("table"), none.alias("image"))
    pages = c.unionByName(t).unionByName(i).groupBy("doc_id", "page").agg(F.sum("length").alias("text_length"), F.sum("table").alias("n_tables"), F.sum("image").alias("n_images"))
    return quality.document_profile(pages)


def page_similarity(spark, folder):
    """Similarity of the first two engines' whole texts of a table page."""

    def page_texts(engine, out):
        parts = F.array_sort(F.collect_list(F.struct("table_index_on_page", "report_id", "markdown")))
        return readings(spark, folder).where(F.col("engine") == engine).groupBy("doc_id", "page").agg(F.array_join(F.transform(parts, lambda x: x["markdown"]), "\n").alias(out))

    pairs = page_texts("docling", "x").join(page_texts("pymupdf", "y"), ["doc_id", "page"]).select(F.concat_ws("/", "doc_id", "page").alias("page_key"), "x", "y")
    return quality.text_similarity(pairs, "page_key", "x", "y")


def structure_check(spark, folder):
    return quality.structure_check(chunk_rows(spark, folder), "doc_id", ["page", "chunk_id"])


def table_check(spark, folder):
    return quality.table_check(readings(spark, folder), "doc_id")


def term_check(spark, folder):
    return quality.term_check(chunk_rows(spark, folder), "doc_id", "text", CRITICAL_TERMS)


def validators(spark, folder):
    """Mean confidence of structure, tables and terms per guideline."""
    stages = structure_check(spark, folder).select("doc_id", "confidence").unionByName(table_check(spark, folder).select("doc_id", "confidence")).unionByName(term_check(spark, folder).select("doc_id", "confidence"))
    return quality.overall(stages, "doc_id")


def drug_discovery(spark, folder):
    return discover.drug_names(docs(spark, folder), "text", DRUG_ENDINGS)


def topics(spark, folder):
    return discover.topics(docs(spark, folder), "doc_id", "text", TOPICS)


def section_words(spark, folder):
    return discover.section_words(docs(spark, folder), "text")


def assessment_pages(spark, folder):
    return discover.assessment_pages(chunk_rows(spark, folder).where("page is not null"), "doc_id", "page", "text", ASSESSMENT_WORDS)


def proposed_truth(spark, folder):
    return discover.proposed_truth(chunk_rows(spark, folder).where("text is not null and page is not null"), "doc_id", "page", "text", ("dose", "give", "treatment"))


def json_fields(spark, folder):
    e = table(spark, folder, "events")
    return e.groupBy(F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def set_operations(spark, folder):
    """Users by event type: in both, only in one, in either."""
    e = table(spark, folder, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    a, b = (e.where(F.col("event_type") == k).select("user_id").distinct() for k in kinds)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.exceptAll(b), "first")).unionByName(n(b.exceptAll(a), "second")).unionByName(n(a.union(b).distinct(), "either"))


def page_ranges(spark, folder):
    """The pages of two ranges of each guideline, its first and its last third, as a map (new page, original page)."""
    g = table(spark, folder, "guideline_docs").where("page_count >= 3")
    third = F.floor(F.col("page_count") / 3).cast("int")
    first = g.select("doc_id", F.lit(1).alias("first"), third.alias("last"))
    last = g.select("doc_id", (F.col("page_count") - third + 1).alias("first"), F.col("page_count").alias("last"))
    return readers.page_ranges(first.unionByName(last))


QUERIES = {
    f.__name__: f
    for f in (
        doc_lines, sections, page_asof, elements, hierarchy, pack_paragraphs, chunk_records, clinical_metadata, care_levels, safety_level, links,
        link_dependents, section_siblings, chunk_problems, chunk_kind_counts, image_match, table_match, bm25_scores, answers, guardrail,
        unknown_citations, ground_truth, ground_truth_page, accuracy, image_quality, image_inventory, document_profile, page_similarity,
        structure_check, table_check, term_check, validators, drug_discovery, topics, section_words, assessment_pages, proposed_truth,
        json_fields, set_operations, page_ranges,
    )
}
assert not set(QUERIES) & set(TABLE_QUERIES)

# --- SQL -------------------------------------------------------------------------------------

_C = "c as (select chunk_id, doc_id, page, heading, level, text, has_tables, is_table_only from chunk qualify row_number() over (partition by chunk_id order by loaded_at desc nulls last) = 1)"
_D = "d as (select doc_id, text, guideline_id from documents where text is not null)"
_L = "ln as (select doc_id, unnest(range(len(ls))) as line_no, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from d))"
_SEC = "sc as (select *, starts_with(line, '## ') as is_heading, (sum(starts_with(line, '## ')::int) over (partition by doc_id order by line_no))::bigint as section_no from ln)"
_I = "i as (select image_id, doc_id, image_index, page_no, caption, ocr_text, width, height, error from images qualify row_number() over (partition by image_id order by loaded_at desc nulls last) = 1)"
_R = "r as (select report_id, doc_id, engine, page, num_cols, markdown from cross_validation_report where error is null and markdown is not null qualify row_number() over (partition by report_id order by loaded_at desc nulls last) = 1)"
_WORDS = "len(list_filter(regexp_split_to_array({x}, '\\s+'), w -> w <> ''))"
_TOKENS = "floor(" + _WORDS + " * 1.3::double)::int"
_TYPED = "ty as (select *, case when coalesce(is_table_only, false) then 'other_table' when coalesce(has_tables, false) then 'dosing_table' else 'narrative' end as kind from c)"
_Q = "q as (select question, count(*) as asked, sha256(question) as query_id from (select unnest(regexp_extract_all(text, '(?m)^Q: ([^\\n]+)$', 1)) as question from d) group by 1)"
_TERMS = "list_filter(regexp_extract_all(lower({x}), '([a-z0-9]+)', 1), t -> length(t) > 1)"
_BM = f"""{_C}, {_D}, {_Q},
ct as (select chunk_id, {_TERMS.format(x='text')} as ts from c where text is not null), st as (select count(*)::double as n, avg(len(ts)) as al from ct),
po as (select chunk_id, term, len, count(*) as tf from (select chunk_id, len(ts) as len, unnest(ts) as term from ct) group by all),
ra as (select term, ln(n - df + 0.5) - ln(df + 0.5) as raw from (select term, count(*) as df from po group by 1), st), fl as (select 0.25 * avg(raw) as f from ra),
idf as (select term, case when raw < 0 then f else raw end as idf from ra, fl),
qt as (select query_id, term, count(*) as times from (select query_id, unnest({_TERMS.format(x='question')}) as term from q) group by all),
bs as (select query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))) as score from qt join po using (term) join idf using (term), st group by all),
top as (select query_id, chunk_id, score, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id desc) as rank from bs qualify rank <= 5)"""


def _spans(kind: str) -> str:
    found = " || ".join(f"regexp_extract_all(text, '{p}', 1)" for p in chunks.SPAN_PATTERNS[kind])
    return f"array_to_string(list_sort(list_distinct(list_transform({found}, x -> left(trim(x), {chunks.SPAN_CUT[kind]})))), ' # ')"


def _last(p: str, g: int) -> str:
    return f"list_extract(regexp_extract_all(text, '{p}', {g}), -1)"


def _hits(words) -> str:
    return "(" + " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::int" for w in words) + ")"


_W_ALL = "regexp_extract_all(text, '(?i)((?:weighing|weight)\\s*(?:<|>|≤|≥|less than|more than|under|over)?\\s*\\d+(?:\\.\\d+)?\\s*kg)', 1)"
_KG = "try_cast(regexp_extract(list_extract({a}, -1), '(\\d+(?:\\.\\d+)?)\\s*kg', 1) as double)"
_LESS = "(contains(lower(w), 'less') or contains(w, '<'))"
_CARE = "|".join(sorted((re.escape(t).replace("\\ ", " ").replace("\\-", "-") for t in SETTINGS.care_levels), key=lambda t: (-len(t), t)))
_HIGH = "|".join(re.escape(t).replace("\\ ", " ").replace("\\-", "-") for t in SETTINGS.high_preservation_terms)
_STRUCT = f"with {_C}, jp as (select doc_id, (lead(level) over (partition by doc_id order by page, chunk_id) > level + 1)::int as jump from c where level is not null), s1 as (select doc_id, coalesce(sum(jump), 0)::bigint as skipped_levels, case when coalesce(sum(jump), 0) = 0 then 0.9 else 0.7 end::double as confidence from jp group by 1)"
_TAB = f"{_R}, s2a as (select doc_id, count(*) as tables, count(*) filter (where num_cols >= 2) as valid from r group by 1), s2 as (select *, round(valid::double / tables, 6) as confidence, round(valid::double / tables, 6) >= 0.8 as passed from s2a)"
_TERM = "s3a as (select doc_id, " + " + ".join(f"(not bool_or(contains(lower(coalesce(text, '')), '{t}')))::int" for t in CRITICAL_TERMS) + f" as missing from c group by 1), s3 as (select doc_id, missing, round(1.0 - missing::double / {len(CRITICAL_TERMS)}, 6) as confidence from s3a)"

_SQL = {
    "doc_lines": f"with {_D}, {_L} select doc_id, line_no, line from ln",
    "sections": f"with {_D}, {_L}, {_SEC}, g as (select doc_id, section_no, max(case when is_heading then regexp_replace(substr(line, 4), '^\\s+|\\s+$', '', 'g') end) as heading, min(line_no) as first_line, count(*) as n_lines from sc group by 1, 2) "
    "select *, case when regexp_matches(heading, '^(\\d+(?:\\.\\d+)*)\\s+(.*)') then regexp_extract(heading, '^(\\d+(?:\\.\\d+)*)\\s+(.*)', 1) end as number, case when regexp_matches(heading, '^(\\d+(?:\\.\\d+)*)\\s+(.*)') then regexp_extract(heading, '^(\\d+(?:\\.\\d+)*)\\s+(.*)', 2) else heading end as title from g",
    "page_asof": f"with {_D}, {_L}, mk as (select doc_id, line_no, case when regexp_matches(line, '^\\d+ of \\d+$') then try_cast(regexp_extract(line, '^(\\d+) of \\d+$', 1) as int) end as m from ln) "
    "select doc_id, line_no, coalesce(last_value(m ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding), first_value(m ignore nulls) over (partition by doc_id order by line_no rows between current row and unbounded following)) as page from mk",
    "elements": f"with {_D}, {_L}, {_SEC}, b as (select *, case when starts_with(ltrim(line), '|') then 'table' when regexp_replace(line, '^\\s+|\\s+$', '', 'g') = '<!-- image -->' then 'image' else 'narrative' end as kind from sc where not is_heading and not regexp_matches(line, '^\\d+ of \\d+$')), "
    "s as (select *, case when lag(kind) over w is null or lag(kind) over w <> kind or kind = 'image' then 1 else 0 end as st from b window w as (partition by doc_id, section_no order by line_no)), "
    "e as (select *, (sum(st) over (partition by doc_id, section_no order by line_no))::bigint as element_no from s) select doc_id, section_no, element_no, kind, min(line_no) as first_line, count(*) as n_lines from e group by 1, 2, 3, 4",
    "hierarchy": f"""with {_C}, h as (select chunk_id, doc_id, level, heading as h, row_number() over (partition by doc_id order by page nulls first, chunk_id) as n from c where heading is not null and level is not null),
 o as (select a.chunk_id, b.h, b.level, b.n, min(b2.level) as later from h a join h b on a.doc_id = b.doc_id and b.n <= a.n left join h b2 on b2.doc_id = a.doc_id and b2.n > b.n and b2.n <= a.n group by all)
 select chunk_id, string_agg(h, ' > ' order by n) as path, max_by(case when regexp_matches(h, '^(\\d+(?:\\.\\d+)*)\\s+(.*)') then regexp_extract(h, '^(\\d+(?:\\.\\d+)*)\\s+(.*)', 2) else h end, n) filter (where not regexp_matches(regexp_replace(h, '^\\d+(?:\\.\\d+)*\\s+', ''), '{lines.STRUCTURAL_HEADINGS.replace("'", "''")}')) as domain from o where later is null or later > level group by 1""",
    "chunk_records": f"with {_C}, k as (select chunk_id, row_number() over (partition by doc_id order by page nulls first, chunk_id) as chunk_no, case when heading is null then text else repeat('#', coalesce(level, 1)) || ' ' || heading || chr(10) || chr(10) || coalesce(text, '') end as content from c) "
    f"select chunk_id, chunk_no, content, length(content) as n_chars, {_WORDS.format(x='content')} as n_words, floor({_WORDS.format(x='content')} * 1.3::double)::int as n_tokens from k",
    "clinical_metadata": f"with {_D} select doc_id, coalesce({_last(chunks.AGE_UNDER, 1)} || ' ' || {_last(chunks.AGE_UNDER, 2)}, '') as age_under, {_last(chunks.AGE_RANGE, 1)} as age_from, {_last(chunks.AGE_RANGE, 2)} as age_to, "
    + _KG.format(a=f"list_filter({_W_ALL}, w -> {_LESS})")
    + " as weight_max, "
    + _KG.format(a=f"list_filter({_W_ALL}, w -> not {_LESS})")
    + f" as weight_min, nullif(regexp_extract(text, '{chunks.FREQUENCY}', 1), '') as frequency, nullif(regexp_extract(text, '{chunks.DURATION}', 1), '') as duration, "
    + ", ".join(f"{_spans(k)} as {k}" for k in chunks.SPAN_PATTERNS)
    + " from d",
    "care_levels": f"with {_D}, l as (select doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)({_CARE})', 1), x -> replace(replace(replace(upper(x), 'HC IV', 'HC4'), 'HC III', 'HC3'), 'HC II', 'HC2')))), ', ') as levels from d) select * from l where levels <> ''",
    "safety_level": f"with {_C}, {_TYPED} select chunk_id, kind, case when kind = 'dosing_table' then 'verbatim' when kind = 'narrative' and ({' or '.join(f"contains(lower(coalesce(text, '')), '{p}')" for p in chunks.DANGER_PHRASES)}) then 'verbatim' "
    f"when kind = 'narrative' and coalesce(regexp_matches(text, '(?i)({_HIGH})'), false) then 'high' else 'standard' end as level from ty",
    "links": f"with {_C}, {_TYPED}, t as (select *, case when kind = 'narrative' then chunk_id end as nid from ty) select chunk_id, lag(chunk_id) over w as previous, lead(chunk_id) over w as next, "
    "case when kind <> 'narrative' then last_value(nid ignore nulls) over (partition by doc_id order by page nulls first, chunk_id rows between unbounded preceding and 1 preceding) end as narrative_before, "
    "case when kind <> 'narrative' then first_value(nid ignore nulls) over (partition by doc_id order by page nulls first, chunk_id rows between 1 following and unbounded following) end as narrative_after from t window w as (partition by doc_id order by page nulls first, chunk_id)",
    "link_dependents": f"with {_C}, {_TYPED}, t as (select *, case when kind = 'narrative' then chunk_id end as nid from ty), n as (select chunk_id, kind, last_value(nid ignore nulls) over (partition by doc_id order by page nulls first, chunk_id rows between unbounded preceding and 1 preceding) as nb from t) "
    "select nb as chunk, string_agg(chunk_id, ',' order by chunk_id) as context_for from n where kind <> 'narrative' and nb is not null group by 1",
    "section_siblings": f"with {_C} select chunk_id, count(*) over (partition by doc_id, heading) - 1 as siblings from c where heading is not null",
    "chunk_problems": "with t as (select chunk_id, text, regexp_replace(chunk_id, 'c0000001$', 'c9999999') as ref from chunk) select 'duplicate_id' as problem, count(*) as n from (select chunk_id from t group by 1 having count(*) > 1) "
    f"union all select 'lost_reference', count(*) from t where ref not in (select chunk_id from t) union all select 'too_long', count(*) from t where floor({_WORDS.format(x="coalesce(text, '')")} * 1.3::double) > 300",
    "chunk_kind_counts": f"with {_C}, {_TYPED} select kind, count(*) as n, count(*) filter (where text is null) as without_text from ty group by 1",
    "image_match": f"with {_C}, {_I}, a as (select doc_id, page_no as page, image_id, row_number() over (partition by doc_id, page_no order by image_id) as place from i), b as (select doc_id, page, chunk_id, row_number() over (partition by doc_id, page order by chunk_id) as place from c) select a.doc_id, a.page, a.place, image_id, chunk_id from a left join b on a.doc_id = b.doc_id and a.page = b.page and a.place = b.place",
    "bm25_scores": f"with {_BM} select query_id, chunk_id, rank, round(score, 6) as score from top",
    "answers": f"""with {_BM}, hit as (select top.query_id, question, rank, page, '### ' || coalesce(heading, '') || chr(10) || left(coalesce(text, ''), 500) || '...' || chr(10) || 'Reference: Page ' || coalesce(page::varchar, '?') as x from top join c using (chunk_id) join q using (query_id)),
 one as (select query_id, question, string_agg(x, chr(10) || chr(10) order by rank) as body, list_sort(list_distinct(list(page))) as pages from hit group by 1, 2)
 select query_id, question, array_to_string(pages, ',') as pages, body || chr(10) || '---' || chr(10) || 'Triage Level: ' || case when {' or '.join(f"contains(lower(question), '{p}')" for p in retrieval.URGENT_PHRASES)} then 'RED' else 'GREEN' end
 || chr(10) || 'Immediate Actions: review the excerpts above.' || chr(10) || 'Next Steps / Monitoring: consult the full source.' || chr(10) || 'When to Refer: per excerpts.' || chr(10) || 'Citations: ' || array_to_string(list_transform(pages, p -> 'Page ' || p), ', ') as response from one""",
    "guardrail": f"with an as (with {{ANSWERS}}), g as (select query_id, {' + '.join(f"(not contains(response, '{z}'))::int" for z in retrieval.REQUIRED_SECTIONS)} as missing_sections, case when regexp_matches(response, '{retrieval.TRIAGE}') then regexp_extract(response, '{retrieval.TRIAGE}', 1) end as triage, "
    f"({' or '.join(f"contains(lower(question), '{p}')" for p in retrieval.URGENT_PHRASES)}) as urgent, {' + '.join(f"regexp_matches(lower(response), '{p}')::int" for p in retrieval.FORBIDDEN_ADVICE)} as forbidden from an) "
    "select query_id, missing_sections, triage, coalesce(urgent and triage is not null and not contains(triage, 'RED'), false) as urgent_missed, forbidden, missing_sections = 0 and not coalesce(urgent and triage is not null and not contains(triage, 'RED'), false) and forbidden = 0 as passed from g",
    "pack_paragraphs": f"""with recursive dd as (select doc_id, text, {_TOKENS.format(x='text')} as whole from documents where text is not null),
 pp as (select doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), z -> regexp_replace(z, '^\\s+|\\s+$', '', 'g')), z -> z <> '') as ps from dd where whole > 100),
 st as (select doc_id, ps, 0 as i, []::varchar[] as done, []::varchar[] as now, 0 as tok from pp
  union all select doc_id, ps, i + 1, case when tok + {_TOKENS.format(x='ps[i + 1]')} > 100 and len(now) > 0 then list_append(done, array_to_string(now, chr(10) || chr(10))) else done end,
  case when tok + {_TOKENS.format(x='ps[i + 1]')} > 100 and len(now) > 0 then [ps[i + 1]] else list_append(now, ps[i + 1]) end,
  case when tok + {_TOKENS.format(x='ps[i + 1]')} > 100 and len(now) > 0 then {_TOKENS.format(x='ps[i + 1]')} else tok + {_TOKENS.format(x='ps[i + 1]')} end from st where i < len(ps)),
 fi as (select doc_id, case when len(done) > 0 and tok < 20 then list_append(done[1:len(done) - 1], done[len(done)] || chr(10) || chr(10) || array_to_string(now, chr(10) || chr(10))) else list_append(done, array_to_string(now, chr(10) || chr(10))) end as pieces from st where i = len(ps)),
 al as (select doc_id, [text] as pieces from dd where whole <= 100 union all select doc_id, pieces from fi) select doc_id, unnest(range(len(pieces))) as piece_no, unnest(pieces) as piece from al""",
    "unknown_citations": f"with {_C}, {_D}, ci as (select distinct doc_id, try_cast(unnest(regexp_extract_all(text, 'Page:?\\s*(\\d+)', 1) || regexp_extract_all(text, 'p\\.?\\s*(\\d+)', 1)) as int) as page from d) select doc_id, page from ci where not exists (select 1 from c where c.page = ci.page)",
    "ground_truth": f"with {_C}, {_D}, sp as (select guideline_id as doc_id, lower(string_agg(text, chr(10) order by doc_id)) as space from d where guideline_id is not null group by 1), it as (select chunk_id, doc_id, string_split(lower(heading), ' ') as words from c where heading is not null), "
    "h as (select chunk_id, len(words) as n, len(list_filter(words, w -> contains(coalesce(space, ''), w))) as found from it left join sp using (doc_id)) select chunk_id, found, n - found as missing, found = n as passed from h",
    "ground_truth_page": f"with {_C}, {_I}, sp as (select doc_id, page, lower(string_agg(text, chr(10) order by chunk_id)) as space from c where text is not null group by 1, 2), it as (select image_id, doc_id, page_no as page, string_split(lower(caption), ' ') as words from i where caption is not null), "
    "h as (select image_id, len(words) as n, len(list_filter(words, w -> contains(coalesce(space, ''), w))) as found from it left join sp using (doc_id, page)) select image_id, found, n - found as missing, found = n as passed from h",
    "accuracy": f"with {_C}, {_D}, sp as (select guideline_id as doc_id, lower(string_agg(text, chr(10) order by doc_id)) as space from d where guideline_id is not null group by 1), it as (select chunk_id, doc_id, string_split(lower(heading), ' ') as words from c where heading is not null), "
    "h as (select len(list_filter(words, w -> contains(coalesce(space, ''), w))) = len(words) as passed from it left join sp using (doc_id)) select count(*) as items, count(*) filter (where passed) as passed, round(100.0::double * count(*) filter (where passed) / count(*), 1) as accuracy from h",
    "image_quality": f"with {_I}, q as (select image_id, list_filter([case when length(regexp_replace(coalesce(ocr_text, ''), '^\\s+|\\s+$', '', 'g')) < 5 then 'no text' end, case when coalesce(width, 0) < 50 or coalesce(height, 0) < 50 then 'very small' end, case when coalesce(caption, '') = '' then 'no caption' end], z -> z is not null) as iss from i) select image_id, array_to_string(iss, ', ') as issues, len(iss) = 0 as passed from q",
    "image_inventory": f"with {_I}, n as (select *, row_number() over (partition by doc_id order by page_no nulls first, image_id) as number from i) select image_id, number, width, height from n where width >= 50 and height >= 50",
    "document_profile": f"with {_C}, {_R}, {_I}, u as (select doc_id, page, length(coalesce(text, '')) as len, 0 as nt, 0 as ni from c union all select doc_id, page, 0, 1, 0 from r union all select doc_id, page_no, 0, 0, 1 from i), "
    "z as (select doc_id, page, sum(len) as len, sum(nt) as nt, sum(ni) as ni from u group by 1, 2) select doc_id, count(*) as pages_seen, count(*) filter (where nt > 0) as table_pages, count(*) filter (where ni > 0) as image_pages, bool_or(len < 100 and ni > 0) as likely_scanned from z where page <= 20 group by 1",
    "structure_check": _STRUCT + " select * from s1",
    "table_check": f"with {_TAB} select * from s2",
    "term_check": f"with {_C}, {_TERM} select * from s3",
    "validators": f"{_STRUCT}, {_TAB}, {_TERM}, al as (select doc_id, confidence from s1 union all select doc_id, confidence from s2 union all select doc_id, confidence from s3) select doc_id, round(avg(confidence), 6) as confidence, round(avg(confidence), 6) >= 0.8 as passed from al group by 1",
    "drug_discovery": f"with {_D}, w as (select word, count(*) as times, ({' or '.join(f"(ends_with(word, '{e}') and length(word) > {len(e) + 2})" for e in DRUG_ENDINGS)}) as ending from (select unnest(regexp_extract_all(lower(text), '\\b([a-z]{{4,20}})\\b', 1)) as word from d) group by 1), "
    "m as (select distinct unnest(regexp_extract_all(lower(text), '(\\b[a-z]{4,20}\\b)\\s+\\d+\\s*(?:mg|mcg|iu)\\b', 1)) as word from d) select w.word, times, case when ending and times >= 2 then 'ending' else 'dose' end as by "
    f"from w left join m on m.word = w.word where ((ending and times >= 2) or m.word is not null) and w.word not in ({', '.join(repr(x) for x in discover.NOT_DRUGS)})",
    "topics": f"with {_D} " + " union ".join(f"select doc_id, '{label}' as topic from d where regexp_matches(text, '(?i){p}')" for p, label in TOPICS),
    "section_words": f"with {_D} select * from (" + " union all ".join(f"select '{t}' as section_type, '{w}' as word, count(*) as n from d where contains(lower(text), '{w}')" for t, ws in discover.SECTION_TYPES.items() for w in ws) + ") where n > 0",
    "assessment_pages": f"with {_C}, s as (select doc_id, page, max({_hits(ASSESSMENT_WORDS)}) as score from c where page is not null group by 1, 2), n as (select *, row_number() over (partition by doc_id order by page) as k from s where score >= 2) select doc_id, page, score from n where k <= 50",
    "proposed_truth": f"with {_C}, s as (select doc_id, page, list_filter(list_transform(regexp_split_to_array(text, '[.;\\n]'), x -> trim(x)), x -> length(x) between 10 and 120 and (contains(lower(x), 'dose') or contains(lower(x), 'give') or contains(lower(x), 'treatment')))[1] as s from c where text is not null and page is not null), "
    "o as (select doc_id, page, min(s) as s from s where s is not null group by 1, 2), n as (select *, row_number() over (partition by doc_id order by page) as k from o) select doc_id, page, array_to_string(list_filter(string_split(s, ' '), w -> length(w) > 3)[1:3], ' ') as words from n where k <= 20",
    "json_fields": "select try_cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1",
    "set_operations": "with k as (select distinct event_type from events order by 1 limit 2), a as (select distinct user_id from events where event_type = (select min(event_type) from k)), b as (select distinct user_id from events where event_type = (select max(event_type) from k)) "
    "select 'both' as part, count(*) as n from (select * from a intersect select * from b) union all select 'first', count(*) from (select * from a except select * from b) union all select 'second', count(*) from (select * from b except select * from a) union all select 'either', count(*) from (select * from a union select * from b)",
    "page_ranges": "select doc_id, row_number() over (partition by doc_id order by page) as new_page, page from (select doc_id, unnest(list_distinct(range(1, page_count // 3 + 1) || range(page_count - page_count // 3 + 1, page_count + 1))) as page from guideline_docs where page_count >= 3)",
}
_SQL["guardrail"] = _SQL["guardrail"].replace("with {ANSWERS}", _SQL["answers"])
SQL = {k: re.sub(r"\b([a-z]) -> ", r"lambda \1: ", v) for k, v in _SQL.items()}
