"""Queries of the page, validation, ground-truth and metadata operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions.text import audit_hash, is_iso_time
from leafmill.operators import chunks, discover, markdown, pages, quality, reports, validate
from leafmill.plans import report_queries as r
from leafmill.plans import table_queries as t
from leafmill.plans import text_queries as x
from leafmill.sources.tables import latest, table


def guides(spark, folder):
    return table(spark, folder, "guideline_docs").select("doc_id", "title", "page_count", "likely_scanned")


# --- ground truth by kind ---------------------------------------------------------------------


def _truth_items(spark, folder):
    """Headings as text items, the mirror's header names as table items, captions as image items."""
    text = x.chunk_rows(spark, folder).where("heading is not null").select(F.col("chunk_id").alias("item"), "doc_id", F.lit("text").alias("kind"), F.split(F.lower("heading"), " ").alias("words"))
    m = latest(table(spark, folder, "cross_validation_mirror"), "report_id", ["report_id", "doc_id", "headers"], "synced_at").where("headers is not null")
    tables = m.select(F.col("report_id").cast("string"), "doc_id", F.lit("table"), F.transform(F.filter("headers", lambda h: h.isNotNull()), F.lower))
    image = x.image_rows(spark, folder).where("caption is not null").select("image_id", "doc_id", F.lit("image"), F.split(F.lower("caption"), " "))
    return text.union(tables).union(image)


def _engine_texts(spark, folder, engine):
    return t.readings(spark, folder).where(F.col("engine") == engine).select("doc_id", F.lit("table").alias("kind"), F.col("markdown").alias("space"))


def _truth_spaces(spark, folder):
    text = x.docs(spark, folder).where("guideline_id is not null").select(F.col("guideline_id").alias("doc_id"), F.lit("text").alias("kind"), F.col("text").alias("space"))
    image = x.image_rows(spark, folder).select("doc_id", F.lit("image").alias("kind"), F.concat_ws(" ", "caption", "ocr_text").alias("space"))
    return text.unionByName(_engine_texts(spark, folder, "docling")).unionByName(image)


def ground_truth_kinds(spark, folder):
    """Items of each kind in the texts, the first engine's tables and the images of their guideline."""
    items = _truth_items(spark, folder)
    found = quality.ground_truth(items, _truth_spaces(spark, folder), ["doc_id", "kind"], "item")
    return items.select("item", "kind").join(found, "item")


def truth_recheck(spark, folder):
    """The table items again, in the second engine's and the stitched tables."""
    items = _truth_items(spark, folder).where("kind = 'table'")
    second = _engine_texts(spark, folder, "pymupdf")
    stitched = t.stitch_tables(spark, folder).join(t.readings(spark, folder).select(F.col("report_id").alias("upper_id"), "doc_id"), "upper_id")
    spaces = second.unionByName(stitched.select("doc_id", F.lit("table").alias("kind"), F.col("cell").alias("space")))
    return quality.ground_truth(items, spaces, ["doc_id", "kind"], "item")


def accuracy_kinds(spark, folder):
    """Accuracy by kind, of the re-checked tables, and of texts, images and re-checked tables together."""
    counts = [F.count(F.lit(1)).alias("items"), F.count_if("passed").alias("passed")]
    first = ground_truth_kinds(spark, folder).groupBy("kind").agg(*counts)
    again = truth_recheck(spark, folder).groupBy(F.lit("table again").alias("kind")).agg(*counts)
    last = F.when(F.col("kind") != "table", F.lit("combined"))
    every = first.unionByName(again).withColumn("kind", F.explode(F.array_compact(F.array("kind", last))))
    out = every.groupBy("kind").agg(F.sum("items").alias("items"), F.sum("passed").alias("passed"))
    return out.withColumn("accuracy", quality.share(F.col("passed"), F.col("items")))


def valid_truth(spark, folder):
    """Proposed items whose page is one of the guideline's and whose text holds all their words."""
    proposed = x.proposed_truth(spark, folder).select("doc_id", "page", F.split("words", " ").alias("words"))
    proposed = proposed.withColumn("item", F.concat_ws("/", "doc_id", "page"))
    spaces = x.chunk_rows(spark, folder).where("text is not null").select("doc_id", "page", F.col("text").alias("space"))
    held = quality.ground_truth(proposed, spaces, ["doc_id", "page"], "item")
    inside = proposed.join(guides(spark, folder), "doc_id").where("page between 1 and page_count")
    return inside.select("doc_id", "page", "item").join(held.where("passed"), "item").select("doc_id", "page", "found")


# --- metadata and enrichment --------------------------------------------------------------------


def dosing_metadata(spark, folder):
    """What dosing tables tell, with the condition named in their guideline's title."""
    d = t.readings(spark, folder).where("classification = 'dosing'").join(guides(spark, folder).select("doc_id", "title"), "doc_id", "left")
    told = chunks.dosing_metadata(d, "report_id", "markdown")
    condition = d.select("report_id", reports.condition_of(F.array(F.coalesce("title", F.lit(""))), x.TOPICS).alias("condition"))
    return told.join(condition, "report_id")


def age_limits(spark, folder):
    return x.docs(spark, folder).select("doc_id", *chunks.age_limits(F.col("text"))).where("age_min is not null or age_max is not null")


def table_enrichment(spark, folder):
    """Each reading with its final class, the outcome of its checks and its sentences."""
    checks = t.dosing_checks(spark, folder)
    passed = sum((F.when(F.col(c) == 0, 1).otherwise(0) for c in t.dosing.CHECKS), F.lit(0))
    status = F.when(~F.col("parsed"), "skipped").when(F.col("passed"), "pass").otherwise("fail")
    checks = checks.select("report_id", status.alias("status"), F.when(F.col("parsed"), passed).alias("checks_passed"))
    nll = t.table_linearise(spark, folder)
    return t.class_enrich(spark, folder).select("report_id", "final", "kind").join(checks, "report_id", "left").join(nll, "report_id", "left")


def context_previews(spark, folder):
    """The beginnings of the narratives before and after each chunk that isn't one."""
    linked = x.links(spark, folder).where("narrative_before is not null or narrative_after is not null")
    return chunks.context_previews(linked, x.chunk_rows(spark, folder), "chunk_id", "text")


def chunk_hashes(spark, folder):
    """Digests of whole chunks in one canonical form."""
    c = x.chunk_rows(spark, folder).select("chunk_id", F.coalesce("doc_id", F.lit("")).alias("doc_id"), F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("text", F.lit("")).alias("text"))
    return c.select("chunk_id", audit_hash(F.to_json(F.struct("chunk_id", "doc_id", "heading", "text"))).alias("whole_hash"), audit_hash(F.col("text")).alias("content_hash"))


def json_tokens(spark, folder):
    """Which of a few tokens stand in the cells of a reading, written as JSON, names of fields included."""
    c = table(spark, folder, "cross_validation_report").where("cells is not null").select("report_id", F.lower(F.to_json("cells")).alias("dump")).distinct()
    return c.select("report_id", *(F.contains("dump", F.lit(w)).alias(f"has_{w}") for w in ("dose", "mg", "tablet", "cell_value"))).distinct()


def iso_times(spark, folder):
    """How many times and languages, read as texts, are valid times."""
    d = table(spark, folder, "documents").select(F.explode(F.array(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "lang", F.lit("2025-02-30"))).alias("value")).where("value is not null")
    return d.groupBy(is_iso_time(F.col("value")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def chunk_summary(spark, folder):
    """Counts of a check of all chunks: levels, kinds, references to no chunk, tables of no page, sizes."""
    level = x.safety_level(spark, folder).groupBy(F.concat(F.lit("level "), "level").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    kind = x.chunk_kind_counts(spark, folder).select(F.concat(F.lit("kind "), "kind").alias("what"), "n")
    linked = x.links(spark, folder)
    refs = linked.select(F.explode(F.array_compact(F.array("previous", "next", "narrative_before", "narrative_after"))).alias("ref"))
    lost = refs.join(linked.select(F.col("chunk_id").alias("ref")), "ref", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("lost references").alias("what"), "n")
    bare = r.tables_without_chunk(spark, folder).agg(F.count(F.lit(1)).alias("n")).select(F.lit("tables without chunk").alias("what"), "n")
    c = x.chunk_rows(spark, folder)
    size = c.agg(F.max(F.coalesce(chunks.token_estimate(F.col("text")), F.lit(0))).cast("bigint").alias("n")).select(F.lit("most tokens").alias("what"), "n")
    seen = c.where("page is not null").select("doc_id", "page").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("pages covered").alias("what"), "n")
    out = level
    for one in (kind, lost, bare, size, seen):
        out = out.unionByName(one)
    return out


def known_drugs(spark, folder):
    """Drug names of the documents: those with a dose range, with a drug's ending, or before a dose."""
    return discover.drug_names(x.docs(spark, folder), "text", x.DRUG_ENDINGS, known=tuple(t.dose_ranges(spark, folder)))


def titles(spark, folder):
    """The first line of at least ten characters of each document."""
    return x.docs(spark, folder).select("doc_id", discover.title_of(F.split("text", "\n")).alias("title"))


MOST_DRUGS = 20


def truth_proposals(spark, folder):
    """Ground-truth items proposed from dosing and assessment pages, joined words."""
    drugs = sorted(t.dose_ranges(spark, folder))[:MOST_DRUGS]
    out = discover.truth_proposals(
        x.chunk_rows(spark, folder).where("page is not null"), t.readings(spark, folder), dosing_pages(spark, folder), x.assessment_pages(spark, folder),
        "doc_id", "page", "chunk_id", "text", "report_id", "markdown", drugs,
    )
    return out.select("doc_id", "page", "kind", F.array_join("words", " + ").alias("words"))


# --- pages ---------------------------------------------------------------------------------------


def dosing_pages(spark, folder):
    return pages.dosing_pages(t.readings(spark, folder), "doc_id", "page", "markdown")


def second_engine_tables(spark, folder):
    """The second engine's readings of pages on which the first engine's tables are cut by a page's end or agree less than fully."""
    cut = t.cell_agreement(spark, folder).where("agreement < 100").select("doc_id", "page")
    return pages.on_pages(t.readings(spark, folder).where("engine = 'pymupdf'"), cut, ["doc_id", "page"]).select("report_id", "doc_id", "page")


def recognition_requests(spark, folder):
    return pages.recognition_requests(x.chunk_rows(spark, folder), x.image_rows(spark, folder).withColumnRenamed("page_no", "page"), "doc_id", "page", "text")


def embedded_images(spark, folder):
    i = x.image_rows(spark, folder).withColumnRenamed("page_no", "page")
    return pages.embedded_images(i, "doc_id", "page", "image_id").select("image_id", "page", "number")


def page_parts(spark, folder):
    return pages.page_parts(guides(spark, folder), "doc_id", "page_count", 4)


def markdown_export(spark, folder):
    return pages.markdown_export(x.chunk_rows(spark, folder), "doc_id", ["page", "chunk_id"], F.col("text"))


def all_chunks(spark, folder):
    """Narratives, tables with their sentences, images and stitched tables of each guideline, in order."""
    c, i, d = x.chunk_rows(spark, folder), x.image_rows(spark, folder), t.readings(spark, folder).where("engine = 'docling'")
    narrative = pages.chunk_rows("narrative", c, "doc_id", F.col("page"), F.col("chunk_id"), F.col("text"))
    tables = pages.chunk_rows("table", d, "doc_id", F.col("page"), F.lpad(F.col("report_id").cast("string"), 12, "0"), F.col("markdown"), nll=markdown.linearised(F.col("markdown")))
    image = pages.chunk_rows("image", i, "doc_id", F.col("page_no"), F.col("image_id"), F.col("ocr_text"), caption=F.col("caption"))
    whole = r.stitched_sentences(spark, folder).join(t.page_break_pairs(spark, folder).select("upper_id", "lower_id", "doc_id", "page"), ["upper_id", "lower_id"])
    stitched = pages.chunk_rows("stitched", whole, "doc_id", F.col("page"), F.concat_ws("+", F.col("upper_id").cast("string"), F.col("lower_id").cast("string")), F.col("nll"))
    return pages.in_order([narrative, tables, image, stitched]).select("doc_id", "chunk_no", "kind", "page", "key", F.length("content").alias("n_chars"), F.length("nll").alias("nll_chars"), "caption")


# --- validators -----------------------------------------------------------------------------------


def structure_report(spark, folder):
    return validate.structure(guides(spark, folder), x.chunk_rows(spark, folder), "doc_id", "page", "chunk_id")


def tables_report(spark, folder):
    c = x.chunk_rows(spark, folder).groupBy("doc_id").agg(F.count_if("has_tables").alias("estimated"))
    return validate.tables(guides(spark, folder), t.readings(spark, folder), c, "doc_id", "markdown")


def consistency_report(spark, folder):
    return validate.consistency(guides(spark, folder), t.cell_agreement(spark, folder).withColumn("score", F.col("agreement") / 100), "doc_id", "score")


def terms_report(spark, folder):
    return validate.terms(guides(spark, folder), x.chunk_rows(spark, folder), "doc_id", "text", x.CRITICAL_TERMS)


def human_review(spark, folder):
    return validate.human_review(guides(spark, folder), t.readings(spark, folder), x.chunk_rows(spark, folder), recognition_requests(spark, folder), "doc_id", "page", "text", "markdown")


def overall_report(spark, folder):
    """The mean confidence of all five stages of each guideline."""
    review = human_review(spark, folder)
    stages = [structure_report(spark, folder), tables_report(spark, folder), consistency_report(spark, folder), terms_report(spark, folder), review]
    return validate.overall(stages, "doc_id", review)


def quality_counts(spark, folder):
    """Tables and images that pass their quality checks or don't, and readings that failed."""
    q = t.table_quality(spark, folder).select(F.lit("table").alias("what"), "passed").unionByName(x.image_quality(spark, folder).select(F.lit("image").alias("what"), "passed"))
    out = q.groupBy("what").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    skipped = table(spark, folder, "cross_validation_report").where("error is not null").select("report_id").distinct().agg(F.count(F.lit(1)).alias("skipped")).select(F.lit("table").alias("what"), "skipped")
    return out.join(skipped, "what", "left").na.fill(0, ["skipped"])


QUERIES = {
    f.__name__: f
    for f in (
        ground_truth_kinds, truth_recheck, accuracy_kinds, valid_truth, dosing_metadata, age_limits, table_enrichment, context_previews, chunk_hashes,
        json_tokens, iso_times, chunk_summary, dosing_pages, second_engine_tables, recognition_requests, embedded_images, page_parts, markdown_export,
        all_chunks, known_drugs, titles, truth_proposals, structure_report, tables_report, consistency_report, terms_report, human_review, overall_report, quality_counts,
    )
}

# --- SQL -------------------------------------------------------------------------------------------

_T = f"{t._R}, {x._C}, {x._I}, d as (select doc_id, text, guideline_id from documents where text is not null)"
_M = "m as (select report_id, doc_id, headers from cross_validation_mirror qualify row_number() over (partition by report_id order by synced_at desc nulls last) = 1)"
_ITEMS = (
    "it as (select chunk_id as item, doc_id, 'text' as kind, string_split(lower(heading), ' ') as words from c where heading is not null "
    "union all select report_id::varchar, doc_id, 'table', list_transform(list_filter(headers, lambda h: h is not null), lambda h: lower(h)) from m where headers is not null "
    "union all select image_id, doc_id, 'image', string_split(lower(caption), ' ') from i where caption is not null)"
)
_SPACES = (
    "sp as (select guideline_id as doc_id, 'text' as kind, lower(text) as space from d where guideline_id is not null union all select doc_id, 'table', lower(markdown) from r where engine = 'docling' "
    "union all select doc_id, 'image', lower(concat_ws(' ', caption, ocr_text)) from i)"
)


def _truth(items: str, spaces: str) -> str:
    """Steps w, hw and gt: which words of the items the spaces hold."""
    return (
        f"w as (select distinct doc_id, kind, unnest(words) as word from {items}), hw as (select distinct w.* from w join {spaces} s on s.doc_id = w.doc_id and s.kind = w.kind and contains(s.space, w.word)), "
        f"lw as (select item, doc_id, kind, unnest(words) as word from {items}), "
        f"ct as (select item, count(*) as n, count(*) filter (where hw.word is not null or lw.word = '') as found from lw left join hw on hw.doc_id = lw.doc_id and hw.kind = lw.kind and hw.word = lw.word group by 1), "
        f"gt as (select a.item, a.kind, coalesce(found, 0) as found, coalesce(n, 0) - coalesce(found, 0) as missing, coalesce(n, 0) = coalesce(found, 0) as passed from {items} a left join ct on ct.item = a.item)"
    )


_GT = f"select * from (with {_T}, {_M}, {_ITEMS}, {_SPACES}, {_truth('it', 'sp')} select item, kind, found, missing, passed from gt)"
_STITCHED = t.SQL["stitch_tables"]
_AGAIN = (
    f"select * from (with {_T}, {_M}, {_ITEMS}, ti as (select * from it where kind = 'table'), st as ({_STITCHED}), "
    "s2 as (select doc_id, 'table' as kind, lower(markdown) as space from r where engine = 'pymupdf' union all select r.doc_id, 'table', lower(st.cell) from st join r on r.report_id = st.upper_id), "
    f"{_truth('ti', 's2')} select item, found, missing, passed from gt)"
)
_COND = r._label("coalesce(title, '')")
_HEAD = "string_split(md, chr(10))[1]"
_LOOSE_FORM = t._s("regexp_replace(regexp_replace(" + t._s("{x}") + ", '\\s*[a-zA-Z]\\s*$', ''), '(?i)\\s*kg\\s*$', '')")
_DRUG2 = f"trim(rtrim(trim(regexp_extract({_HEAD}, '{chunks.DRUG_BEFORE_DOSE}', 1)), '|'))"
_DUR = "(?i)(?:for|over)\\s+(\\d+)\\s+(days?|weeks?)"
_TWO = "^(\\d+)\\s*(?:to|–|-)\\s*(\\d+)\\s*([A-Za-z]+)$"
_ONE = "^\\D*(\\d+)\\s*([A-Za-z]+)$"


def _limit(v: str, g: int) -> str:
    return f"case when regexp_matches({v}, '{_TWO}') then regexp_extract({v}, '{_TWO}', {g}) || ' ' || regexp_extract({v}, '{_TWO}', 3) else regexp_extract({v}, '{_ONE}', 1) || ' ' || regexp_extract({v}, '{_ONE}', 2) end"


def _like(col: str, words) -> str:
    return "(" + " or ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


_G = "g as (select distinct doc_id from guideline_docs)"
_STRUCTURE = f"""select * from (with {x._C}, {_G}, pg as (select distinct doc_id, page from c where page is not null), n as (select doc_id, count(*) as pages, min(page) as lo, max(page) as hi from pg group by 1),
 f as (select doc_id, page from pg qualify row_number() over (partition by doc_id order by page) <= 10), j as (select c.doc_id, (lead(level) over (partition by c.doc_id order by c.page, chunk_id) > level + 1) as jump from c join f on f.doc_id = c.doc_id and f.page = c.page where level is not null),
 s as (select doc_id, count(*) filter (where jump) as skipped_levels from j group by 1), a as (select g.doc_id, coalesce(pages, 0) as pages, coalesce(lo <> 1 or hi <> pages, false) as misnumbered, coalesce(skipped_levels, 0) as skipped_levels from g left join n on n.doc_id = g.doc_id left join s on s.doc_id = g.doc_id)
 select *, case when pages = 0 then 0.0 when not misnumbered and skipped_levels = 0 then 0.9 else 0.7 end::double as confidence, (not misnumbered and skipped_levels = 0 and pages > 0) as passed from a)"""
_TABLES = f"""select * from (with {t._R}, {x._C}, {_G}, k as (select doc_id, count(*) as tables, count(*) filter (where coalesce(num_cols, 0) < 2) as narrow, count(*) filter (where {_like('markdown', ('dose', 'mg'))} and len(regexp_extract_all(markdown, '\\d+\\.?\\d*')) < 3) as few_numbers from r group by 1),
 e as (select doc_id, count(*) filter (where has_tables) as estimated from c group by 1), a as (select g.doc_id, coalesce(tables, 0) as tables, coalesce(narrow, 0) as narrow, coalesce(few_numbers, 0) as few_numbers, coalesce(estimated, 0) as estimated from g left join k on k.doc_id = g.doc_id left join e on e.doc_id = g.doc_id),
 b as (select *, case when tables > 0 then round((tables - narrow)::double / tables, 6) when estimated > 0 then 0.3 else 1.0 end::double as confidence from a) select doc_id, tables, narrow, few_numbers, confidence, confidence >= 0.8 as passed from b)"""
_CONSISTENCY = f"select * from ({t.SQL['cell_agreement'].rsplit('select doc_id, page, left_key', 1)[0]}, {_G}, cs as (select doc_id, avg(round(100.0::double * matches / total, 6) / 100) as s from best group by 1) select g.doc_id, round(coalesce(s, 1.0), 6)::double as confidence, round(coalesce(s, 1.0), 6) >= 0.9 as passed from g left join cs on cs.doc_id = g.doc_id)"
_TERMS = (
    f"select * from (with {x._C}, {_G}, h as (select doc_id, " + ", ".join(f"bool_or(contains(lower(text), '{w}')) as t{k}" for k, w in enumerate(x.CRITICAL_TERMS)) + " from c group by 1), "
    "a as (select g.doc_id, " + " + ".join(f"(case when t{k} then 0 else 1 end)" for k in range(len(x.CRITICAL_TERMS))) + f" as missing from g left join h on h.doc_id = g.doc_id) select doc_id, missing, missing > {len(x.CRITICAL_TERMS) * 0.3} as many_missing, round(1.0 - missing::double / {len(x.CRITICAL_TERMS)}, 6) as confidence, round(1.0 - missing::double / {len(x.CRITICAL_TERMS)}, 6) >= 0.8 as passed from a)"
)
_REQUESTS = f"select * from (with {x._C}, {x._I}, l as (select doc_id, page, sum(coalesce(length(text), 0)) as n from c group by 1, 2) select distinct i.doc_id, i.page_no as page, 'requires_manual_review' as status from i left join l on l.doc_id = i.doc_id and l.page = i.page_no where i.page_no is not null and coalesce(n, 0) < 100)"
_REVIEW = f"""select * from (with {t._R}, {x._C}, {_G}, rq as ({_REQUESTS}), a as (select doc_id, count(*) as dosing_tables from r where {_like('markdown', ('dose', 'mg', 'tablet', 'administration'))} group by 1),
 b as (select doc_id, count(distinct coalesce(page, -1)) as warning_pages from c where {_like('text', ('contraindication', 'not recommended'))} group by 1), s as (select doc_id, count(*) as scanned_pages from rq group by 1),
 k as (select g.doc_id, coalesce(dosing_tables, 0) as dosing_tables, coalesce(warning_pages, 0) as warning_pages, coalesce(scanned_pages, 0) as scanned_pages from g left join a on a.doc_id = g.doc_id left join b on b.doc_id = g.doc_id left join s on s.doc_id = g.doc_id)
 select *, round(greatest(0.0, least(1.0, 1.0 - (dosing_tables + warning_pages + scanned_pages) * 0.1::double)), 6)::double as confidence, dosing_tables + warning_pages + scanned_pages = 0 as passed from k)"""

def _sentences(asked: str, texts: str, plain) -> str:
    """Rows (doc_id, page, rank, word, other) of the first telling sentences."""
    listed = ", ".join(f"'{w}'" for w in plain)
    return (
        f"(select doc_id, page, rank, word, other from (select a.*, chunk_id, k, list_filter(list_transform(list_filter(regexp_split_to_array(s, '\\s+'), lambda v: length(v) > 3), lambda v: trim(lower(v), '.,;:()')), lambda v: v <> a.word and v not in ({listed}))[1] as other "
        f"from {asked} a join (select doc_id, page, chunk_id, unnest(range(len(ss))) as k, {t._s('unnest(ss)')} as s from (select doc_id, page, chunk_id, regexp_split_to_array(text, '[.;\\n]') as ss from {texts})) z on z.doc_id = a.doc_id and z.page = a.page "
        "where contains(lower(s), a.word) and length(s) between 11 and 119 and len(list_filter(regexp_split_to_array(s, '\\s+'), lambda v: length(v) > 3)) >= 2) where other is not null qualify row_number() over (partition by doc_id, page, rank order by chunk_id, k) = 1)"
    )


def _held(texts: str, words: str, rank: str) -> str:
    """The first of the words (word, ord) that a page of `texts` holds."""
    return f"(select doc_id, page, {rank} as rank, word from {texts} join {words} w on contains(lower(text), word) qualify row_number() over (partition by doc_id, page, {rank} order by w.ord) = 1)"


_SECTION_ROWS = "(select * from (values " + ", ".join(f"({k}, {n}, '{w}')" for k, ws in enumerate(discover.SECTION_TYPES.values()) for n, w in enumerate(ws)) + ") v(section, ord, word))"
_PROPOSALS = f"""with {t._R}, {x._C}, dp as ({{DOSING}}), ap as ({x.SQL['assessment_pages']}), tx as (select * from c where text is not null and page is not null), lp as (select doc_id, page, row_number() over (partition by doc_id order by page) as no from dp),
 dr as (select lower(drug) as word, row_number() over (order by drug) as ord from dose_ranges qualify ord <= 20), t1 as (select tx.* from tx join lp on lp.doc_id = tx.doc_id and lp.page = tx.page where no <= 10), h1 as {_held('t1', 'dr', '0')}, s1 as {_sentences('h1', 't1', discover.PLAIN_WORDS)},
 ft as (select r.doc_id, r.page, markdown from r join lp on lp.doc_id = r.doc_id and lp.page = r.page where no <= 8 qualify row_number() over (partition by r.doc_id, r.page order by report_id) = 1),
 fl as (select doc_id, page, list_filter(list_transform(string_split(markdown, chr(10)), lambda v: {t._s('v')}), lambda v: v <> '' and not contains(v, '---')) as ls from ft),
 fc as (select doc_id, page, list_filter(flatten(list_transform(ls[2:], lambda y: list_filter(list_transform(string_split(y, '|'), lambda v: {t._s('v')}), lambda v: v <> ''))), lambda v: regexp_matches(v, '[0-9]') and length(v) between 4 and 39)[1] as cell from fl where len(ls) > 2),
 t3 as (select tx.* from tx where (doc_id, page) in (select (doc_id, page) from ap)), h3 as {_held('t3', _SECTION_ROWS, 'section')}, s3 as {_sentences('h3', 't3', discover.PLAIN_WORDS_OF_SECTIONS)},
 b3 as (select *, row_number() over (partition by doc_id order by page) as no from (select * from s3 qualify row_number() over (partition by doc_id, page order by rank) = 1)),
 al as (select doc_id, page, 'text' as kind, 1 as way, word || ' + ' || other as words from s1 union all select doc_id, page, 'table', 2, cell from fc where cell is not null union all select doc_id, page, 'text', 3, word || ' + ' || other from b3 where no <= 5),
 k as (select * from al qualify row_number() over (partition by doc_id, page, kind order by way) = 1) select doc_id, page, kind, words from k qualify row_number() over (partition by doc_id order by way, page) <= 20"""

SQL = {
    "ground_truth_kinds": _GT,
    "truth_recheck": _AGAIN,
    "accuracy_kinds": f"with a as ({_GT}), b as ({_AGAIN}), e as (select kind, passed from a union all select 'table again', passed from b union all select 'combined', passed from a where kind <> 'table' union all select 'combined', passed from b) "
    "select kind, count(*) as items, count(*) filter (where passed) as passed, round(100.0::double * count(*) filter (where passed) / count(*), 1) as accuracy from e group by 1",
    "valid_truth": f"with {x._C}, pt as ({x.SQL['proposed_truth']}), ws as (select doc_id, page, unnest(string_split(words, ' ')) as word from pt), "
    "hw as (select ws.doc_id, ws.page, count(*) as n, count(*) filter (where word = '' or exists (select 1 from c where c.doc_id = ws.doc_id and c.page = ws.page and contains(lower(c.text), lower(ws.word)))) as found from ws group by 1, 2) "
    "select hw.doc_id, page, found from hw join guideline_docs g on g.doc_id = hw.doc_id where n = found and page between 1 and page_count",
    "dosing_metadata": f"with {t._R}, z as (select report_id, title, {t._s('markdown')} as md from r left join guideline_docs g on g.doc_id = r.doc_id where classification = 'dosing'), "
    f"f as (select report_id, md, {_COND} as condition, coalesce(nullif(trim(regexp_extract({_HEAD}, '{chunks.DRUG_OF_DOSE}', 1)), ''), case when length({_DRUG2}) > 3 then {_DRUG2} end) as drug, nullif(trim(regexp_extract(md, '{chunks.FREQUENCY}', 1)), '') as frequency, "
    f"case when regexp_matches(md, '{_DUR}') then regexp_extract(md, '{_DUR}', 1) || ' ' || regexp_extract(md, '{_DUR}', 2) end as duration from z), "
    f"ln as (select report_id, unnest(list_filter(list_transform(string_split(md, chr(10)), lambda v: {t._s('v')}), lambda v: starts_with(v, '|') and not regexp_matches(v, '^\\|[-:\\s|]+\\|$'))) as line from f), "
    f"fc as (select report_id, list_filter(list_transform(string_split(line, '|'), lambda v: {t._s('v')}), lambda v: v <> '')[1] as cell from ln), fl as (select report_id, {_LOOSE_FORM.replace('{x}', 'cell')} as c3 from fc), "
    f"bd as (select report_id, min(low) as weight_min, max(high) as weight_max from (select report_id, {t._ll} as low, {t._lh} as high from fl) group by 1) "
    "select f.report_id, drug, frequency, duration, 'oral' as route, case when frequency is not null or duration is not null then 'Weight-based, ' || concat_ws(' ', frequency, 'for ' || duration) end as summary, weight_min, weight_max, condition from f left join bd on bd.report_id = f.report_id",
    "age_limits": f"with m as (select doc_id, regexp_extract_all(text, '{chunks.AGES}', 1) as ms from documents where text is not null), k as (select doc_id, list_filter(ms, lambda v: regexp_matches(v, '(?i)^(?:adult|patient|\\d)'))[-1] as lo, list_filter(ms, lambda v: not regexp_matches(v, '(?i)^(?:adult|patient)'))[-1] as hi from m) "
    f"select doc_id, case when lo is not null then {_limit('lo', 1)} end as age_min, case when hi is not null then {_limit('hi', 2)} end as age_max from k where lo is not null or hi is not null",
    "table_enrichment": f"with ch as ({t.SQL['dosing_checks']}), nl as ({t.SQL['table_linearise']}), en as ({t.SQL['class_enrich']}) select en.report_id, final, kind, case when ch.report_id is null then null when not parsed then 'skipped' when passed then 'pass' else 'fail' end as status, "
    "case when parsed then (contiguity = 0)::int + (monotonic = 0)::int + (coverage = 0)::int + (bounds = 0)::int + (ratio = 0)::int + (positive = 0)::int end as checks_passed, nll from en left join ch on ch.report_id = en.report_id left join nl on nl.report_id = en.report_id",
    "context_previews": f"with {x._C}, l as ({x.SQL['links']}) select l.chunk_id, trim(left(a.text, 500)) as preview_before, trim(left(b.text, 500)) as preview_after from l left join c a on a.chunk_id = narrative_before left join c b on b.chunk_id = narrative_after where narrative_before is not null or narrative_after is not null",
    "chunk_hashes": f"with {x._C} select chunk_id, sha256(to_json(struct_pack(chunk_id := chunk_id, doc_id := coalesce(doc_id, ''), heading := coalesce(heading, ''), text := coalesce(text, '')))::varchar) as whole_hash, sha256(coalesce(text, '')) as content_hash from c",
    "json_tokens": "select distinct report_id, " + ", ".join(f"contains(lower(to_json(cells)::varchar), '{w}') as has_{w}" for w in ("dose", "mg", "tablet", "cell_value")) + " from cross_validation_report where cells is not null",
    "iso_times": "with v as (select strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') as value from documents union all select lang from documents union all select '2025-02-30' from documents) select try_cast(value as timestamp) is not null as valid, count(*) as n from v where value is not null group by 1",
    "chunk_summary": f"with {x._C}, sl as ({x.SQL['safety_level']}), kc as ({x.SQL['chunk_kind_counts']}), l as ({x.SQL['links']}), tw as ({r.SQL['tables_without_chunk']}), rf as (select unnest([previous, next, narrative_before, narrative_after]) as ref from l) "
    "select 'level ' || level as what, count(*) as n from sl group by 1 union all select 'kind ' || kind, n from kc union all select 'lost references', count(*) from rf where ref is not null and ref not in (select chunk_id from c) union all select 'tables without chunk', count(*) from tw "
    f"union all select 'most tokens', max(floor({x._WORDS.format(x="coalesce(text, '')").replace('w -> ', 'lambda w: ')} * 1.3::double))::bigint from c union all select 'pages covered', count(*) from (select distinct doc_id, page from c where page is not null)",
    "dosing_pages": f"with {t._R}, s as (select doc_id, page, {' + '.join(f"contains(lower(markdown), '{w}')::int" for w in pages.DOSING_SCAN_WORDS)} as score from r) select doc_id, page, max(score) as score from s group by 1, 2 having max(score) >= 3",
    "second_engine_tables": f"with {t._R}, ag as ({t.SQL['cell_agreement']}) select report_id, doc_id, page from r where engine = 'pymupdf' and (doc_id, page) in (select (doc_id, page) from ag where agreement < 100)",
    "recognition_requests": _REQUESTS,
    "embedded_images": f"with {x._I} select image_id, page_no as page, row_number() over (partition by doc_id, page_no order by image_id) - 1 as number from i where width::bigint * height >= 400",
    "page_parts": "with s as (select doc_id, page_count as n, ceil(page_count / 4.0)::int as z from guideline_docs where page_count > 0), e as (select doc_id, n, z, unnest(range((n + z - 1) // z)) as part from s) select doc_id, part, part * z + 1 as first, least(part * z + z, n) as last, part * z as \"offset\" from e",
    "markdown_export": f"with {x._C} select doc_id, row_number() over (partition by doc_id order by page nulls first, chunk_id) as part_no, text as part from c where text is not null",
    "all_chunks": f"with {t._R}, {x._C}, {x._I}, ss as ({t.SQL['stitch_tables']}), pb as ({t.SQL['page_break_pairs']}), "
    "st as (select pb.doc_id, pb.page, ss.upper_id, ss.lower_id from (select distinct upper_id, lower_id from ss) ss join pb on pb.upper_id = ss.upper_id and pb.lower_id = ss.lower_id), "
    f"nl as ({t.SQL['table_linearise'].replace(" where classification in ('dosing', 'clinical_management')", "")}), "
    "a as (select doc_id, 'narrative' as kind, 0 as rank, page, chunk_id as key, text as content, null as nll, null as caption, 0 as late from c union all select doc_id, 'table', 1, page, lpad(r.report_id::varchar, 12, '0'), markdown, nll, null, 0 from r left join nl on nl.report_id = r.report_id where engine = 'docling' "
    "union all select doc_id, 'image', 2, page_no, image_id, ocr_text, null, caption, 0 from i union all select doc_id, 'stitched', 3, page, upper_id || '+' || lower_id, null, null, null, 1 from st) "
    "select doc_id, row_number() over (partition by doc_id order by late, page nulls first, rank, key) as chunk_no, kind, page, key, length(content) as n_chars, length(nll) as nll_chars, caption from a",
    "known_drugs": f"with dk as ({x.SQL['drug_discovery']}), ws as (select word, count(*) as times from (select unnest(regexp_extract_all(lower(text), '\\b([a-z]{{4,20}})\\b', 1)) as word from documents where text is not null) group by 1), kn as (select distinct lower(drug) as word from dose_ranges) "
    "select ws.word, ws.times, case when kn.word is not null then 'known' else dk.by end as by from ws left join dk on dk.word = ws.word left join kn on kn.word = ws.word where dk.word is not null or kn.word is not null",
    "titles": f"select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda v: trim(v, ' ')), lambda v: length(v) >= 10)[1] as title from documents where text is not null",
    "structure_report": _STRUCTURE,
    "tables_report": _TABLES,
    "consistency_report": _CONSISTENCY,
    "terms_report": _TERMS,
    "human_review": _REVIEW,
    "overall_report": f"with a as (select doc_id, confidence from ({_STRUCTURE}) union all select doc_id, confidence from ({_TABLES}) union all select doc_id, confidence from ({_CONSISTENCY}) union all select doc_id, confidence from ({_TERMS}) union all select doc_id, confidence from ({_REVIEW})), "
    f"v as (select doc_id, not passed as needs_review from ({_REVIEW})), b as (select doc_id, round(avg(confidence), 6) as confidence from a group by 1) select b.doc_id, confidence, confidence >= 0.8 as passed, needs_review from b join v on v.doc_id = b.doc_id",
    "quality_counts": f"with tq as ({t.SQL['table_quality']}), iq as ({x.SQL['image_quality']}), sk as (select count(distinct report_id) as n from cross_validation_report where error is not null) "
    "select 'table' as what, count(*) filter (where passed) as passed, count(*) filter (where not passed) as failed, (select n from sk) as skipped from tq union all select 'image', count(*) filter (where passed), count(*) filter (where not passed), 0 from iq",
}
SQL["truth_proposals"] = _PROPOSALS.replace("{DOSING}", SQL["dosing_pages"])
