"""Chunks: records from page blocks, metadata by patterns, matching to inventories, links, checks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.config import Config, any_pattern
from leafmill.functions.bands import band_loose
from leafmill.functions.text import let, strip, token_estimate, word_count
from leafmill.operators.markdown import tight_cells

# Patterns of clinical metadata.
AGE_UNDER = "(?i)children?\\s+(?:under|<|below|aged?)\\s*(\\d+)\\s*(years?|months?|yrs?)"
AGE_RANGE = "(?i)(\\d+)\\s*(?:to|–|-)\\s*(\\d+)\\s*(years?|months?)"
WEIGHT_MENTION = "(?i)(?:weighing|weight)\\s*(?:<|>|≤|≥|less than|more than|under|over)?\\s*(\\d+(?:\\.\\d+)?)\\s*kg"
FREQUENCY = "(?i)((?:once|twice|three times|four times)\\s+(?:a\\s+)?daily)"
DURATION = "(?i)(?:for|over)\\s+(\\d+\\s+(?:days?|weeks?))"
SPAN_PATTERNS = {
    "contraindications": (
        "(?i)contraindicated\\s+(?:in|for)\\s+([^.;]+)",
        "(?i)(?:do not give|should not be (?:given|used)|avoid)\\s+(?:in|for|to)\\s+([^.;]+)",
        "(?i)not recommended\\s+(?:in|for)\\s+([^.;]+)",
    ),
    "danger_signs": ("(?i)danger\\s+signs?\\s*[:;–-]\\s*([^.;]+)", "(?i)danger\\s+signs?\\s+include\\s*([^.;]+)"),
    "referral": ("(?i)refer\\s+(?:immediately|urgently)\\s+(?:if|when|to)\\s+([^.;]+)", "(?i)refer(?:ral)?\\s+(?:to|criteria)\\s*[:;–-]\\s*([^.;]+)"),
    "populations": (
        "(?i)(pregnant\\s+women[^.;]*)",
        "(?i)(children\\s+(?:under|<|weighing\\s*<)\\s*[\\d]+\\s*(?:kg|years?|months?)[^.;]*)",
        "(?i)(infants?\\s*(?:<|under)\\s*[\\d]+\\s*(?:months?|weeks?)[^.;]*)",
        "(?i)(HIV[^.;]*patients?[^.;]*)",
    ),
    "features": ("(?i)clinical\\s+features?\\s*[:;–-]\\s*([^.;]{10,})", "(?i)(?:signs?\\s+and\\s+symptoms?|presenting\\s+features?)\\s*[:;–-]\\s*([^.;]{10,})"),
}
SPAN_CUT = {"contraindications": 1000, "danger_signs": 120, "referral": 120, "populations": 100, "features": 150}
AGES = (
    "(?i)(children?\\s+(?:under|<|below|aged?)\\s*\\d+\\s*(?:years?|months?|yrs?)"
    "|infants?\\s*(?:<|under)\\s*\\d+\\s*(?:months?|weeks?)"
    "|(?:adults?|patients?)\\s*(?:>|≥|aged?\\s*≥?)\\s*\\d+\\s*(?:years?|yrs?)"
    "|\\d+\\s*(?:to|–|-)\\s*\\d+\\s*(?:years?|months?))"
)
DRUG_OF_DOSE = "(?i)dose\\s*\\(mg\\)\\s*of\\s+(.+?)(?:\\s+given|\\s+dose|\\s*$)"
DRUG_BEFORE_DOSE = "(?i)^[|]\\s*[^|]*[|]\\s*(.+?)(?:\\s+dose|\\s*\\()"
DANGER_PHRASES = ("danger sign", "refer immediately", "refer urgently", "referral criteria")


def spans(text: Column, kind: str, cut: int | None = None, more: tuple[str, ...] = ()) -> Column:
    """What the kind's patterns, and `more`, find in `text`: stripped, cut, distinct, sorted."""
    found = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in (*SPAN_PATTERNS[kind], *more))))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.left(F.trim(x), F.lit(cut or SPAN_CUT[kind])))))


def last_match(text: Column, pattern: str, group: int) -> Column:
    """The group of the pattern's last match, null without a match."""
    return F.try_element_at(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group)), F.lit(-1))


def clinical_metadata(text: Column) -> list[Column]:
    """Age, weight, frequency, duration and spans, each as a named column."""
    weights = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)((?:weighing|weight)\\s*(?:<|>|≤|≥|less than|more than|under|over)?\\s*\\d+(?:\\.\\d+)?\\s*kg)"), F.lit(1))
    below = F.filter(weights, lambda w: F.contains(F.lower(w), F.lit("less")) | F.contains(w, F.lit("<")))
    above = F.filter(weights, lambda w: ~(F.contains(F.lower(w), F.lit("less")) | F.contains(w, F.lit("<"))))
    kilos = lambda a: F.regexp_extract(F.try_element_at(a, F.lit(-1)), "(\\d+(?:\\.\\d+)?)\\s*kg", 1).try_cast("double")
    return [
        F.concat_ws(" ", last_match(text, AGE_UNDER, 1), last_match(text, AGE_UNDER, 2)).alias("age_under"),
        last_match(text, AGE_RANGE, 1).alias("age_from"),
        last_match(text, AGE_RANGE, 2).alias("age_to"),
        kilos(below).alias("weight_max"),
        kilos(above).alias("weight_min"),
        F.when(text.rlike(FREQUENCY), F.regexp_extract(text, FREQUENCY, 1)).alias("frequency"),
        F.when(text.rlike(DURATION), F.regexp_extract(text, DURATION, 1)).alias("duration"),
        *(F.array_join(spans(text, k), " # ").alias(k) for k in SPAN_PATTERNS),
    ]


def biomarker_patterns(config: Config) -> tuple[str, ...]:
    """Patterns of populations told by a deficiency of one of the collection's biomarkers."""
    return tuple(f"(?i)({re.escape(b)}\\s+deficien[ct][^.;]*)" for b in config.biomarkers)


def age_limits(text: Column) -> list[Column]:
    """(age_min, age_max): the last mention that gives each, over all ways to write an age."""
    mentions = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(AGES), F.lit(1))
    one, two = "^\\D*(\\d+)\\s*([A-Za-z]+)$", "^(\\d+)\\s*(?:to|–|-)\\s*(\\d+)\\s*([A-Za-z]+)$"
    last = lambda m, keep: F.try_element_at(F.filter(m, keep), F.lit(-1))

    def limit(x: Column, of_range: int) -> Column:
        whole = F.concat_ws(" ", F.regexp_extract(x, two, of_range), F.regexp_extract(x, two, 3))
        return F.when(x.rlike(two), whole).when(x.isNotNull(), F.concat_ws(" ", F.regexp_extract(x, one, 1), F.regexp_extract(x, one, 2)))

    low = let(mentions, lambda m: let(last(m, lambda x: x.rlike("(?i)^(?:adult|patient|\\d)")), lambda x: limit(x, 1)))
    high = let(mentions, lambda m: let(last(m, lambda x: ~x.rlike("(?i)^(?:adult|patient)")), lambda x: limit(x, 2)))
    return [low.alias("age_min"), high.alias("age_max")]


def dosing_metadata(df: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, drug, frequency, duration, route, summary, weight_min, weight_max): what a dosing table tells.

    The drug stands in the header after "Dose (mg) of", or before "dose" in the second cell (more
    than three letters). Weights are the least lower and greatest upper limit of the first cells; no
    upper limit if all are open.
    """
    text = strip(F.col(markdown))
    header = F.split_part(text, F.lit("\n"), F.lit(1))
    bare = lambda c: F.regexp_replace(c, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")
    named = F.nullif(bare(F.regexp_extract(header, DRUG_OF_DOSE, 1)), F.lit(""))
    before = bare(F.rtrim(bare(F.regexp_extract(header, DRUG_BEFORE_DOSE, 1)), F.lit("|")))
    drug = F.coalesce(named, F.when(F.length(before) > 3, before))
    span = "(?i)(?:for|over)\\s+(\\d+)\\s+(days?|weeks?)"
    frequency = F.nullif(F.trim(F.regexp_extract(text, FREQUENCY, 1)), F.lit(""))
    duration = F.when(text.rlike(span), F.concat_ws(" ", F.regexp_extract(text, span, 1), F.regexp_extract(text, span, 2)))
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.startswith(x, F.lit("|")) & ~x.rlike("^\\|[-:\\s|]+\\|$"))
    bands = F.filter(F.transform(lines, lambda x: band_loose(F.get(tight_cells(x), F.lit(0)))), lambda b: b.isNotNull())
    told = df.select(key, drug.alias("drug"), frequency.alias("frequency"), duration.alias("duration"), F.lit("oral").alias("route"), bands.alias("_bands"))
    parts = F.concat_ws(" ", "frequency", F.concat(F.lit("for "), F.col("duration")))
    summary = F.when(F.col("frequency").isNotNull() | F.col("duration").isNotNull(), F.concat(F.lit("Weight-based, "), parts))
    low, high = F.array_min(F.transform("_bands", lambda b: b["low"])), F.array_max(F.transform("_bands", lambda b: b["high"]))
    return told.select(key, "drug", "frequency", "duration", "route", summary.alias("summary"), low.alias("weight_min"), high.alias("weight_max"))


def care_levels(text: Column, config: Config) -> Column:
    """Level-of-care mentions in one spelling, distinct and sorted; empty without terms."""
    pattern = any_pattern(config.care_levels)
    if pattern is None:
        return F.array().cast("array<string>")
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    tidy = lambda x: F.replace(F.replace(F.replace(F.upper(x), F.lit("HC IV"), F.lit("HC4")), F.lit("HC III"), F.lit("HC3")), F.lit("HC II"), F.lit("HC2"))
    return F.array_sort(F.array_distinct(F.transform(found, tidy)))


def preservation(kind: Column, final_class: Column, content: Column, config: Config) -> Column:
    """How literally a chunk must be kept: verbatim, high or standard."""
    low = F.lower(F.coalesce(content, F.lit("")))
    danger = F.lit(False)
    for p in DANGER_PHRASES:
        danger = danger | F.contains(low, F.lit(p))
    prose = kind.isin("narrative", "image")
    pattern = any_pattern(config.high_preservation_terms)
    high = content.rlike(pattern) if pattern else F.lit(False)
    dosing = (kind == "dosing_table") | (F.endswith(kind, F.lit("_table")) & (F.coalesce(final_class, F.lit("")) == "dosing"))
    return F.when(dosing | (kind == "clinical_table"), "verbatim").when(kind == "evidence_table", "high").when(prose & danger, "verbatim").when(prose & F.coalesce(high, F.lit(False)), "high").otherwise("standard")


def numbered(df: DataFrame, doc: str, order: list[str], name: str) -> DataFrame:
    """`df` with `name`: each row's number in its document, from 1, nulls first.

    Rows are numbered within a document and first order column (a page), and the pages' offsets
    are added, so a document that holds a third of all rows is not one task.
    """
    first, rest = order[0], order[1:] or order
    page = F.struct(F.col(first).isNotNull().alias("known"), F.col(first).alias("page"))
    paged = df.withColumn("_page", page)
    sizes = paged.groupBy(doc, "_page").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(doc).orderBy("_page").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col(doc).alias("_doc"), F.col("_page").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = paged.withColumn("_in", F.row_number().over(Window.partitionBy(doc, "_page").orderBy(*rest)))
    both = inside.join(offsets, F.col(doc).eqNullSafe(F.col("_doc")) & F.col("_page").eqNullSafe(F.col("_of")))
    return both.withColumn(name, (F.col("_in") + F.col("_before")).cast("int")).drop("_page", "_in", "_doc", "_of", "_before")


def chunk_records(df: DataFrame, doc: str, heading: str, level: str, text: str, order: list[str]) -> DataFrame:
    """`df` with chunk text under its heading, counts, token estimate and number in the document."""
    marked = F.concat(F.repeat(F.lit("#"), F.coalesce(F.col(level), F.lit(1))), F.lit(" "), F.coalesce(F.col(heading), F.lit("")))
    whole = F.when(F.col(heading).isNull(), F.col(text)).otherwise(F.concat(marked, F.lit("\n\n"), F.coalesce(F.col(text), F.lit(""))))
    counted = df.withColumn("content", whole).withColumn("n_chars", F.length("content")).withColumn("n_words", word_count(F.col("content"))).withColumn("n_tokens", token_estimate(F.col("content")))
    return numbered(counted, doc, order, "chunk_no")


def carried(df: DataFrame, doc: str, order: list[str], before: dict[str, Column], after: dict[str, Column] | None = None, own: bool = False) -> DataFrame:
    """`df` with, by name, the last value that isn't null of the rows before in the document (`own`: or of
    the row itself), and the first one of the rows after.

    Windows run within a document and first order column (a page); what pages leave to later and
    earlier ones is a window over their aggregates. So a document that holds a third of all rows is not one task.
    """
    after = after or {}
    first, rest = order[0], order[1:] or order
    paged = df.withColumn("_page", F.struct(F.col(first).isNotNull().alias("known"), F.col(first).alias("page")))
    place = F.struct(*rest)
    values = {f"_v{k}": v for k, v in enumerate([*before.values(), *after.values()])}
    paged = paged.withColumns(values)
    back, ahead = list(values)[: len(before)], list(values)[len(before) :]
    inside = Window.partitionBy(doc, "_page").orderBy(*rest)
    for v in back:
        paged = paged.withColumn(f"{v}i", F.last(v, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0 if own else -1)))
    for v in ahead:
        paged = paged.withColumn(f"{v}i", F.first(v, ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing)))
    known = lambda v: F.when(F.col(v).isNotNull(), place)
    sums = paged.groupBy(doc, "_page").agg(*(F.max_by(v, known(v)).alias(v) for v in back), *(F.min_by(v, known(v)).alias(v) for v in ahead))
    over = Window.partitionBy(doc).orderBy("_page")
    told = sums.select(
        F.col(doc).alias("_doc"), F.col("_page").alias("_of"),
        *(F.last(v, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias(f"{v}p") for v in back),
        *(F.first(v, ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias(f"{v}p") for v in ahead),
    )
    both = paged.join(told, F.col(doc).eqNullSafe(F.col("_doc")) & F.col("_page").eqNullSafe(F.col("_of")))
    names = dict(zip([*before, *after], values, strict=True))
    return both.select(*(F.col(c) for c in df.columns), *(F.coalesce(f"{v}i", f"{v}p").alias(n) for n, v in names.items()))


def linked(chunks: DataFrame, doc: str, order: str | list[str], key: str, narrative: Column) -> DataFrame:
    """`chunks` with neighbours and, for those that aren't narrative, the nearest narratives."""
    order = [order] if isinstance(order, str) else order
    text = F.when(narrative, F.col(key))
    out = carried(chunks, doc, order, {"previous": F.col(key), "_before": text}, {"next": F.col(key), "_after": text})
    return out.withColumn("narrative_before", F.when(~narrative, F.col("_before"))).withColumn("narrative_after", F.when(~narrative, F.col("_after"))).drop("_before", "_after")


def context_previews(linked_chunks: DataFrame, chunks: DataFrame, key: str, text: str, most: int = 500) -> DataFrame:
    """(key, preview_before, preview_after): the beginnings of the nearest narratives, at most `most` characters."""
    told = chunks.select(F.col(key).alias("_key"), F.trim(F.left(text, F.lit(most))).alias("_text"))
    out = linked_chunks.select(key, "narrative_before", "narrative_after")
    for side in ("before", "after"):
        out = out.join(told.select(F.col("_key").alias(f"narrative_{side}"), F.col("_text").alias(f"preview_{side}")), f"narrative_{side}", "left")
    return out.select(key, "preview_before", "preview_after")


def dependents(linked_chunks: DataFrame, key: str) -> DataFrame:
    """(chunk, context_for): the non-narrative chunks whose nearest narrative before is `chunk`."""
    rows = linked_chunks.where(F.col("narrative_before").isNotNull())
    return rows.groupBy(F.col("narrative_before").alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("context_for"))


def chunk_problems(chunks: DataFrame, key: str, refs: str, tokens: Column, limit: int) -> DataFrame:
    """(problem, n): duplicated keys, references to no chunk, chunks over the token limit."""
    keys = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    doubled = keys.where("n > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_id").alias("problem"), "n")
    asked = chunks.where(F.col(refs).isNotNull()).select(F.col(refs).alias("_ref"))
    lost = asked.join(keys.select(F.col(key).alias("_ref")), "_ref", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("lost_reference").alias("problem"), "n")
    long = chunks.where(tokens > limit).agg(F.count(F.lit(1)).alias("n")).select(F.lit("too_long").alias("problem"), "n")
    return doubled.unionByName(lost).unionByName(long)


def positional_match(left: DataFrame, right: DataFrame, on: list[str], left_order: list[str], right_order: list[str], key: str, right_key: str) -> DataFrame:
    """(on, place, key, right_key): the k-th left row of a group with the k-th right row, if any."""
    number = lambda df, order: df.withColumn("place", F.row_number().over(Window.partitionBy(*on).orderBy(*order)))
    a = number(left.select(*on, key, *[c for c in left_order if c not in (*on, key)]), left_order).select(*on, "place", key)
    b = number(right.select(*on, right_key, *[c for c in right_order if c not in (*on, right_key)]), right_order).select(*on, "place", right_key)
    return a.join(b, [*on, "place"], "left")


def _greedy(pages: list[int], stock: dict[int, list]) -> list:
    """Matches of elements in order: on the page, the one before, the one after; each page's counter
    moves on by one for each match while the matched entry leaves the list."""
    left = {p: list(v) for p, v in stock.items()}
    seen: dict[int, int] = {}
    out = []
    for p in pages:
        got = None
        for q in () if p is None else (p, p - 1, p + 1):
            if left.get(q):
                k = min(seen.get(q, 0), len(left[q]) - 1)
                got = left[q].pop(k)
                seen[q] = seen.get(q, 0) + 1
                break
        out.append(got)
    return out


def greedy_match(elements: DataFrame, inventory: DataFrame) -> DataFrame:
    """(doc_id, element_no, table_index): table elements with inventory entries, by page and order.

    `elements` has doc_id, element_no, page (null: unknown); `inventory` doc_id, page,
    table_index. The match depends on what earlier elements of the document took, so a document
    is one group; both sides are reduced to these columns first.
    """
    e = elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("element_no", "page"))).alias("e"))
    i = inventory.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "table_index"))).alias("i"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, es, stock in zip(b["doc_id"], b["e"], b["i"], strict=True):
                by_page: dict[int, list] = {}
                for x in stock if stock is not None else ():
                    by_page.setdefault(x["page"], []).append(x["table_index"])
                got = _greedy([x["page"] for x in es], by_page)
                out += [(doc, x["element_no"], g) for x, g in zip(es, got, strict=True)]
            yield pd.DataFrame(out, columns=["doc_id", "element_no", "table_index"]).astype({"table_index": "Int64"})

    return e.join(i, "doc_id", "left").mapInPandas(run, "doc_id string, element_no bigint, table_index bigint")
