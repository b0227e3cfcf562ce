"""BM25 retrieval in batches of queries, answers from the best chunks, and response checks.

The index is a long table (chunk, term, tf) and small per-term and corpus statistics; scoring
joins query terms with the index on the term, so cost follows the postings of the asked terms.
Texts without terms have no postings and score 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import search_terms

K1, B, EPSILON = 1.5, 0.75, 0.25
# Phrases that make a question urgent, sections that a response must have,
# and patterns of advice that must not be given.
URGENT_PHRASES = ("unable to drink", "cannot drink", "convuls", "seizure", "unconscious", "very weak", "lethargic", "bleeding")
REQUIRED_SECTIONS = ("Triage Level:", "Immediate Actions:", "Next Steps / Monitoring:", "When to Refer:", "Citations:")
FORBIDDEN_ADVICE = (
    "give.*medicine.*without (referral|doctor)",
    "wait (and see|for.*days).*danger sign",
    "treat at home.*(convulsion|unable to drink|bleeding)",
    "give.*aspirin.*child",
)
TRIAGE = "Triage Level:\\s*([🔴🟡🟢]?\\s*RED|YELLOW|GREEN)"


def postings(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, len): term counts of each chunk, with its number of terms."""
    terms = chunks.select(key, search_terms(F.col(text)).alias("terms")).withColumn("len", F.size("terms"))
    return terms.select(key, "len", F.explode("terms").alias("term")).groupBy(key, "term", "len").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(chunks: DataFrame, text: str) -> tuple[float, float]:
    """Number of chunks and their mean length in terms: two numbers, worked out at once."""
    n = F.size(search_terms(F.coalesce(F.col(text), F.lit(""))))
    one = chunks.agg(F.count(F.lit(1)).cast("double"), F.avg(n)).first()
    return one[0], one[1] or 0.0


def term_idf(index: DataFrame, n_docs: float, epsilon: float = EPSILON) -> DataFrame:
    """(term, idf): negative values are replaced by epsilon times the mean idf of all terms."""
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.select("term", (F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    floor = raw.agg(F.avg("raw") * epsilon).first()[0] or 0.0
    return raw.select("term", F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw")).alias("idf"))


def bm25(queries: DataFrame, query_key: str, query_text: str, chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(query_key, key, score): chunks with a term of the query; a repeated term counts again."""
    index = postings(chunks, key, text)
    n_docs, avg_len = corpus_stats(chunks, text)
    asked = queries.select(query_key, F.explode(search_terms(F.col(query_text))).alias("term")).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("times"))
    hit = asked.join(index, "term").join(term_idf(index, n_docs), "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(avg_len or 1.0)))
    return hit.groupBy(query_key, key).agg(F.sum(part).alias("score"))


def top_hits(scored: DataFrame, query_key: str, key: str, k: int = 5) -> DataFrame:
    """The k best chunks of each query; of equal scores the greater key comes first."""
    w = Window.partitionBy(query_key).orderBy(F.round("score", 9).desc(), F.col(key).desc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def is_urgent(question: Column) -> Column:
    low, out = F.lower(question), F.lit(False)
    for p in URGENT_PHRASES:
        out = out | F.contains(low, F.lit(p))
    return out


def excerpt(heading: Column, text: Column, page: Column) -> Column:
    """One source of an answer: heading, the first 500 characters, page."""
    return F.concat(F.lit("### "), F.coalesce(heading, F.lit("")), F.lit("\n"), F.left(F.coalesce(text, F.lit("")), F.lit(500)), F.lit("...\nReference: Page "), F.coalesce(page.cast("string"), F.lit("?")))


def answers(hits: DataFrame, query_key: str, question: str) -> DataFrame:
    """(query_key, question, pages, response): excerpts by rank and the closing sections.

    `hits` has rank, heading, text, page and the question.
    """
    one = hits.groupBy(query_key, question).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", excerpt(F.col("heading"), F.col("text"), F.col("page")).alias("x")))), lambda s: s["x"]), "\n\n").alias("body"),
        F.array_sort(F.collect_set("page")).alias("pages"),
    )
    cited = F.array_join(F.transform("pages", lambda p: F.concat(F.lit("Page "), p.cast("string"))), ", ")
    level = F.when(is_urgent(F.col(question)), "RED").otherwise("GREEN")
    closing = F.concat(
        F.lit("\n---\nTriage Level: "), level, F.lit("\nImmediate Actions: review the excerpts above.\nNext Steps / Monitoring: consult the full source.\nWhen to Refer: per excerpts.\nCitations: "), cited
    )
    return one.select(query_key, question, F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), F.concat("body", closing).alias("response"))


def response_checks(responses: DataFrame, question: str, response: str) -> list[Column]:
    """missing sections, triage, urgent_missed, forbidden, passed (citations only warn)."""
    r, q = F.col(response), F.col(question)
    missing = sum((F.when(F.contains(r, F.lit(s)), 0).otherwise(1) for s in REQUIRED_SECTIONS), F.lit(0))
    triage = F.when(r.rlike(TRIAGE), F.regexp_extract(r, TRIAGE, 1))
    urgent = is_urgent(q) & triage.isNotNull() & ~F.contains(triage, F.lit("RED"))
    low = F.lower(r)
    forbidden = sum((low.rlike("(?d)" + p).cast("int") for p in FORBIDDEN_ADVICE), F.lit(0))
    passed = (missing == 0) & ~F.coalesce(urgent, F.lit(False)) & (forbidden == 0)
    return [missing.alias("missing_sections"), triage.alias("triage"), F.coalesce(urgent, F.lit(False)).alias("urgent_missed"), forbidden.alias("forbidden"), passed.alias("passed")]


def citations(response: Column) -> Column:
    """Page numbers cited as "Page 7" or "p. 7", distinct."""
    found = F.concat(F.regexp_extract_all(response, F.lit("Page:?\\s*(\\d+)"), F.lit(1)), F.regexp_extract_all(response, F.lit("p\\.?\\s*(\\d+)"), F.lit(1)))
    return F.array_distinct(F.transform(found, lambda x: x.try_cast("int")))


def unknown_citations(responses: DataFrame, key: str, response: str, pages: DataFrame, page: str = "page") -> DataFrame:
    """(key, page): cited pages that the corpus hasn't."""
    cited = responses.select(key, F.explode(citations(F.col(response))).alias(page))
    return cited.join(pages.select(page).distinct(), page, "left_anti").select(key, page)
