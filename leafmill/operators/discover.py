"""Discovery of a collection's settings from its text: drugs, topics, pages, ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import let, score_of, strip
from leafmill.operators.markdown import table_lines, tight_cells

# Endings of drug names, and words before a dose that are none.
DRUG_ENDINGS = (
    "mycin", "cillin", "azole", "prazole", "statin", "pril", "sartan", "olol", "dipine", "sone", "olone", "quine", "mide", "zide", "pam", "lam",
    "pine", "oxin", "formin", "gliptin", "flozin", "lukast", "parin", "virin", "navir", "ciclovir", "bivir", "fenac", "profen", "oxicam", "triptan",
    "setron", "mab", "nib", "tinib", "zumab", "ximab", "tide", "retin", "mustine", "platin", "taxel", "rubicin", "ephrine", "butol", "thiazide",
    "pamide",
)
NOT_DRUGS = (
    "dose", "give", "take", "body", "weight", "oral", "daily", "twice", "once", "every", "hours", "days", "weeks", "months", "years", "than", "less",
    "more", "above", "below", "over", "under", "from", "with", "treatment", "management", "clinical", "patient", "diagnosis", "disease", "infection",
    "condition", "symptoms", "complications", "prevention", "monitoring", "assessment", "therapy", "protocol", "guidelines", "chapter", "section",
    "table", "figure", "children", "adults", "pregnant", "women", "refer",
)
# Words that tell a section type.
SECTION_TYPES = {
    "clinical_features": ("clinical features", "signs and symptoms", "presenting features", "symptoms include"),
    "diagnostic_criteria": ("diagnostic criteria", "diagnosis", "differential diagnosis", "investigations"),
    "management": ("management", "treatment"),
    "referral": ("referral criteria", "refer to", "refer immediately", "refer urgently", "refer the patient"),
    "prevention": ("prevention", "preventive measures", "prophylaxis"),
    "complications": ("complications", "adverse outcomes"),
    "danger_signs": ("danger sign", "danger signs", "warning sign", "emergency signs", "red flag"),
}


# Words that don't tell a sentence, beside a drug and beside a section word.
PLAIN_WORDS = ("with", "from", "that", "this", "have", "been", "also", "should", "which", "will")
PLAIN_WORDS_OF_SECTIONS = ("with", "from", "that", "this", "have", "been", "also")


def drug_names(texts: DataFrame, text: str, endings: Sequence[str] = DRUG_ENDINGS, least: int = 2, known: Sequence[str] = ()) -> DataFrame:
    """(word, times, by): words with a drug's ending found `least` times, standing before a dose, or on the
    list of `known` names (single words, found inside texts)."""
    low = F.lower(F.col(text))
    words = texts.select(F.explode(F.regexp_extract_all(low, F.lit("\\b([a-z]{4,20})\\b"), F.lit(1))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    ends = F.lit(False)
    for e in endings:
        ends = ends | (F.endswith(F.col("word"), F.lit(e)) & (F.length("word") > len(e) + 2))
    dosed = texts.select(F.explode(F.regexp_extract_all(low, F.lit("(\\b[a-z]{4,20}\\b)\\s+\\d+\\s*(?:mg|mcg|iu)\\b"), F.lit(1))).alias("word")).distinct().withColumn("dosed", F.lit(True))
    listed = F.col("word").isin(*(k.lower() for k in known)) if known else F.lit(False)
    both = counts.join(dosed, "word", "left").where((ends & (F.col("times") >= least)) | F.col("dosed") | listed)
    kind = F.when(listed, "known").when(ends & (F.col("times") >= least), "ending").otherwise("dose")
    return both.where(~F.col("word").isin(*NOT_DRUGS)).select("word", "times", kind.alias("by"))


def topics(texts: DataFrame, doc: str, text: str, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """(doc, topic): labels whose pattern a document matches, whatever the case."""
    flags = F.array_compact(F.array(*(F.when(F.col(text).rlike("(?i)" + p), F.lit(label)) for p, label in patterns)))
    return texts.select(doc, F.explode(flags).alias("topic")).distinct()


def section_words(texts: DataFrame, text: str, types: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(section_type, word, n): section words and the number of texts that hold them."""
    pairs = [(t, w) for t, ws in (types or SECTION_TYPES).items() for w in ws]
    low = F.lower(F.col(text))
    hits = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), F.struct(F.lit(t).alias("section_type"), F.lit(w).alias("word"))) for t, w in pairs)))
    return texts.select(F.inline(hits)).groupBy("section_type", "word").agg(F.count(F.lit(1)).alias("n"))


def assessment_pages(pages: DataFrame, doc: str, page: str, text: str, words: Sequence[str], least: int = 2, most: int = 50) -> DataFrame:
    """(doc, page, score): a document's first `most` pages that hold `least` of the words."""
    scored = pages.withColumn("score", score_of(F.coalesce(F.col(text), F.lit("")), words)).groupBy(doc, page).agg(F.max("score").alias("score"))
    n = F.row_number().over(Window.partitionBy(doc).orderBy(page))
    return scored.where(F.col("score") >= least).withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def sentence_words(sentence: Column) -> Column:
    """The first three words of a sentence that are longer than three letters."""
    return F.slice(F.filter(F.split(sentence, " "), lambda w: F.length(w) > 3), F.lit(1), F.lit(3))


def proposed_truth(pages: DataFrame, doc: str, page: str, text: str, words: Sequence[str], most: int = 20) -> DataFrame:
    """(doc, page, words): for each page that holds one of `words`, the first sentence of 10 to
    120 characters with it gives three distinctive words; at most `most` pages a document."""
    sentences = F.filter(F.transform(F.split(F.col(text), "[.;\\n]"), lambda s: F.trim(s)), lambda s: F.length(s).between(10, 120))

    def known(s: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(F.lower(s), F.lit(w.lower()))
        return out

    first = pages.withColumn("_s", F.get(F.filter(sentences, known), F.lit(0))).where(F.col("_s").isNotNull())
    one = first.groupBy(doc, page).agg(F.min("_s").alias("_s"))
    n = F.row_number().over(Window.partitionBy(doc).orderBy(page))
    return one.withColumn("_n", n).where(F.col("_n") <= most).select(doc, page, F.array_join(sentence_words(F.col("_s")), " ").alias("words"))


def _first_sentences(pages: DataFrame, asked: DataFrame, doc: str, page: str, order: str, text: str, plain: Sequence[str]) -> DataFrame:
    """(doc, page, rank, words): for each asked word of a page the first sentence of 11 to 119 characters that
    holds it and another telling word, longer than three letters; the word and that other one."""
    texts = pages.where(F.col(text).isNotNull()).select(doc, page, F.col(order).alias("_n"), F.posexplode(F.split(text, "[.;\\n]")).alias("_k", "_s"))
    said = texts.join(asked.select(doc, page, "rank", "word"), [doc, page]).withColumn("_s", strip(F.col("_s")))
    long = F.filter(F.split("_s", "\\s+"), lambda w: F.length(w) > 3)
    other = F.filter(F.transform(long, lambda w: F.btrim(F.lower(w), F.lit(".,;:()"))), lambda w: (w != F.col("word")) & ~w.isin(*plain))
    said = said.where(F.contains(F.lower("_s"), F.col("word")) & F.length("_s").between(11, 119) & (F.size(long) >= 2)).withColumn("_other", F.get(other, F.lit(0)))
    said = said.where(F.col("_other").isNotNull())
    return said.groupBy(doc, page, "rank").agg(F.min_by(F.array("word", "_other"), F.struct("_n", "_k")).alias("words"))


def truth_proposals(
    pages: DataFrame, tables: DataFrame, dosing: DataFrame, assessed: DataFrame, doc: str, page: str, order: str, text: str, key: str, markdown: str,
    drugs: Sequence[str], sections: dict[str, Sequence[str]] | None = None, text_pages: int = 10, table_pages: int = 8, section_pages: int = 5, most: int = 20,
) -> DataFrame:
    """(doc, page, kind, words): ground-truth items proposed from a document's own pages, at most `most` of them.

    1. Text of the first `text_pages` dosing pages: the first of `drugs` that the page holds, and another telling word of its sentence.
    2. Table of the first `table_pages` dosing pages: the first cell with a figure, of 4 to 39 characters, of the page's first table.
    3. Text of assessment pages: a section word in the same way, until `section_pages` are found.

    A page gives one item of a kind, the first. `pages` has doc, page, order, text; `tables` doc, page, key, markdown;
    `dosing` and `assessed` doc and page. The limits are the feature; all pages are looked at to apply them.
    """
    number = lambda df, *by: df.withColumn("_no", F.row_number().over(Window.partitionBy(doc).orderBy(*by)))
    listed = number(dosing.select(doc, page).distinct(), page)
    low = lambda words: [w.lower() for w in words]
    texts = pages.where(F.col(text).isNotNull())

    def held(df: DataFrame, words: Sequence[str]) -> DataFrame:
        """The first of the words that a page holds."""
        hit = F.coalesce(*(F.when(F.contains(F.lower(text), F.lit(w)), k) for k, w in enumerate(words)), F.lit(None).cast("int"))
        first = df.select(doc, page, hit.alias("_hit")).groupBy(doc, page).agg(F.min("_hit").alias("_hit")).where(F.col("_hit").isNotNull())
        return first.select(doc, page, F.get(F.array(*map(F.lit, words)), F.col("_hit")).alias("word"))

    few = texts.join(listed.where(F.col("_no") <= text_pages).select(doc, page), [doc, page], "left_semi")
    named = _first_sentences(few, held(few, low(drugs)).withColumn("rank", F.lit(0)), doc, page, order, text, PLAIN_WORDS)
    one = named.select(doc, page, F.lit("text").alias("kind"), F.lit(1).alias("_way"), "words")

    first_table = tables.join(listed.where(F.col("_no") <= table_pages).select(doc, page), [doc, page], "left_semi").groupBy(doc, page).agg(F.min_by(markdown, key).alias("_md"))
    lines = table_lines(F.col("_md"))
    cells = let(lines, lambda x: F.when(F.size(x) > 2, F.flatten(F.transform(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), tight_cells))))
    figure = F.get(F.filter(cells, lambda c: c.rlike("[0-9]") & F.length(c).between(4, 39)), F.lit(0))
    two = first_table.select(doc, page, F.lit("table").alias("kind"), F.lit(2).alias("_way"), figure.alias("_c")).where("_c is not null").select(doc, page, "kind", "_way", F.array("_c").alias("words"))

    looked = texts.join(assessed.select(doc, page).distinct(), [doc, page], "left_semi")
    asked = None
    for rank, words in enumerate((sections or SECTION_TYPES).values()):
        mine = held(looked, low(words)).withColumn("rank", F.lit(rank))
        asked = mine if asked is None else asked.unionByName(mine)
    told = _first_sentences(looked, asked, doc, page, order, text, PLAIN_WORDS_OF_SECTIONS).groupBy(doc, page).agg(F.min_by("words", "rank").alias("words"))
    three = number(told, page).where(F.col("_no") <= section_pages).select(doc, page, F.lit("text").alias("kind"), F.lit(3).alias("_way"), "words")

    every = one.unionByName(two).unionByName(three)
    kept = every.withColumn("_first", F.row_number().over(Window.partitionBy(doc, page, "kind").orderBy("_way"))).where(F.col("_first") == 1)
    return number(kept, "_way", page).where(F.col("_no") <= most).select(doc, page, "kind", "words")


def title_of(lines: Column) -> Column:
    """The first line of at least ten characters."""
    return F.get(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: F.length(x) >= 10), F.lit(0))
