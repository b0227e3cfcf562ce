"""Documents as numbered lines: sections, heading hierarchy, elements, pages, packing.

Every window is partitioned by document and ordered by line number. Null texts have no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import strip, token_estimate
from leafmill.operators.chunks import carried

# Page footer, image mark, and headings that name no domain.
FOOTER = "^(\\d+) of \\d+$"
IMAGE_MARK = "<!-- image -->"
STRUCTURAL_HEADINGS = (
    "(?i)^(?:(?:Strong|Conditional)\\s+recommendation|Remark|Practice\\s+Statement|Additional\\s+comments|Rationale|Key\\s+info"
    "|\\*?Not\\s+evaluated|Sections$|Contact$|Sponsors|Disclaimer|©)"
)
MAX_TOKENS, MIN_TOKENS = 1500, 200


def document_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line), from 0."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def _order(key: str) -> Window:
    return Window.partitionBy(key).orderBy("line_no")


def with_pages(lines: DataFrame, key: str, footer: str = FOOTER) -> DataFrame:
    """`lines` with `page`: that of the last footer up to the line; before the first footer, the
    first footer's; null without footers."""
    mark = F.when(F.col("line").rlike(footer), F.regexp_extract("line", footer, 1).try_cast("int"))
    marked = lines.withColumn("_mark", mark)
    before = F.last("_mark", ignorenulls=True).over(_order(key).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_mark", ignorenulls=True).over(_order(key).rowsBetween(0, Window.unboundedFollowing))
    return marked.withColumn("page", F.coalesce(before, after)).drop("_mark")


def with_sections(lines: DataFrame, key: str, heading: str = "## ") -> DataFrame:
    """`lines` with `section_no` (0 before the first heading) and `is_heading`."""
    marked = lines.withColumn("is_heading", F.startswith(F.col("line"), F.lit(heading)))
    number = F.sum(F.col("is_heading").cast("int")).over(_order(key).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("section_no", number)


def section_number(heading: Column) -> Column:
    """The number before a heading's title, null without one."""
    pattern = "^(\\d+(?:\\.\\d+)*)\\s+(.*)"
    return F.when(heading.rlike(pattern), F.regexp_extract(heading, pattern, 1))


def section_title(heading: Column) -> Column:
    pattern = "^(\\d+(?:\\.\\d+)*)\\s+(.*)"
    return F.when(heading.rlike(pattern), F.regexp_extract(heading, pattern, 2)).otherwise(heading)


def section_table(lines: DataFrame, key: str) -> DataFrame:
    """(key, section_no, heading, number, title, first_line, n_lines): one row per section."""
    s = with_sections(lines, key)
    head = F.max(F.when(F.col("is_heading"), strip(F.substring(F.col("line"), 4, 1_000_000))))
    out = s.groupBy(key, "section_no").agg(head.alias("heading"), F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"))
    return out.withColumn("number", section_number(F.col("heading"))).withColumn("title", section_title(F.col("heading")))


def with_hierarchy(sections: DataFrame, key: str, order: str | list[str], heading: str = "heading", depth: Column | None = None) -> DataFrame:
    """`sections` with `hierarchy`: the open headings from the outermost to the own.

    A heading with a depth closes all of its depth or deeper; one without inherits. `depth` is a
    column, by default the number of parts of the heading's number. For each depth the last heading
    up to the row is carried along; it is open if none of a smaller depth came after it. The
    number of depths is asked for first, so rows hold no more than one heading a depth.
    """
    if depth is None:
        number = section_number(F.col(heading))
        depth = F.when(number.isNotNull(), F.size(F.split(number, "\\.")))
    told = sections.withColumn("_depth", depth)
    deepest = told.agg(F.max("_depth")).first()[0] or 0
    order = [order] if isinstance(order, str) else order
    place = F.struct(*(F.struct(F.col(c).isNotNull(), F.col(c)) for c in order))
    last = {f"_open{d}": F.when(F.col("_depth") == d, F.struct(place.alias("at"), F.col(heading).alias("h"))) for d in range(1, deepest + 1)}
    told = carried(told, key, order, last, own=True) if last else told
    stack = []
    for d in range(1, deepest + 1):
        still = F.col(f"_open{d}.at").isNotNull()
        for smaller in range(1, d):
            still &= F.coalesce(F.col(f"_open{smaller}.at") < F.col(f"_open{d}.at"), F.lit(True))
        stack.append(F.when(still, F.col(f"_open{d}.h")))
    hierarchy = F.array_compact(F.array(*stack)) if stack else F.array().cast("array<string>")
    return told.withColumn("hierarchy", hierarchy).drop("_depth", *(f"_open{d}" for d in range(1, deepest + 1)))


def clinical_domain(hierarchy: Column) -> Column:
    """The deepest heading that isn't structural, without its number."""
    good = F.filter(F.reverse(F.transform(hierarchy, section_title)), lambda h: ~h.rlike(STRUCTURAL_HEADINGS))
    return F.get(good, F.lit(0))


def with_elements(lines: DataFrame, key: str, footer: str = FOOTER) -> DataFrame:
    """`lines` (with section_no, is_heading) with `kind` and `element_no` in the section.

    Footers and headings go first; then runs of table lines or of other lines are elements, and
    each image mark is its own. Blank lines belong to the run they stand in.
    """
    body = lines.where(~F.col("is_heading") & ~F.col("line").rlike(footer))
    kind = F.when(F.startswith(F.ltrim("line"), F.lit("|")), "table").when(strip(F.col("line")) == IMAGE_MARK, "image").otherwise("narrative")
    w = Window.partitionBy(key, "section_no").orderBy("line_no")
    body = body.withColumn("kind", kind)
    start = F.lag("kind").over(w).isNull() | (F.lag("kind").over(w) != F.col("kind")) | (F.col("kind") == "image")
    return body.withColumn("_start", start.cast("int")).withColumn("element_no", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def packed(text: Column, max_tokens: int = MAX_TOKENS, min_tokens: int = MIN_TOKENS) -> Column:
    """Paragraphs packed in order into pieces of at most `max_tokens`; a last piece under
    `min_tokens` joins the one before. Texts within the limit come out whole, and a single
    longer paragraph stays whole. Null for null."""
    paras = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    state = "struct<done array<string>, now array<string>, tokens int>"
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("tokens")).cast(state)

    def step(acc: Column, p: Column) -> Column:
        t = token_estimate(p)
        full = (acc["tokens"] + t > max_tokens) & (F.size(acc["now"]) > 0)
        closed = F.concat(acc["done"], F.array(F.array_join(acc["now"], "\n\n")))
        return F.when(full, F.struct(closed.alias("done"), F.array(p).alias("now"), t.alias("tokens"))).otherwise(
            F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.array(p)).alias("now"), (acc["tokens"] + t).alias("tokens"))
        )

    def close(acc: Column) -> Column:
        tail = F.array_join(acc["now"], "\n\n")
        n = F.size(acc["done"])
        merged = F.concat(F.slice(acc["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.get(acc["done"], n - 1), F.lit("\n\n"), tail)))
        return F.when((n > 0) & (acc["tokens"] < min_tokens), merged).otherwise(F.concat(acc["done"], F.array(tail)))

    folded = F.aggregate(paras, zero, step, close)
    return F.when(text.isNull(), None).when(token_estimate(text) <= max_tokens, F.array(text)).otherwise(folded)
