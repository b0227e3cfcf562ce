import random

from pyspark.sql import functions as F

from leafmill.config import Config
from leafmill.operators import chunks, discover, lines, quality, retrieval
from leafmill.plans import text_queries

MINI = "Intro text\n1 of 3\n## 1 Alpha\nPara one.\n\n| A | B |\n|---|---|\n2 of 3\n| 1 | 2 |\nAfter table\n<!-- image -->\n## 1.1 Beta\n<!-- image -->\n<!-- image -->\n## Remark\nRefer immediately if worse.\n3 of 3\n## 2 Gamma\nEnd."


def mini(spark):
    return lines.document_lines(spark.createDataFrame([("d", MINI), ("n", None)], "doc string, text string"), "doc", "text")


def test_pages_are_as_of_the_last_footer(spark):
    got = {r.line_no: r.page for r in lines.with_pages(mini(spark), "doc").collect()}
    assert [got[i] for i in (0, 1, 3, 6, 7, 9, 15, 16, 18)] == [1, 1, 1, 1, 2, 2, 2, 3, 3]


def test_elements_of_the_mini_document(spark):
    s = lines.with_sections(mini(spark), "doc")
    e = lines.with_elements(s, "doc").where(F.trim("line") != "")
    got = e.groupBy("section_no", "element_no").agg(F.min("kind").alias("kind"), F.array_sort(F.collect_list("line_no")).alias("ls")).collect()
    assert sorted((min(r.ls), r.kind, r.ls) for r in got) == [(0, "narrative", [0]), (3, "narrative", [3]), (5, "table", [5, 6, 8]), (9, "narrative", [9]), (10, "image", [10]), (12, "image", [12]), (13, "image", [13]), (15, "narrative", [15]), (18, "narrative", [18])]


def test_hierarchy_stack(spark):
    heads = ["1 a", "1.1 b", "1.1.1 c", "2 d", "2.1.1 e", "2.1 f", "Remark"]
    df = spark.createDataFrame([("d", i, h) for i, h in enumerate(heads)], "doc string, n int, heading string")
    got = lines.with_hierarchy(df, "doc", "n").withColumn("domain", lines.clinical_domain(F.col("hierarchy"))).orderBy("n").collect()
    assert [r.hierarchy for r in got] == [["1 a"], ["1 a", "1.1 b"], ["1 a", "1.1 b", "1.1.1 c"], ["2 d"], ["2 d", "2.1.1 e"], ["2 d", "2.1 f"], ["2 d", "2.1 f"]]
    assert [r.domain for r in got] == ["a", "b", "c", "d", "e", "f", "f"]


def pack(text, most, least):
    """The packing rule, plainly."""
    tok = lambda t: int(len(t.split()) * 1.3)
    if tok(text) <= most:
        return [text]
    out, now, n = [], [], 0
    for p in [p.strip() for p in text.split("\n\n") if p.strip()]:
        if n + tok(p) > most and now:
            out.append("\n\n".join(now))
            now, n = [], 0
        now.append(p)
        n += tok(p)
    tail = "\n\n".join(now)
    if out and n < least:
        out[-1] += "\n\n" + tail
    else:
        out.append(tail)
    return out


def test_packing_against_the_plain_rule(spark):
    rng = random.Random(3)
    texts = ["\n\n".join(" ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["", "a b c d e\n\nf g h\n\ni j k l\n\nm"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.p for r in df.select("i", lines.packed(F.col("t"), 10, 3).alias("p")).collect()}
    assert [(t, got[i], pack(t, 10, 3)) for i, t in enumerate(texts) if got[i] != pack(t, 10, 3)] == []
    assert spark.createDataFrame([(None,)], "t string").select(lines.packed(F.col("t"))).first()[0] is None


def test_greedy_match(spark):
    inv = spark.createDataFrame([("d", 5, i) for i in (10, 11, 12, 13)] + [("e", 5, i) for i in (10, 11, 12)], "doc_id string, page int, table_index long")
    els = spark.createDataFrame([("d", i, 5) for i in range(4)] + [("e", i, 5) for i in range(3)] + [("f", 0, 1), ("e", 9, None)], "doc_id string, element_no long, page int")
    got = {(r.doc_id, r.element_no): r.table_index for r in chunks.greedy_match(els, inv).collect()}
    assert [got["d", i] for i in range(4)] == [10, 12, 13, 11] and [got["e", i] for i in range(3)] == [10, 12, 11]
    assert got["f", 0] is None and got["e", 9] is None


def test_links(spark):
    rows = [("d", 1, "n1", "narrative"), ("d", 2, "t1", "table"), ("d", 3, "i1", "image"), ("d", 4, "n2", "narrative")]
    df = spark.createDataFrame(rows, "doc string, n int, id string, kind string")
    out = chunks.linked(df, "doc", "n", "id", F.col("kind") == "narrative")
    assert [(r.id, r.previous, r.next, r.narrative_before, r.narrative_after) for r in out.orderBy("n").collect()] == [("n1", None, "t1", None, None), ("t1", "n1", "i1", "n1", "n2"), ("i1", "t1", "n2", "n1", "n2"), ("n2", "i1", None, None, None)]
    assert [tuple(r) for r in chunks.dependents(out, "id").collect()] == [("n1", "i1,t1")]


def test_metadata_and_care_levels(spark):
    text = "Children under 5 years weighing less than 12 kg take it twice daily for 3 days. Contraindicated in epilepsy; not recommended for infants. Danger signs: coma, shock. Ages 6 to 12 months."
    r = spark.createDataFrame([(text,)], "t string").select(*chunks.clinical_metadata(F.col("t"))).first()
    assert (r.age_under, r.age_from, r.age_to, r.weight_max, r.weight_min, r.frequency, r.duration) == ("5 years", "6", "12", 12.0, None, "twice daily", "3 days")
    assert r.contraindications == "epilepsy # infants" and r.danger_signs == "coma, shock"
    c = Config(care_levels=("HC II", "HC III", "HC IV", "hospital"))
    df = spark.createDataFrame([("HC III or HC IV, HC II; hospital",), (None,)], "t string")
    assert [x[0] for x in df.select(chunks.care_levels(F.col("t"), c)).collect()] == [["HC2", "HC3", "HC4", "HOSPITAL"], []]


def test_bm25(spark):
    texts = ["severe malaria malaria dose", "malaria fever", "fever cough", "cough rash", "rash itch dose"]
    c = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, term string")
    q = spark.createDataFrame([(1, "malaria dose"), (2, "itch itch"), (3, "zzz"), (4, None)], "q int, question string")
    s = retrieval.bm25(q, "q", "question", c, "id", "text")
    got = {(r.q, r.id): round(r.score, 6) for r in s.collect()}
    assert got == {(1, 0): 0.6806, (1, 1): 0.375463, (1, 4): 0.314686, (2, 4): 2.054958}
    assert [(r.q, r.id) for r in retrieval.top_hits(s, "q", "id", 1).orderBy("q").collect()] == [(1, 0), (2, 4)]


def test_response_checks(spark):
    full = "Triage Level: {}\nImmediate Actions: x\nNext Steps / Monitoring: x\nWhen to Refer: x\nCitations: Page 12, p. 7, step 3"
    rows = [("a", full.format("GREEN")), ("convulsions", full.format("GREEN")), ("convulsions", full.format("🔴 RED")), ("a", full.format("🟡 YELLOW")), ("a", full.format("RED") + " give the child aspirin, child"), ("a", "nothing")]
    df = spark.createDataFrame(rows, "q string, r string")
    got = df.select(*retrieval.response_checks(df, "q", "r"), F.array_sort(retrieval.citations(F.col("r"))).alias("c")).collect()
    assert [r.passed for r in got] == [True, False, True, True, False, False]
    assert got[3].triage is None and got[5].missing_sections == 5 and got[0].c == [3, 7, 12]


def test_quality_rules(spark):
    assert quality.indel_ratio("", "") == 1.0 and quality.indel_ratio("abc", "abd") == 4 / 6 and quality.indel_ratio("a", "") == 0.0
    df = spark.createDataFrame([(1, "kitten", "sitting"), (2, None, "")], "k int, x string, y string")
    got = {r.k: r.similarity for r in quality.text_similarity(df, "k", "x", "y").collect()}
    assert got == {1: 8 / 13, 2: 1.0}
    stages = spark.createDataFrame([("d", x) for x in (0.7, 1.0, 0.8272014394, 1.0, 0.0)] + [("e", x) for x in (0.7, 1.0, 0.9081618439, 1.0, 0.0)], "doc string, confidence double")
    assert {r.doc: (round(r.confidence, 5), r.passed) for r in quality.overall(stages, "doc").collect()} == {"d": (0.70544, False), "e": (0.72163, False)}
    truth = spark.createDataFrame([(i, i < 15) for i in range(16)], "i int, passed boolean")
    assert quality.accuracy(truth).first()[2] == 93.8
    assert quality.accuracy(truth.limit(0)).first()[2] == 0.0


def test_drug_discovery(spark):
    df = spark.createDataFrame([("Give amoxicillin 250 mg. amoxicillin again. Take aspirin 75 mg. dose 5 mg. onecillin",), (None,)], "t string")
    assert {(r.word, r.by) for r in discover.drug_names(df, "t").collect()} == {("amoxicillin", "ending"), ("aspirin", "dose")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "chunk_id string, doc_id string, page int, level int, text string")
    assert quality.structure_check(none, "doc_id", ["page"]).count() == 0
    assert retrieval.bm25(none, "chunk_id", "text", none, "doc_id", "text").count() == 0
    assert lines.section_table(lines.document_lines(none, "doc_id", "text"), "doc_id").count() == 0


def page_folder(spark, at, chunk=(), images=(), readings=()):
    """A data folder: chunks (id, page, text), images (id, page), readings (id, engine, page, index, markdown)."""
    at = str(at)
    spark.createDataFrame([(i, "g", p, t) for i, p, t in chunk], "chunk_id string, doc_id string, page int, text string").selectExpr("*", "'h' as heading", "1 as level", "false as has_tables", "'f' as is_table_only").write.parquet(f"{at}/chunk.parquet")
    spark.createDataFrame([(i, "g", p) for i, p in images], "image_id string, doc_id string, page_no int").selectExpr("*", "1 as image_index", "'c' as caption", "'o' as ocr_text", "100 as width", "100 as height", "cast(null as string) as error").write.parquet(f"{at}/images.parquet")
    r = spark.createDataFrame([(i, "g", *x) for i, *x in readings], "report_id long, doc_id string, engine string, page int, table_index_on_page int, markdown string")
    r.selectExpr("*", "'x' as classification", "1 as num_rows", "1 as num_cols", "'b' as bbox", "cast(null as string) as error").write.parquet(f"{at}/cross_validation_report.parquet")
    return at


def test_document_profile_sees_every_page(spark, tmp_path):
    # page 1: two chunks of 60; 2: an image alone; 3: a table alone; 4: null text; 21: beyond the first pages
    chunk = [("c1", 1, "a" * 60), ("c2", 1, "b" * 60), ("c4", 4, None), ("c5", 21, "x"), ("c1", 1, "a" * 60)]
    folder = page_folder(spark, tmp_path / "a", chunk, [("i1", 1)], [(1, "docling", 3, 0, "|a|"), (2, "pymupdf", 3, 0, "|a|")])
    assert [tuple(r) for r in text_queries.document_profile(spark, folder).collect()] == [("g", 3, 1, 1, False)]
    folder = page_folder(spark, tmp_path / "b", chunk, [("i1", 1), ("i2", 2), ("i3", 2)])
    assert [tuple(r) for r in text_queries.document_profile(spark, folder).collect()] == [("g", 3, 0, 2, True)]


def test_page_similarity_compares_all_readings(spark, tmp_path):
    rows = [(1, "docling", 1, 1, "bb"), (2, "docling", 1, 0, "zz"), (3, "pymupdf", 1, 0, "zz"), (4, "pymupdf", 1, 1, "cc"), (5, "pymupdf", 2, 0, "a")]
    rows += [(12, "docling", 3, 0, "q"), (9, "docling", 3, 0, "p"), (20, "pymupdf", 3, 0, "p"), (21, "pymupdf", 3, 0, "q"), (21, "pymupdf", 3, 0, "q")]
    folder = page_folder(spark, tmp_path, readings=rows)
    assert {r.page_key: r.similarity for r in text_queries.page_similarity(spark, folder).collect()} == {"g/1": 6 / 10, "g/3": 1.0}


def test_accuracy_counts_each_ground_truth_once(spark, monkeypatch):
    from leafmill.plans import document_queries

    first = spark.createDataFrame([("a", "text", True), ("b", "text", False), ("c", "image", True), ("d", "table", False)], "item string, kind string, passed boolean")
    again = spark.createDataFrame([("d", True), ("e", False), ("f", True)], "item string, passed boolean")
    monkeypatch.setattr(document_queries, "ground_truth_kinds", lambda *_: first)
    monkeypatch.setattr(document_queries, "truth_recheck", lambda *_: again)
    out = document_queries.accuracy_kinds(spark, "")
    want = {"text": (2, 1, 50.0), "image": (1, 1, 100.0), "table": (1, 0, 0.0), "table again": (3, 2, 66.7), "combined": (6, 4, 66.7)}
    assert {r.kind: (r["items"], r.passed, r.accuracy) for r in out.collect()} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
