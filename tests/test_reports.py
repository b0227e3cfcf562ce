from pyspark.sql import functions as F

from leafmill.config import Config
from leafmill.operators import reports

DHA = "|Body weight (kg)|Dose (mg)|\n|---|---|\n" + "\n".join(f"|{w}|{d}|" for w, d in [("< 8", "20"), ("8 to < 11", "30"), ("11 to < 36", "25"), ("36 to < 60", "120"), ("60 < 80", "160"), (">80", "200")])


def test_first_checks_read_a_bare_pair_as_an_upper_bound(spark):
    df = spark.createDataFrame([(1, DHA), (2, "|A|B|\n|---|---|\n|1|2|"), (3, None)], "id int, md string")
    assert [(r.id, r.gaps, r.drops) for r in reports.first_checks(df, "id", "md").collect()] == [(1, 2, 1)]


def test_small_rules(spark):
    df = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("{\"a\": 2}",), ("none",)], "t string")
    assert [r[0].a if r[0] else None for r in df.select(reports.fenced_json(F.col("t"), "a int")).collect()] == [1, 2, None]
    names = spark.createDataFrame([("Practical handbook for fever",), ("Two words",), (None,)], "t string")
    assert [r[0] for r in names.select(reports.short_name(F.col("t"))).collect()] == ["Practi-handbo-for", "Two-words", None]
    heads = spark.sql("select array('Treating fever', 'Severe fever', 'Remark') as h union all select array()")
    got = [r[0] for r in heads.select(reports.condition_of(F.col("h"), [("severe", "Severe"), ("fever", "Fever")])).collect()]
    assert got == ["Severe", None]
    pages = spark.sql("select 10.0 as s, 0 as n union all select 10.0, 5")
    assert [r[0] for r in pages.select(reports.seconds_per_page(F.col("s"), F.col("n"))).collect()] == [None, 2]


def test_tables_and_chunks(spark):
    c = spark.createDataFrame([("c1", "d", 1), ("c2", "d", 1)], "chunk_id string, doc_id string, page int")
    t = spark.createDataFrame([(7, "d", 1, 3), (8, "d", 2, 3), (9, "d", 3, 1)], "id int, doc_id string, page int, num_rows int")
    assert {(r.chunk_id, r.tables) for r in reports.tables_of_chunks(c, t, ["doc_id", "page"], "chunk_id", "id").collect()} == {("c1", "7"), ("c2", "7")}
    assert [r.id for r in reports.tables_without_chunk(t, c, ["doc_id", "page"]).collect()] == [8]


def test_consistency_and_config(spark):
    s = spark.createDataFrame([("a", 0.95), ("b", 0.5), ("c", None)], "doc string, score double")
    assert {r.doc: (r.confidence, r.passed) for r in reports.consistency(s, "doc", "score").collect()} == {"a": (0.95, True), "b": (0.5, False), "c": (1.0, True)}
    c = reports.proposed_config(Config(drugs=("x",)), ["y", "x"], {"referral": ["refer to"]}, ["HC2"])
    assert c.drugs == ("x", "y") and c.clinical_words[-1] == "stabilise" and "refer to" in c.clinical_words
