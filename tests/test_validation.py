import json
import random

import pytest
from pyspark.sql import functions as F

from leafmill.config import Config, load_config
from leafmill.operators import chunks, compare, discover, lines, markdown, pages, quality, validate
from leafmill.plans import golden_queries, stages
from leafmill.sources import sinks
from leafmill.sources.tables import latest


def test_let_works_a_table_out_once_and_keeps_nulls(spark):
    rows = [(1, "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |"), (2, None), (3, ""), (4, "| a |"), (5, "x" * 100_000)]
    df = spark.createDataFrame(rows, "id int, md string")
    got = {r.id: r.t for r in df.select("id", markdown.linearised(F.col("md")).alias("t")).collect()}
    assert got[1] == "IF a is 1, THEN b is 2.\nIF a is 3" and got[2] is None and got[3] == "" and got[4] == "| a |" and got[5] == "x" * 100_000


def test_latest_delivery(spark):
    rows = [(1, "old", "2025-01-01"), (1, "new", "2025-02-01"), (2, "b", None), (2, "a", None), (None, "x", "2025-01-01")]
    df = spark.createDataFrame(rows, "id int, v string, loaded_at string")
    assert {(r.id, r.v) for r in latest(df, "id", ["id", "v"]).collect()} == {(1, "new"), (2, "b"), (None, "x")}
    assert latest(df.drop("loaded_at"), "id", ["id", "v"]).count() == 3 and latest(df.limit(0), "id", ["v", "id"]).columns == ["v", "id"]


def brute_pages(rows):
    """(number, previous, last narrative before, next, first narrative after) of each row, plainly."""
    out = {}
    for doc in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == doc), key=lambda r: ((r[1] is not None, r[1] or 0), r[2]))
        for k, r in enumerate(mine):
            told = lambda seq: next((x[2] for x in seq if x[3]), None)
            out[r[2]] = (k + 1, mine[k - 1][2] if k else None, told(reversed(mine[:k])), mine[k + 1][2] if k + 1 < len(mine) else None, told(mine[k + 1 :]))
    return out


def test_two_level_windows_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["A", "A", "B", None]), rng.choice([None, 1, 2, 3, 9]), f"k{k:03}", rng.random() < 0.4) for k in range(150)]
    df = spark.createDataFrame(rows, "doc string, page int, key string, told boolean")
    told = F.when(F.col("told"), F.col("key"))
    out = chunks.carried(chunks.numbered(df, "doc", ["page", "key"], "no"), "doc", ["page", "key"], {"b": F.col("key"), "n": told}, {"a": F.col("key"), "m": told})
    got = {r.key: (r.no, r.b, r.n, r.a, r.m) for r in out.collect()}
    assert got == brute_pages(rows)
    assert chunks.carried(df.limit(0), "doc", ["page", "key"], {"b": F.col("key")}).count() == 0


def test_hierarchy_over_pages_against_a_stack(spark):
    rng = random.Random(2)
    rows = [("d", k // 7, k, f"h{k}", rng.choice([None, 1, 2, 3, 4])) for k in range(80)]
    df = spark.createDataFrame(rows, "doc string, page int, n int, heading string, level int")
    got = {r.n: r.hierarchy for r in lines.with_hierarchy(df, "doc", ["page", "n"], depth=F.col("level")).collect()}
    stack = []
    for _, _, n, h, d in rows:
        if d is not None:
            stack = [s for s in stack if s[0] < d] + [(d, h)]
        assert got[n] == [x for _, x in stack]
    assert lines.with_hierarchy(df.limit(0), "doc", "n").count() == 0


def test_agreement_against_brute_force(spark):
    rng = random.Random(8)
    table = lambda: "\n".join("| " + " | ".join(rng.choice(["1", "2", "≥ 3", ""]) for _ in range(rng.randrange(1, 4))) + " |" for _ in range(rng.randrange(1, 4)))
    a, b = ([(k, rng.choice("xy"), table()) for k in range(12)] for _ in range(2))
    left, right = (spark.createDataFrame(t, "id int, page string, md string") for t in (a, b))
    cells = lambda md: {(i, j): c.strip().replace("≥", ">=") for i, x in enumerate(md.split("\n")) for j, c in enumerate(x.strip("|").split("|"))}
    want = {}
    for i, p, m in a:
        found = []
        for j, q, o in b:
            if p == q:
                x, y = cells(m), cells(o)
                found.append((-sum(x[k] == y[k] for k in x.keys() & y.keys()), j, len(x.keys() | y.keys())))
        if found:
            n, j, total = min(found)
            want[i] = (j, -n, total)
    best = compare.cell_agreement(left, right, ["page"], "id", "md")
    assert {r.left_key: (r.right_key, r.matches, r.total) for r in best.collect()} == want
    diff = compare.cell_differences(left, right, best, ["page"], "id", "md").groupBy("left_key").count().collect()
    by_id = {i: (dict((k, m) for k, _, m in a)[i], dict((k, m) for k, _, m in b)[want[i][0]]) for i in want}
    count = {i: sum(cells(m).get(k, "") != cells(o).get(k, "") for k in cells(m).keys() | cells(o).keys()) for i, (m, o) in by_id.items()}
    assert {r.left_key: r["count"] for r in diff} == {i: n for i, n in count.items() if n}


def test_ground_truth_in_rows_and_lists(spark, monkeypatch):
    monkeypatch.setattr(quality, "WORDS", 3)
    items = spark.createDataFrame([("a", "d", ["Fever", "cough", ""]), ("b", "d", ["none", "rash"]), ("c", "e", ["fever"]), ("f", None, ["x"]), ("g", "d", []), ("h", "d", None)], "item string, doc string, words array<string>")
    spaces = spark.createDataFrame([("d", "High FEVER"), ("d", "a cough"), ("d", None), ("d", "the rash" + "y" * 50_000), (None, "x")], "doc string, space string")
    got = {r.item: (r.found, r.missing, r.passed) for r in quality.ground_truth(items, spaces, ["doc"], "item").collect()}
    assert got == {"a": (3, 0, True), "b": (1, 1, False), "c": (0, 1, False), "f": (0, 1, False), "g": (0, 0, True), "h": (0, 0, True)}
    assert quality.ground_truth(items.limit(0), spaces, ["doc"], "item").count() == 0 and quality.ground_truth(items, spaces.limit(0), ["doc"], "item").count() == 6


def test_validators(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "doc string")
    c = spark.createDataFrame([("a", 1, "k1", 1, "Dose and contraindication"), ("a", 2, "k2", 2, None), ("b", 1, "k1", 1, "fever"), ("b", 3, "k2", 3, "x"), ("a", 1, "k0", None, "y")], "doc string, page int, k string, level int, text string")
    got = {r.doc: (r.pages, r.misnumbered, r.skipped_levels, r.confidence, r.passed) for r in validate.structure(docs, c, "doc", "page", "k").collect()}
    assert got == {"a": (2, False, 0, 0.9, True), "b": (2, True, 1, 0.7, False), "c": (0, False, 0, 0.0, False)}
    t = spark.createDataFrame([("a", 2, "dose 1 2 3"), ("a", 1, "dose"), ("a", None, "x")], "doc string, num_cols int, md string")
    e = spark.createDataFrame([("b", 2), ("c", 0)], "doc string, estimated long")
    got = {r.doc: (r.tables, r.narrow, r.few_numbers, r.confidence, r.passed) for r in validate.tables(docs, t, e, "doc", "md").collect()}
    assert got == {"a": (3, 2, 1, 0.333333, False), "b": (0, 0, 0, 0.3, False), "c": (0, 0, 0, 1.0, True)}
    s = spark.createDataFrame([("a", 0.8), ("a", 0.9)], "doc string, s double")
    assert {r.doc: (r.confidence, r.passed) for r in validate.consistency(docs, s, "doc", "s").collect()} == {"a": (0.85, False), "b": (1.0, True), "c": (1.0, True)}
    got = {r.doc: (r.missing, r.many_missing, r.confidence) for r in validate.terms(docs, c, "doc", "text", ["dose", "fever"]).collect()}
    assert got == {"a": (1, True, 0.5), "b": (1, True, 0.5), "c": (2, True, 0.0)}
    scanned = spark.createDataFrame([("a", 9), ("a", 9)], "doc string, page int")
    review = validate.human_review(docs, t, c, scanned, "doc", "page", "text", "md")
    assert {r.doc: (r.dosing_tables, r.warning_pages, r.scanned_pages, r.confidence) for r in review.collect()} == {"a": (2, 1, 1, 0.6), "b": (0, 0, 0, 1.0), "c": (0, 0, 0, 1.0)}
    whole = {r.doc: (r.confidence, r.needs_review) for r in validate.overall([validate.structure(docs, c, "doc", "page", "k"), review], "doc", review).collect()}
    assert whole == {"a": (0.75, True), "b": (0.85, False), "c": (0.5, False)}


def test_parts_and_small_images(spark):
    g = spark.createDataFrame([("a", 10), ("b", 3), ("c", None), ("d", 0)], "doc string, n int")
    got = {(r.doc, r.part): (r.first, r.last, r.offset) for r in pages.page_parts(g, "doc", "n", 4).collect()}
    assert got == {("a", 0): (1, 3, 0), ("a", 1): (4, 6, 3), ("a", 2): (7, 9, 6), ("a", 3): (10, 10, 9), ("b", 0): (1, 1, 0), ("b", 1): (2, 2, 1), ("b", 2): (3, 3, 2)}
    i = spark.createDataFrame([("d", 1, "a", 20, 20), ("d", 1, "b", 19, 21), ("d", 1, "c", 100_000, 100_000), ("d", 1, "e", None, 5)], "doc string, page int, id string, width int, height int")
    assert {(r.id, r.number) for r in pages.embedded_images(i, "doc", "page", "id").collect()} == {("a", 0), ("c", 1)}


def test_dosing_metadata_cases(spark):
    rows = [
        (1, "| Body weight (kg) | Dose (mg) of artane given twice daily for 3 days |\n|---|---|\n| < 9 | 1 |\n| 9 to < 18 | 2 |\n| ≥ 18 | 3 |"),
        (2, "| Weight | Quinol dose |\n|---|---|\n| ≥ 5 | 1 |"), (3, "| W | Abc (x) |"), (4, None), (5, ""),
    ]
    got = {r.id: r for r in chunks.dosing_metadata(spark.createDataFrame(rows, "id int, md string"), "id", "md").collect()}
    assert (got[1].drug, got[1].frequency, got[1].duration, got[1].summary, got[1].weight_min, got[1].weight_max) == ("artane", "twice daily", "3 days", "Weight-based, twice daily for 3 days", 0.0, 18.0)
    assert (got[2].drug, got[2].weight_min, got[2].weight_max, got[2].summary) == ("Quinol", 5.0, None, None)
    assert got[3].drug is None and got[4].drug is None and got[5].weight_min is None


def test_biomarkers_and_known_drugs(spark):
    df = spark.createDataFrame([(1, "Patients with G6PD deficiency need care. Clinical features: fever and chills; HIV positive patients too.")], "id int, text string")
    r = df.select(chunks.spans(F.col("text"), "populations", more=chunks.biomarker_patterns(Config(biomarkers=("G6PD",)))).alias("p"), chunks.spans(F.col("text"), "features").alias("f")).first()
    assert r.p == ["G6PD deficiency need care", "HIV positive patients too"] and r.f == ["fever and chills"]
    got = {r.word: r.by for r in discover.drug_names(df, "text", (), known=("Chills",)).collect()}
    assert got == {"chills": "known"}


def test_sinks_of_a_run(spark, tmp_path):
    df = spark.createDataFrame([("a", "text", 1), ("b", "table", 2), ("c", "table", 3)], "key string, kind string, n int")
    assert sinks.write_chunks(df, str(tmp_path / "c")) == {"text": 1, "table": 2}
    for at in ("2025-01-01", "2025-01-02", "2025-01-02"):
        sinks.write_run(df, str(tmp_path / "r"), at)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 6
    sinks.write_knowledge_base(df, df.limit(1), str(tmp_path / "kb"))
    assert spark.read.parquet(str(tmp_path / "kb" / "kb_meta")).count() == 1
    config = Config(short_name="X", drugs=("a",), dose_ranges={"a": (1.0, 2.0)}, conditions=(("p", "q"),), section_words={"s": ("w",)})
    sinks.write_config(config, tmp_path / "config.json")
    assert load_config(tmp_path / "config.json") == config and json.loads((tmp_path / "config.json").read_text())["short_name"] == "X"
    sinks.markdown_report("Run", [("Rows", df)], tmp_path / "r.md")
    assert "| a | text | 1 |" in (tmp_path / "r.md").read_text()
    with pytest.raises(ValueError, match="more than"):
        sinks.markdown_report("Run", [("Rows", df)], tmp_path / "r.md", most=2)


def test_stages_reuse_what_is_there(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "id int")
    df.write.parquet(str(tmp_path / "in" / "t.parquet"))
    queries = {"one": lambda s, f: s.read.parquet(f"{f}/t.parquet")}
    run = lambda config: stages.run_stages(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["t"], config, {"first": ("one",)}, queries)
    assert [r.reused for r in run(Config()).collect()] == [False] and [r.reused for r in run(Config()).collect()] == [True]
    assert [r.reused for r in run(Config(title="other")).collect()] == [False]
    card = stages.scorecard(run(Config()), 0).first()
    assert card.stage == "first" and card.per_page is None


def test_golden_tables(spark):
    got = {n: q(spark, "").collect() for n, q in golden_queries.QUERIES.items() if n in ("golden_lines", "golden_breaks", "golden_hierarchy")}
    assert {r.text for r in got["golden_lines"]} >= {"The dose is given", "WorldAgain"}
    assert {(r.upper_id, r.lower_id) for r in got["golden_breaks"]} == {(1, 2), (3, 4)}
    assert {r.n: r.path for r in got["golden_hierarchy"]}[7] == "2 Cough > 2.1 Less deep"


def test_truth_proposals(spark):
    page_rows = [
        ("d", 1, "c1", "Nothing here. Short dose."), ("d", 1, "c2", "Give artane with water to the child; artane tablets are kept dry."), ("d", 2, "c3", "The quinol syrup"),
        ("d", 3, "c4", "Danger signs include fits and fever.\nManagement begins at home"), ("d", 3, "c5", None), ("e", 1, "c6", "x" * 90_000),
    ]
    chunk = spark.createDataFrame(page_rows, "doc string, page int, c string, text string")
    t = spark.createDataFrame([("d", 1, 2, "| a | b |\n|---|---|\n| x | 12 mg daily |"), ("d", 1, 1, "| a |\n|---|\n| 5 |\n| 7 to 9 kg |"), ("d", 2, 3, "| only 1234 |"), ("d", 2, 4, None)], "doc string, page int, id int, md string")
    dosing = spark.createDataFrame([("d", 1), ("d", 2), ("e", 1)], "doc string, page int")
    assessed = spark.createDataFrame([("d", 3), ("d", 1)], "doc string, page int")
    got = discover.truth_proposals(chunk, t, dosing, assessed, "doc", "page", "c", "text", "id", "md", ("Quinol", "Artane")).collect()
    assert {(r.doc, r.page, r.kind, tuple(r.words)) for r in got} == {("d", 1, "text", ("artane", "give")), ("d", 1, "table", ("7 to 9 kg",)), ("d", 2, "text", ("quinol", "syrup")), ("d", 3, "text", ("management", "begins"))}
    none = discover.truth_proposals(chunk.limit(0), t.limit(0), dosing.limit(0), assessed.limit(0), "doc", "page", "c", "text", "id", "md", ("a",))
    assert none.count() == 0
