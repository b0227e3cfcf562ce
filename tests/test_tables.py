import pytest
from pyspark.sql import functions as F

from leafmill.config import Config, any_pattern, load_config
from leafmill.functions import bands
from leafmill.functions.text import audit_hash, signature, token_estimate
from leafmill.operators import classify, compare, dosing, markdown

S1 = "| Body weight (kg) | Dose (mg) of artemether + lumefantrine given twice daily for 3 days |\n|---|---|\n| < 15 | 20 + 120 |\n| 15 to < 25 | 40 + 240 |\n| 25 to < 35 | 60 + 360 |\n| ≥ 35 | 80 + 480 |"
DHA = "|Body weight (kg)|Dose (mg) given daily|\n|---|---|\n" + "\n".join(f"|{w}|{d}|" for w, d in [("< 8", "20 + 160"), ("8 to < 11", "30 + 240"), ("11 to < 17", "40 + 320"), ("17 to < 25", "60 + 480"), ("25 to < 36", "80 + 640"), ("36 to < 60", "120 + 960"), ("60 < 80", "160 + 1280"), (">80", "200 + 1600")])
PRIMAQUINE = "|Body weight (kg)|Single dose of primaquine (mg base)|\n|---|---|\n|5 to < 25a|3.75|\n|25 to < 50|7.5|\n|50 to 100|15|"
RANGES = {"artemether": (1.0, 5.0), "lumefantrine": (5.0, 30.0), "primaquine": (0.05, 1.0)}

# cell: strict, first, loose (low, high); None for no band
BANDS = {
    "< 15": ((0, 15), (0, 15), (0, 15)),
    "15 to < 25": ((15, 25), (15, 25), (15, 25)),
    "≥ 35": ((35, None), (35, None), (35, None)),
    "60 < 80": ((60, 80), (0, 60), (60, 80)),
    ">80": ((80, None), (80, None), (80, None)),
    "> 10 to ≤ 20": ((10, 20), (10, None), (10, 20)),
    "50 to 100": (None, (50, 100), (50, 100)),
    "5 - 10": (None, (5, 10), (5, 10)),
    "5 to < 25 a": ((5, 25), (5, 25), (5, 25)),
    "5–<15": ((5, 15), (5, 15), (5, 15)),
    "≤ 20": ((0, 20), (0, 20), None),
    "10 kg": (None, None, None),
    "adult": (None, None, None),
    "": (None, None, None),
}


def test_three_band_parsers(spark):
    c = F.col("c")
    out = spark.createDataFrame([(k,) for k in BANDS], "c string").select(c, bands.band_strict(c).alias("a"), bands.band_first(c).alias("b"), bands.band_loose(c).alias("d"))
    got = {r.c: tuple(None if x is None else (x.low, x.high) for x in (r.a, r.b, r.d)) for r in out.collect()}
    assert got == BANDS


def test_unreadable_numbers_and_nulls_are_null(spark):
    c = F.col("c")
    rows = spark.createDataFrame([("< 1.2.3",), (None,)], "c string").select(bands.band_strict(c).alias("a"), bands.dose_values(c).alias("v")).collect()
    assert rows[0].a.high is None and rows[1].a is None and rows[1].v == []


@pytest.mark.parametrize(("cell", "values"), [("20 + 120", [20, 120]), ("250 / 12.5", [250, 12.5]), ("25 mg", [25]), ("3.75", [3.75]), ("", [])])
def test_dose_values(spark, cell, values):
    assert spark.createDataFrame([(cell,)], "c string").select(bands.dose_values(F.col("c"))).first()[0] == values


def checks(spark, *tables):
    df = spark.createDataFrame(list(enumerate(tables)), "id int, md string")
    return {r.id: r for r in dosing.dosing_checks(df, "id", "md", RANGES).collect()}


def test_golden_dosing_tables(spark):
    got = checks(spark, S1, DHA, PRIMAQUINE, None, "", "| A | B |\n|---|---|\n| 1 | 2 |")
    assert (got[0].passed, got[0].bands) == (True, 4)
    assert (got[1].contiguity, got[1].bands) == (0, 8)
    assert (got[2].bands, got[2].coverage) == (2, 0)
    assert set(got) == {0, 1, 2, 5} and got[5].parsed is False


def test_each_check_finds_its_fault(spark):
    gap = S1.replace("15 to < 25", "18 to < 25")
    drop = S1.replace("60 + 360", "60 + 200")
    late = S1.replace("| < 15 | 20 + 120 |\n", "")
    high = S1.replace("80 + 480", "8000 + 48000")
    zero = S1.replace("20 + 120", "0 + 120")
    got = checks(spark, gap, drop, late, high, zero)
    assert got[0].contiguity == 1 and got[1].monotonic == 1 and got[1].ratio == 1 and got[2].coverage == 1
    assert got[3].bounds == 2 and got[4].positive == 1


def test_linearise(spark):
    md = F.col("md")
    rows = [(S1,), ("|A|\n|---|\n|x|",), ("|A|B|\n|---|---|",), ("",), (None,), ("|A|B|\n|---|---|\n||v|",)]
    got = [r[0] for r in spark.createDataFrame(rows, "md string").select(markdown.linearised(md)).collect()]
    assert got[0].split("\n")[0] == "IF Body weight (kg) is < 15, THEN Dose (mg) of artemether + lumefantrine given twice daily for 3 days is 20 + 120."
    assert got[1:] == ["IF A is x", "|A|B|\n|---|---|", "", None, "IF A is v"]


def test_cells_with_and_without_empty_ones(spark):
    df = spark.createDataFrame([(1, "|A||B|\n|---|---|---|\n|1||3|")], "id int, md string")
    tight = [r.cell for r in markdown.table_cells(df, "id", "md").orderBy("row_no", "col_no").collect()]
    wide = [r.cell for r in markdown.table_cells(df, "id", "md", keep_empty=True).orderBy("row_no", "col_no").collect()]
    assert tight == ["A", "B", "1", "3"] and wide == ["A", "", "B", "1", "", "3"]


def test_markdown_of(spark):
    df = spark.sql("select array('a', 'b') as h, array(array('1', null), array('2', '3')) as r")
    assert df.select(markdown.markdown_of(F.col("h"), F.col("r"))).first()[0] == "| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |"


def test_classes(spark):
    c = Config(drugs=("artemether",))
    rows = [(S1, "dosing"), ("quality of evidence, relative effect", "evidence"), ("danger sign", "clinical_management"), ("danger sign in kg", "other"), ("nothing", "other"), (None, None)]
    df = spark.createDataFrame(rows, "md string, want string")
    assert [(r.got, r.want) for r in df.select("want", classify.table_class(F.col("md"), c).alias("got")).collect() if r.got != r.want] == []


def test_refined_class(spark):
    rows = [(S1, "dosing"), ("|A|B|\n|---|---|\n|x|250 mg|", "dosing (no weight bands)"), ("|A|B|\n|---|---|\n|x|y|", "structural")]
    df = spark.createDataFrame(rows, "md string, want string")
    assert [(r.got, r.want) for r in df.select("want", classify.refined_class(F.col("md"), F.lit("dosing")).alias("got")).collect() if r.got != r.want] == []


def test_cell_agreement_and_differences(spark):
    a = spark.createDataFrame([(1, 178, PRIMAQUINE.replace("25a", "25 a"))], "id int, page int, md string")
    b = spark.createDataFrame([(8, 178, "|x|y|\n|---|---|\n|1|2|"), (9, 178, PRIMAQUINE)], "id int, page int, md string")
    best = compare.cell_agreement(a, b, ["page"], "id", "md")
    assert [(r.left_key, r.right_key, r.matches, r.total, r.agreement) for r in best.collect()] == [(1, 9, 7, 8, 87.5)]
    assert [(r.left_cell, r.right_cell) for r in compare.cell_differences(a, b, best, ["page"], "id", "md").collect()] == [("5 to < 25 a", "5 to < 25a")]


def test_page_break_stitching(spark):
    top = "|Body weight (kg)|Dose given twice daily for<br>3 days|\n|---|---|\n|< 15|20 + 120|\n|15 to < 25|40 + 240|\n|25 to < 35|60 + 360|"
    rest = "|≥ 35|80 + 480|\n|---|---|"
    rows = [("D", "e", 173, 1, 2, [50.0, 706.1, 500.0, 801.2], top), ("D", "e", 174, 2, 2, [50.0, 67.9, 500.0, 88.4], rest), ("D", "e", 174, 3, 2, None, rest)]
    t = spark.createDataFrame(rows, "doc_id string, engine string, page int, id int, num_cols int, bbox array<double>, md string")
    pairs = compare.page_break_pairs(t)
    assert [(r.upper_id, r.lower_id) for r in pairs.collect()] == [(1, 2)]
    cells = compare.stitched_rows(pairs, t, "id", "md").orderBy("row_no", "col_no").collect()
    assert [c.cell for c in cells if c.row_no == 0] == ["Body weight (kg)", "Dose given twice daily for 3 days"]
    assert [c.cell for c in cells if c.row_no == 4] == ["≥ 35", "80 + 480"]


def test_hashes(spark):
    df = spark.createDataFrame([("abc", "A", "B", "c1", "h", "t")], "c string, a string, b string, d string, e string, f string")
    r = df.select(audit_hash(F.col("c")), signature(*(F.col(x) for x in "abdef"))).first()
    assert r[0].startswith("ba7816bf8f01cfea") and r[1].startswith("d0abdcdd5623b8b6")


def test_token_estimate(spark):
    assert spark.createDataFrame([("a b  c d e",)], "t string").select(token_estimate(F.col("t"))).first()[0] == 6


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"drugs": ["x"], "dose_ranges": {"x": [1, 2]}}')
    c = load_config(tmp_path / "c.json")
    assert c.table_words[-1] == "x" and c.dose_ranges["x"] == (1, 2)
    (tmp_path / "c.json").write_text('{"drug": []}')
    with pytest.raises(ValueError, match="unknown"):
        load_config(tmp_path / "c.json")
    assert any_pattern(()) is None and any_pattern(("HC II", "HC III")) == "(?i)(HC\\ III|HC\\ II)"


def test_stitching_reads_only_divided_tables(spark):
    pairs = spark.createDataFrame([(1, 2)], "upper_id long, lower_id long")
    tables = spark.createDataFrame([(1, "| a | b |\n|---|---|\n| 1 | |"), (2, "| a | b |\n| 2 | 3 |"), (3, "| a |")], "id long, md string")
    stitched = compare.stitched_rows(pairs, tables, "id", "md")
    got = [tuple(r) for r in stitched.orderBy("row_no", "col_no").collect()]
    assert got == [(1, 2, 0, 0, "a"), (1, 2, 0, 1, "b"), (1, 2, 1, 0, "1"), (1, 2, 1, 1, ""), (1, 2, 2, 0, "2"), (1, 2, 2, 1, "3")]
    assert stitched._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") >= 2  # one a side, below the split into cells
