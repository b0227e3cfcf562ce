import pytest

from leafmill.llm import lookalike

SCHEMA = "id long, doc string, page int, md string, heads array<string>, _look string"


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return {(r.a, r.b) for r in lookalike.alike_pairs(df, "id", ["doc", "page"], ["md", "heads"]).collect()}


def test_pairs(spark):
    rows = [
        (1, "A", 1, "abc", ["x"]), (2, "A", 1, "аbc", ["x"]), (3, "A", 1, "abc", ["x"]), (4, "A", 1, "abc", ["x​"]),
        (5, "A", 2, "аbc", ["x"]), (6, "A", 1, "ábc", ["x"]), (7, "A", 1, "ábc", ["x"]), (8, "A", 1, None, ["x"]),
        (9, "A", 1, "abc", None), (10, "A", 1, "ab³", ["x"]), (11, "A", 1, "ab3", ["x"]), (2, "A", 1, "аbc", ["x"]), (None, "A", 1, "аbc", ["x"]), (12, None, 1, "аbc", ["x"]),
    ]
    assert pairs(spark, rows) == {(1, 2), (2, 3), (1, 4), (2, 4), (3, 4), (6, 7)}
    assert pairs(spark, []) == set()


def test_null_elements_and_order_of_headers(spark):
    rows = [(1, "A", 1, "x", ["a", None]), (2, "A", 1, "ｘ", ["a", None]), (3, "A", 1, "x", [None, "a"]), (4, "A", 1, "x", ["a", ""]), (5, "A", 1, "x", ["a"])]
    assert pairs(spark, rows) == {(1, 2)}


def test_canonical_member(spark):
    rows = [(1, "ab"), (2, "ab"), (3, "аb"), (4, "а​b"), (5, None), (6, ""), (7, "​"), (8, "AB"), (9, "y" * 100_000), (10, "у" + "y" * 99_999)]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: r.c for r in lookalike.canonical_text(df, "t", out="c").collect()}
    assert [got[i] for i in range(1, 9)] == ["ab", "ab", "ab", "ab", None, "", "", "AB"]
    assert got[10] == got[9] == "y" * 100_000
    with pytest.raises(ValueError, match="exists"):
        lookalike.canonical_text(df, "t", out="id")


def test_canonical_headers(spark, tmp_path):
    from leafmill.llm.queries import QUERIES

    rows = [(1, ["Dose", "Age"]), (2, ["Dose", "Age"]), (3, ["Dоse", "Age"]), (4, ["Age", "Dоse", None, "Dose"]), (5, []), (6, None), (7, ["Day"]), (8, ["Dаy"]), (9, ["Dаy"]), (10, ["a＂,＂b"]), (3, ["Dоse", "Age"])]
    spark.createDataFrame(rows, "report_id long, headers array<string>").write.parquet(f"{tmp_path}/cross_validation_report.parquet")
    out = QUERIES["p2_headers"](spark, str(tmp_path))
    assert out.columns == ["report_id", "headers", "canonical"]
    got = {r.report_id: r.canonical for r in out.collect()}
    assert got == {1: ["Dose", "Age"], 2: ["Dose", "Age"], 3: ["Dose", "Age"], 4: ["Age", "Dose", None, "Dose"], 5: [], 6: None, 7: ["Dаy"], 8: ["Dаy"], 9: ["Dаy"], 10: ["a＂,＂b"]}


def test_classes(spark):
    rows = [(3, "A", 1, "abc", ["x"]), (2, "A", 1, "аbc", ["x"]), (9, "A", 1, "abc", ["x"]), (5, "A", 2, "abc", ["x"]), (6, "A", 1, "z", ["x"]), (7, "A", 1, None, ["x"]), (2, "A", 1, "аbc", ["x"])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = lookalike.classes_of_looks(df, "id", ["doc", "page"], ["md", "heads"]).collect()
    assert sorted((r.id, r.class_id) for r in got) == [(2, 2), (3, 2), (9, 2)]


def test_a_hot_form_meets_only_other_forms(spark):
    """One form in nearly all rows of a page, one row of another: as many pairs as rows."""
    n = 20_000
    df = spark.range(n).selectExpr("id", "'A' as doc", "1 as page", f"if(id = {n - 1}, 'аbc', 'abc') as md", "array('x') as heads", "'' as _look")
    assert lookalike.alike_pairs(df, "id", ["doc", "page"], ["md", "heads"]).count() == n - 1
