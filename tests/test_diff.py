from leafmill.operators.diff import table_differences

SCHEMA = "k long, t string, h array<string>, n int, v int"


def diff(spark, a, b, **kw):
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    out = table_differences(left, right, "k", ["t", "h", "n"], "v", "v", **kw)
    assert out.columns == ["k", "difference"]
    return {(r.k, r.difference) for r in out.collect()}


def test_every_kind_of_difference(spark):
    a = [(1, "x", ["a"], 1, 0), (2, "x", ["a"], 1, 0), (3, "x", ["a", "b"], 1, 0), (4, "x", ["a"], 1, 0), (5, "x", ["a"], 1, 0)]
    b = [(1, "x", ["a"], 1, 0), (2, "y", ["a"], 2, 0), (3, "x", ["b", "a"], 1, 0), (4, "X", ["a"], 1, 0), (6, "x", ["a"], 1, 0)]
    assert diff(spark, a, b) == {(2, "t"), (2, "n"), (3, "h"), (4, "t"), (5, "only_left"), (6, "only_right")}


def test_looks_nulls_and_elements(spark):
    a = [(1, "ａ", ["а"], None, 0), (2, None, ["a"], 1, 0), (3, "", [None], 1, 0), (4, "x", [""], 1, 0), (5, "x", None, 1, 0)]
    b = [(1, "a​", ["a"], None, 0), (2, "", ["a"], 1, 0), (3, "", [""], 1, 0), (4, "x", [], 1, 0), (5, "x", [], 1, 0)]
    assert diff(spark, a, b) == {(2, "t"), (3, "h"), (4, "h"), (5, "h")}


def test_redelivered_rows_count_once_and_the_latest_holds(spark):
    a = [(1, "old", ["a"], 1, 1), (1, "new", ["a"], 1, 2), (1, "new", ["a"], 1, 2)]
    b = [(1, "new", ["a"], 1, 7)]
    assert diff(spark, a, b) == set()


def test_empty_sides_and_null_keys(spark):
    a = [(1, "x", ["a"], 1, 0), (None, "x", ["a"], 1, 0)]
    assert diff(spark, [], []) == set()
    assert diff(spark, a, []) == {(1, "only_left"), (None, "only_left")}
    assert diff(spark, a, [(None, "y", ["a"], 1, 0), (1, "x", ["a"], 1, 0)]) == {(None, "t")}


def test_long_text_and_clashing_columns(spark):
    a = spark.createDataFrame([(1, "x" * 300_000, 1)], "k long, t string, _k int")
    b = spark.createDataFrame([(1, "x" * 299_999 + "y", 1)], "k long, t string, _in int")
    assert [tuple(r) for r in table_differences(a, b, "k", ["t"]).collect()] == [(1, "t")]
