import json
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from leafmill.sources import readers, sinks
from leafmill.streaming import ingest


def spans(spark):
    rows = [("d", 1, 0, 0, 0, 10.0, "Big", "f", 18.0, 0), ("d", 1, 0, 1, 1, 20.0, " text", "f", 10.0, 2), ("d", 1, 0, 1, 0, 20.0, "Some", "f", 10.0, 0), ("d", 1, 1, 0, 0, 5.0, "first", "f", 10.0, 0), ("d", 1, 2, 0, 0, 30.0, "  ", "f", 10.0, 0), ("d", 1, 3, 0, 0, 25.0, "Bold", "f", 10.0, 16)]
    return spark.createDataFrame(rows, readers.SPANS)


def test_lines_headings_sections(spark):
    s = spans(spark)
    lines = readers.text_lines(s)
    assert [(r.text, r.is_bold, r.is_italic) for r in lines.orderBy("y_pos").collect()] == [("first", False, False), ("Big", False, False), ("Some text", False, True), ("Bold", True, False)]
    heads = readers.heading_spans(s)
    assert {(r.text, r.level) for r in heads.collect()} == {("Big", 1), ("Bold", 3)}
    got = {r.section_no: (r.heading, r.text) for r in readers.page_sections(lines, heads).collect()}
    assert got[0] == (None, "first") and got[1][0] == "Big" and got[2] == ("Bold", "Bold")


class Fake:
    def pages(self, name, content):
        if b"bad" in content:
            raise ValueError("no document")
        return [("doc", i + 1, t, 842.0) for i, t in enumerate(content.decode().split("\f"))]


def test_files_and_adapter(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests
    (tmp_path / "a.txt").write_bytes(b"one\ftwo")
    (tmp_path / "b.txt").write_bytes(b"bad")
    pages = readers.parsed_pages(readers.files(spark, str(tmp_path), "*.txt"), Fake()).collect()
    assert sorted((r.page or 0, r.raw_text or "") for r in pages) == [(0, ""), (1, "one"), (2, "two")]


def test_fallback_ranges_and_nll(spark):
    a = spark.createDataFrame([], "doc_id string, page int")
    b = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, page int")
    got = readers.with_fallbacks([a, b, b], ["first", "lattice", "stream"], [0.9, 0.95, 0.85]).collect()
    assert {(r.method, r.confidence) for r in got} == {("lattice", 0.95)} and len(got) == 2
    r = spark.createDataFrame([("d", 5, 7), ("d", 2, 3)], "doc_id string, first int, last int")
    gaps = spark.createDataFrame([("d", None)], "doc_id string, cell string")
    assert [r.cell for r in readers.with_fallbacks([gaps], ["first"], [0.9]).collect()] == [""]
    assert [(x.new_page, x.page) for x in readers.page_ranges(r).orderBy("new_page").collect()] == [(1, 2), (2, 3), (3, 5), (4, 6), (5, 7)]
    text = ["=====", "--- Table 7 (page 3) ---", "IF a", "", "--- Stitched S1 ---", "IF b", "IF c", "--- Table 7 (page 3) ---", "IF d"]
    lines = spark.createDataFrame(list(enumerate(text)), "line_no int, line string")
    assert {x.table_key: x.nll for x in readers.nll_records(lines).collect()} == {"7": "IF d", "S1": "IF b\nIF c"}


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, "x", " "), (2, "y", "IF"), (3, "z", None)], "id int, markdown string, nll string")
    inv = sinks.table_inventory(t)
    assert [r.has_nll for r in inv.orderBy("id").collect()] == [False, True, False] and inv.columns == ["id", "has_nll"]
    for _ in range(2):
        sinks.write_table(t, str(tmp_path / "t"), ("id",))
        sinks.write_json(t, str(tmp_path / "j"))
        sinks.write_csv(t, str(tmp_path / "c"), ("id",))
        sinks.write_text(t, "markdown", str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert readers.read_json(spark, str(tmp_path / "j"), "id int, nll string", multi_line=False).where("nll is null").count() == 1
    assert sorted(r.value for r in readers.read_lines(spark, str(tmp_path / "x")).collect()) == ["x", "y", "z"]
    (tmp_path / "broken.json").write_text('{"id": 1}\n{"id": \n')
    got = readers.read_json(spark, str(tmp_path / "broken.json"), "id int", multi_line=False).cache()
    assert sorted((r.id or 0, r._corrupt_record is None) for r in got.collect()) == [(0, False), (1, True)]
    sinks.summary_json(t.agg(F.count("id").alias("n")), tmp_path / "s.json")
    assert json.loads((tmp_path / "s.json").read_text()) == {"n": 3}
    with pytest.raises(ValueError, match="one row"):
        sinks.summary_json(t, tmp_path / "s.json")
    calls = []
    for _ in range(2):
        assert sinks.read_or_build(spark, str(tmp_path / "kb"), lambda: calls.append(1) or t).count() == 3
    assert calls == [1]


def test_stream_takes_each_version_once(spark, tmp_path):
    schema = "doc_id long, text string, at timestamp"
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))

    def add(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        ingest.write_chunks(ingest.chunk_stream(ingest.document_stream(spark, src, schema), "doc_id", "text", "at"), out, ck).awaitTermination()
        return spark.read.parquet(out).count()

    t = datetime(2025, 1, 1)
    assert add([(1, "a b", t), (2, "c", t), (1, "a b", t)]) == 2
    assert add([(1, "a b", t), (1, "a c", t)]) == 3
    s = ingest.arrivals(ingest.document_stream(spark, src, schema), "at", "doc_id")
    assert s.isStreaming and s.columns == ["window", "doc_id", "n"]
