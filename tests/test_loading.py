"""Sources told by their content; XML schemas; results in the report."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tablescout as ts
from tablescout.catalog.preparing import _workbook
from tablescout.plans.report import result_rows
from tablescout.sources import nested, tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_dict_list_and_text(spark):
    one = {"id": 1, "place": {"city": "X"}, "tags": [1, 2]}
    for source in (one, json.dumps(one), [one], "  " + json.dumps([one])):
        df = ts.load(spark, source)
        assert df.count() == 1 and set(df.columns) == {"id", "place.city", "tags"}
    assert ts.load(spark, [one, {"id": 2}, {"id": 3}]).count() == 3
    xml = ts.load(spark, "<a x='1'><b>2</b></a>")
    assert rows(xml) == [("1", "2")] and set(xml.columns) == {"@x", "b"} or xml.count() == 1
    with pytest.raises(ValueError):
        ts.load(spark, 7)


def test_content_not_name_tells_the_kind(spark, tmp_path):
    import pandas as pd
    table = pd.DataFrame({"a": [1, 2], "b": ["x", "y"]})
    (tmp_path / "book.csv").write_bytes(_workbook(table))
    (tmp_path / "plain.txt").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "lines.csv").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n')
    (tmp_path / "whole.txt").write_text('[\n{"a": 1, "b": "x"},\n{"a": 2, "b": "y"}\n]\n')
    (tmp_path / "one.json").write_text('{\n "a": 1,\n "b": "x"\n}\n')
    for name, kind in (("book.csv", "workbook"), ("plain.txt", "csv"), ("lines.csv", "json"),
                       ("whole.txt", "json")):
        path = str(tmp_path / name)
        assert tables.content_kind(spark, path) == kind
        assert rows(ts.load(spark, path).select("a", "b")) == [(1, "x"), (2, "y")]
    assert rows(ts.load(spark, str(tmp_path / "one.json"))) == [(1, "x")]
    (tmp_path / "doc.xml").write_text("<?xml version='1.0'?>\n<r>\n <a>1</a><b>x</b>\n</r>\n")
    assert rows(ts.load(spark, str(tmp_path / "doc.xml")).select("`r.a`", "`r.b`")) == [("1", "x")]


def test_xml_schema_is_found_without_python_and_can_be_given(spark):
    docs = spark.createDataFrame([(1, "<r><a>1</a></r>"), (2, "<r>\n<b k='z'>2\n3</b></r>"),
                                  (3, None), (4, "<r><a>")], "id int, text string")
    schema = nested.xml_schema(docs, "text")
    assert [f.name for f in schema.fields] == ["r"]
    first = nested.normalize_xml(docs, "text", ["id"])
    again = nested.normalize_xml(docs, "text", ["id"], schema)
    assert first.rows.columns == again.rows.columns and rows(first.rows) == rows(again.rows)
    assert {r["id"] for r in first.rows.collect()} == {1, 2}
    assert {r["id"] for r in first.rejects.collect()} == {3, 4}
    narrow = T.StructType([T.StructField("r", T.StructType([T.StructField("a", T.StringType())]))])
    assert nested.normalize_xml(docs, "text", ["id"], narrow).rows.columns == ["id", "r.a"]


def test_results_are_rows_of_the_report(spark):
    results = {"one": spark.createDataFrame([(1, "<b>")], "n int, text string"),
               "two": spark.createDataFrame([(1.5, [1, 2])], "x double, list array<int>")}
    content = result_rows(results).select(
        "analysis", F.variant_get("content", "$.n", "int").alias("n"),
        F.variant_get("content", "$.list[1]", "int").alias("second")).collect()
    assert sorted(map(tuple, content)) == [("one", 1, None), ("two", None, 2)]
    report = ts.summary_report(results["one"], results=results)
    assert rows(report.where("section = 'results'").select("item", "value")) == [
        ("one", 1.0), ("two", 1.0)]
    page = ts.report_html(report, results=results)
    assert "&lt;b&gt;" in page and "<b>" not in page and "<h2>two</h2>" in page


def test_items_of_an_analysis(spark):
    df = spark.createDataFrame(
        [(float(i), float(i % 5), "x" if i % 3 else None) for i in range(30)] * 2,
        "a double, b double, c string")
    run = ts.analyse(df, restarts=2)
    items = {(r["step"], r["item"]): r["value"] for r in run.items().collect()}
    assert items["handle_duplicates", "rows"] == 30
    assert items["handle_missing_values", "missing"] == 0
    assert items["encode_categorical_features", "columns"] == 4
    assert items["normalize_data", "a.std"] == pytest.approx(1)
    assert items["plot_pairplot", "a.a.0..n"] > 0
    assert items["create_summary_report", "results.plot_pairplot"] > 0
    empty = {"identify_strong_relationships"}       # a result without rows
    assert {s for s, _ in items} | empty == {s[1] for s in run.status} and len(run.status) == 22
    run.close()


def test_a_step_without_a_result_is_no_success(spark):
    run = ts.analyse(spark.createDataFrame([("x",), ("y",)], "c string"))
    state = {s[1]: s[2] for s in run.status}
    assert state["perform_clustering"] == "empty" and state["handle_duplicates"] == "success"


def test_a_failing_cleaning_pass_is_noted(spark):
    broken = spark.range(6).select(F.when(F.col("id") >= 0, F.raise_error(F.lit("bad row")))
                                   .cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    run = ts.analyse(broken)
    state = {s[1]: s[2] for s in run.status}
    assert len(state) == 22 and state["assess_data_quality"] == "failed"
    assert state["generate_narrative_summary"] == "failed"
