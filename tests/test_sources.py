"""Reading CSV, workbooks, JSON and XML."""

import zipfile

import pytest
from pyspark.sql import functions as F

import tablescout as ts
from tablescout.functions.scale import new_folder


def text(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")


def test_csv_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('i,d,b,s,gap,none,letter\n1,1.5,True,"a, ""b""",3,,1d\n2,NA,false,x,NaN,NULL,2\n')
    df = ts.load(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "bigint",
                                         "double", "string"]
    assert df.orderBy("i").first()["s"] == 'a, "b"'
    assert df.where("d is null and gap is null").count() == 1


def test_load_rejects_other_sources(spark):
    with pytest.raises(ValueError):
        ts.load(spark, "table.parquet")
    df = spark.range(2)
    assert ts.load(spark, df) is df
    assert ts.load(spark, df.toPandas()).count() == 2


def test_json_object_and_array(spark):
    df = text(spark, '{"name": "Ann", "address": {"city": "X", "geo": {"lat": 1.5}}, "tags": [1, 2]}',
              '[{"name": "Bob", "age": 3}, {"name": "Cy", "address": {"city": "Y"}}]', "{}", "[]")
    out = ts.normalize_json(df, "text", ["id"])
    assert set(out.rows.columns) == {"id", "name", "age", "tags", "address.city", "address.geo.lat"}
    assert out.rows.count() == 4 and out.rejects.count() == 0
    bob = out.rows.where("name = 'Bob'").first()
    assert (bob["id"], bob["age"], bob["address.city"]) == (1, 3, None)
    assert out.rows.where("name = 'Ann'").first()["tags"] == [1, 2]


def test_json_mixed_values(spark):
    df = text(spark, '{"v": 1, "n": null, "b": true, "a b": {"c.d": 2}}', '{"v": "x", "n": null}')
    out = ts.normalize_json(df, "text").rows
    assert sorted(r["v"] for r in out.collect()) == ["1", "x"]
    assert "a b.c.d" in out.columns


def test_broken_json_is_rejected(spark):
    out = ts.normalize_json(text(spark, "invalid json string {{", "5", '[1, {"a": 1}]'), "text", ["id"])
    assert out.rows.count() == 1
    assert sorted(r["id"] for r in out.rejects.collect()) == [0, 1, 2]


def test_xml(spark):
    df = text(spark, '<?xml version="1.0"?><!-- c --><root><person id="7"><name>Ann</name>'
                     '<age>3</age></person></root>',
              "<root><person><name>Bob</name><name>Bo</name></person></root>", "<invalid><unclosed>")
    out = ts.normalize_xml(df, "text", ["id"])
    assert set(out.rows.columns) == {"id", "root.person.@id", "root.person.name", "root.person.age"}
    found = {r["id"]: r for r in out.rows.collect()}
    assert found[0]["root.person.@id"] == "7" and found[0]["root.person.age"] == "3"
    assert found[1]["root.person.name"] == ["Bob", "Bo"]
    assert [r["id"] for r in out.rejects.collect()] == [2]


def test_auto_detect(spark):
    df = text(spark, ' {"a": 1}', "<r><b>2</b></r>", "plain", None)
    out = ts.auto_normalize(df, "text", ["id"])
    assert set(out.rows.columns) == {"id", "a", "r.b"}
    assert out.rows.count() == 2 and sorted(r["id"] for r in out.rejects.collect()) == [2, 3]


def test_files_with_broken_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": {"b": 1}}\n{broken\n')
    out = ts.scan_json(spark, str(tmp_path / "a.json"))
    assert out.rows.columns == ["a.b"] and out.rows.count() == 1 and out.rejects.count() == 1
    (tmp_path / "a.xml").write_text("<all><r k='1'><v>2</v></r><r><v>3</v><w/></r><r><v>4</r></all>")
    out = ts.scan_xml(spark, str(tmp_path / "a.xml"), "r")
    assert {"@k", "v"} <= set(out.rows.columns)
    assert out.rows.count() == 2 and out.rejects.count() == 1


def test_only_plain_text(spark):
    out = ts.auto_normalize(text(spark, "plain"), "text", ["id"])
    assert out.rows.count() == 0 and out.rejects.count() == 1


def test_flatten(spark):
    df = spark.range(2).select("id", F.struct(
        F.lit(30).alias("age"), F.struct(F.lit("X").alias("city")).alias("home")).alias("details"),
        F.array(F.lit(1), F.lit(2)).alias("list"))
    assert ts.flatten(df).columns == ["id", "list", "details.age", "details.home.city"]
    assert ts.flatten(df, explode_arrays=True).count() == 4


def test_workbooks(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = (f'<worksheet xmlns="{main}"><sheetData>'
             '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
             '<row><c r="A2"><v>1</v></c><c r="B2" t="s"><v>2</v></c></row>'
             '<row><c r="B3" t="inlineStr"><is><t>y</t></is></c></row></sheetData></worksheet>')
    strings = f'<sst xmlns="{main}"><si><t>n</t></si><si><t>s</t></si><si><t>x</t></si></sst>'
    for name in ("a.xlsx", "b.xlsx"):
        with zipfile.ZipFile(tmp_path / name, "w") as book:
            book.writestr("xl/worksheets/sheet1.xml", sheet)
            book.writestr("xl/sharedStrings.xml", strings)
    df = ts.scan_workbooks(spark, str(tmp_path / "*.xlsx"))
    assert df.dtypes == [("n", "bigint"), ("s", "string")]
    assert sorted((r["n"] or 0, r["s"]) for r in df.collect()) == [(0, "y"), (0, "y"), (1, "x"), (1, "x")]


def test_export(spark):
    path = new_folder(spark, "test")
    ts.export_results({"a": spark.range(2), "b": spark.createDataFrame([("x",)], ["s"])}, path)
    back = sorted((r["result"], r["row"]) for r in ts.read_results(spark, path).collect())
    assert back == [("a", '{"id":0}'), ("a", '{"id":1}'), ("b", '{"s":"x"}')]
