"""Cases that went wrong once."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

import tablescout as ts
from tablescout.operators.clusters import pca
from tablescout.operators.relations import linear_regression, mutual_information
from tablescout.sources.nested import flatten
from tablescout.sources.workbooks import scan_workbooks

INFINITE = [(float(i), float(i * i % 7), float("inf") if i == 3 else float(i % 5))
            for i in range(30)]


def test_an_infinite_value_leaves_no_fit_and_no_components(spark):
    df = spark.createDataFrame(INFINITE, "a double, b double, c double")
    assert linear_regression(df) is None and pca(df) is None
    assert linear_regression(df, "b", ["a", "b"]) is not None


def test_an_infinite_value_is_missing_in_mutual_information(spark):
    df = spark.createDataFrame(INFINITE, "a double, b double, c double")
    without = spark.createDataFrame([r for i, r in enumerate(INFINITE) if i != 3], df.schema)
    found = {r["feature"]: r["mi"] for r in mutual_information(df).collect()}
    want = {r["feature"]: r["mi"] for r in mutual_information(without).collect()}
    assert found == pytest.approx(want) and max(found.values()) > 0


@pytest.mark.parametrize("large", [False, True])
def test_drop_duplicates_returns_rows_as_they_are(spark, large, request):
    if large:
        request.getfixturevalue("tight")
    df = spark.createDataFrame([(-0.0, 1), (0.0, 2), (-0.0, 2), (3.0, 3), (3.0, 3), (4.0, 4),
                                (4.0, 4)], "x double, k int")
    kept = sorted(str(r["x"]) + "/" + str(r["k"]) for r in ts.drop_duplicates(df).collect())
    assert kept == ["-0.0/1", "-0.0/2", "3.0/3", "4.0/4"]
    mapped = df.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert ts.drop_duplicates(mapped).count() == 4


def test_onehot_has_no_limit_of_its_own(spark):
    df = spark.range(1500).select(F.format_string("%04d", "id").alias("c"))
    wide = ts.onehot_encode(df)
    assert wide.columns == [f"c_{i:04d}" for i in range(1500)]
    assert wide.where("c_0007").count() == 1


def test_flatten_names_no_two_columns_alike(spark):
    df = spark.sql("select 1 as `a.b`, named_struct('b', 2) as a")
    with pytest.raises(ValueError):
        flatten(df)


def _sheet(rows):
    cells = "".join("<row>" + "".join(
        f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in row) + "</row>" for row in rows)
    return ('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
            f"<sheetData>{cells}</sheetData></worksheet>")


def test_workbooks_follow_their_sheet_list_and_keep_repeated_headers(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as book:
        book.writestr("xl/workbook.xml", (
            '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r='
            '"http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
            '<sheet name="one" sheetId="7" r:id="rId9"/></sheets></workbook>'))
        book.writestr("xl/_rels/workbook.xml.rels", (
            '<Relationships><Relationship Id="rId9" Target="worksheets/other.xml"/>'
            "</Relationships>"))
        book.writestr("xl/worksheets/other.xml", _sheet([["a", "a", "b"], [1, 2, 3], [4, 5, 6]]))
    (tmp_path / "one.xlsx").write_bytes(data.getvalue())
    table = scan_workbooks(spark, str(tmp_path / "one.xlsx"))
    assert table.columns == ["a", "a.1", "b"]
    assert sorted(tuple(r) for r in table.collect()) == [(1, 2, 3), (4, 5, 6)]
