"""Loading tables and writing results."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from .nested import auto_normalize, normalize_json, normalize_xml, scan_json
from .typing import infer_types
from .workbooks import scan_workbooks

ENDINGS = ("csv", "tsv", "txt", "json", "jsonl", "ndjson", "xml", "xlsx", "xlsm")
ARCHIVE = "PK\u0003\u0004"      # fixed value: how a workbook file begins


def scan_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Delimited text with a header row, types inferred; dates stay text.

    ``multiline`` allows line breaks inside quoted cells, at the price of one task
    per file.
    """
    return infer_types(spark.read.csv(
        path, header=True, inferSchema=False, escape='"', multiLine=multiline))


def content_kind(spark: SparkSession, path: str) -> str:
    """``workbook``, ``json``, ``xml`` or ``csv``, by how the first file at a path begins.

    Only its first line that is not blank is read; the name of the file doesn't matter.
    """
    first = spark.read.text(path).where(F.trim("value") != "").first()
    begin = first["value"].lstrip("\ufeff \t") if first else ""
    if begin.startswith(ARCHIVE):
        return "workbook"
    return {"{": "json", "[": "json", "<": "xml"}.get(begin[:1], "csv")


def load(spark: SparkSession, source: Any) -> DataFrame:
    """Any source as a table.

    A Spark or pandas DataFrame is taken as it is. A dict, or a list of dicts, is a JSON
    document. Text that begins like JSON or XML is a document of it; other text is a path, whose
    content tells what it is: workbooks, JSON (a document a line, or a file that starts with a
    bracket), XML documents (one a file), or delimited text with a header row.
    """
    if isinstance(source, DataFrame):
        return source
    if type(source).__module__.startswith("pandas"):
        return spark.createDataFrame(source)
    if isinstance(source, (dict, list)):
        text = spark.createDataFrame([(json.dumps(source),)], "text string")
        return normalize_json(text, "text").rows
    if not isinstance(source, str):
        raise ValueError("expected a DataFrame, a dict or list, a JSON or XML text, or a path")
    if source.lstrip()[:1] in ("{", "[", "<"):
        return auto_normalize(spark.createDataFrame([(source,)], "text string"), "text").rows
    suffix = source.rpartition("/")[2].rpartition(".")[2] if "." in source.rpartition("/")[2] else ""
    if suffix.lower() not in ("", *ENDINGS):
        raise ValueError(f"expected a path without ending or with one of {ENDINGS}")
    kind = content_kind(spark, source)
    if kind == "workbook":
        return scan_workbooks(spark, source)
    if kind == "json":
        first = spark.read.text(source).where(F.trim("value") != "").first()["value"].strip()
        whole = first.startswith("[") or not first.endswith("}")
        return scan_json(spark, source, multiline=whole).rows
    if kind == "xml":
        return normalize_xml(spark.read.text(source, wholetext=True), "value").rows
    return scan_csv(spark, source)


def export_results(results: Mapping[str, DataFrame], path: str) -> None:
    """Write result tables as JSON lines ``{"result": name, "row": {...}}`` text."""
    out = None
    for name, table in results.items():
        rows = table.select(F.lit(name).alias("result"), F.to_json(
            F.struct(*[col(c) for c in table.columns])).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no results to write")
    out.write.json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``(result, row)`` as written by ``export_results``."""
    return spark.read.schema("result string, row string").json(path)
