"""Spreadsheet workbooks: many files, one task per group of files."""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import settle
from .typing import infer_types

# Names inside the public spreadsheet format.
BOOK, LINKS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels"
SHEET, STRINGS = "xl/worksheets/sheet1.xml", "xl/sharedStrings.xml"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ROWS_AT_ONCE = 5_000

# The parser travels with its task, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _letters(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The part that holds the first sheet of the workbook's list."""
    if not {BOOK, LINKS} <= set(book.namelist()):
        return SHEET
    listed = ElementTree.fromstring(book.read(BOOK)).find(f"{MAIN}sheets/{MAIN}sheet")
    for link in ElementTree.fromstring(book.read(LINKS)):
        if listed is not None and link.get("Id") == listed.get(RELATION):
            target = link.get("Target")
            return target[1:] if target.startswith("/") else f"xl/{target}"
    return SHEET


def _names(header: list) -> list[str]:
    """Column names: a blank one gets its place, a repeated one a number."""
    names: list[str] = []
    for i, h in enumerate(header):
        name, k = h if h else f"Unnamed: {i}", 0
        while (name if not k else f"{name}.{k}") in names:
            k += 1
        names.append(name if not k else f"{name}.{k}")
    return names


def _sheet_rows(content: bytes) -> Iterator[list]:
    """Rows of the first sheet, as lists of text or None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if STRINGS in book.namelist():
            with book.open(STRINGS) as part:
                shared = ["".join(t.text or "" for t in item.iter(MAIN + "t"))
                          for item in ElementTree.parse(part).getroot().findall(MAIN + "si")]
        with book.open(_first_sheet(book)) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != MAIN + "row":
                    continue
                cells: list = []
                for cell in row.findall(MAIN + "c"):
                    at = _letters(cell.get("r")) if cell.get("r") else len(cells)
                    cells.extend([None] * (at + 1 - len(cells)))
                    kind, value = cell.get("t"), cell.findtext(MAIN + "v")
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(MAIN + "t"))
                    elif kind == "b" and value is not None:
                        value = "true" if value == "1" else "false"
                    cells[at] = value
                yield cells
                row.clear()


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = _sheet_rows(content)
            header = next(rows, None)
            if header is None:
                continue
            names = _names(header)
            held: list = []
            for cells in rows:
                held.append((path, names, (cells + [None] * len(names))[:len(names)]))
                if len(held) == ROWS_AT_ONCE:
                    yield pd.DataFrame(held, columns=["path", "names", "cells"])
                    held = []
            if held:
                yield pd.DataFrame(held, columns=["path", "names", "cells"])


def workbook_rows(files: DataFrame) -> DataFrame:
    """The rows of the first sheets of workbooks ``(path, content)``, types inferred.

    The first row of a sheet names its columns; a column that some workbooks lack
    is missing there. Columns stand as in the workbook of the smallest path that has them.
    """
    cells = settle(files.select("path", "content").mapInPandas(
        _parse, "path string, names array<string>, cells array<string>"))
    first = cells.groupBy("names").agg(F.min("path").alias("path"))
    names = [r["name"] for r in first.select("path", F.posexplode("names").alias("at", "name"))
             .groupBy("name").agg(F.min(F.struct("path", "at")).alias("place"))
             .orderBy("place").collect()]
    at = F.array_position
    return infer_types(cells.select(*[
        F.when(at("names", n) > 0, F.try_element_at("cells", at("names", n).cast("int"))).alias(n)
        for n in names]))


def scan_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The workbooks at a path or pattern as one table."""
    return workbook_rows(spark.read.format("binaryFile").load(path))
