"""Column types of tables that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col

# Cells that mean "missing" in delimited text.
MISSING_TEXT = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                "nan", "null"]


def _long(c: Column) -> Column:
    return c.try_cast("long")


def _double(c: Column) -> Column:
    # A trailing type letter, as in "1d", is text and not a number.
    return F.when(~c.rlike("[0-9.][dDfF]\\s*$"), c.try_cast("double"))


def _boolean(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low == "true", True).when(low == "false", False)


def infer_types(df: DataFrame) -> DataFrame:
    """Give text columns the narrowest of long, double, boolean, string that fits all cells.

    One aggregate over the whole table decides all columns. A column without any
    value is double.
    """
    text = df.select(*[
        F.when(~col(c).isin(MISSING_TEXT), col(c)).alias(c) for c in df.columns])
    row = text.agg(F.count(F.lit(1)), *[
        F.struct(F.count(col(c)).alias("present"), F.count(_long(col(c))).alias("long"),
                 F.count(_double(col(c))).alias("double"),
                 F.count(_boolean(col(c))).alias("boolean")).alias(f"c{i}")
        for i, c in enumerate(df.columns)]).first()
    out = []
    for i, c in enumerate(df.columns):
        fits = row[f"c{i}"]
        if fits["present"] and fits["long"] == fits["present"]:
            out.append(_long(col(c)).alias(c))
        elif fits["double"] == fits["present"]:
            out.append(_double(col(c)).alias(c))
        elif fits["boolean"] == fits["present"]:
            out.append(_boolean(col(c)).alias(c))
        else:
            out.append(col(c))
    return text.select(*out)
