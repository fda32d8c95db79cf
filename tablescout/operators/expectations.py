"""Validation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, missing_as_null, rows_to_columns


def validate(df: DataFrame, expected: T.StructType | None = None) -> DataFrame:
    """``(column, check, passed, failing_rows, detail)``.

    Checks: ``exists`` and ``dtype`` against the expected schema (by default the
    table's own), and ``not_null``. ``failing_rows`` is known for ``not_null``; a
    column that does not exist fails on every row.
    """
    expected = expected or df.schema
    actual = {f.name: f.dataType for f in df.schema.fields}
    table = missing_as_null(df)
    n = F.col("n")
    wide = table.agg(F.count(F.lit(1)).alias("n"), *[
        F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    place = {c: i for i, c in enumerate(df.columns)}

    def check(column, name, passed, failing, detail):
        return F.struct(F.lit(column).alias("column"), F.lit(name).alias("check"),
                        passed.alias("passed"), failing.cast("long").alias("failing_rows"),
                        F.lit(detail).alias("detail"))

    rows = []
    for f in expected.fields:
        exists = f.name in actual
        rows.append(check(f.name, "exists", F.lit(exists), F.lit(0) if exists else n, None))
        same = exists and actual[f.name] == f.dataType
        found = actual[f.name].simpleString() if exists else None
        rows.append(check(f.name, "dtype", F.lit(same), F.lit(0) if same else n, found))
    for c in df.columns:
        nulls = n - F.col(f"c{place[c]}")
        rows.append(check(c, "not_null", nulls == 0, nulls, None))
    return wide.select(rows_to_columns(rows))
