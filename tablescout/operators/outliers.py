"""Outliers of numeric columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import NUMERIC, as_doubles, col, pick, rows_to_columns
from .quantiles import column_quantiles

Z_LIMIT = 3.0
IQR_FACTOR = 1.5


def _counts(table: DataFrame, tests: dict[str, Column]) -> DataFrame:
    n = F.col("n")
    return table.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(t).alias(f"c{i}") for i, t in enumerate(tests.values())]).select(
            rows_to_columns([
                F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_outliers"),
                         (F.try_divide(F.col(f"c{i}"), n) * 100.0).alias("pct_outliers"))
                for i, c in enumerate(tests)]))


def zscore_tests(table: DataFrame, columns: Sequence[str], z: float) -> dict[str, Column]:
    """Per column, the test ``|x - mean| / std > z``; never true for a constant column."""
    stats = table.agg(*[e for c in columns for e in (F.avg(col(c)), F.stddev_samp(col(c)))]).first()
    tests = {}
    for i, c in enumerate(columns):
        mean, std = stats[2 * i], stats[2 * i + 1]
        usable = bool(std) and math.isfinite(mean) and math.isfinite(std)
        tests[c] = (F.abs((col(c) - F.lit(mean)) / F.lit(std)) > z) if usable else F.lit(False)
    return tests


def iqr_tests(table: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Per column, the test "outside the quartiles by more than 1.5 times their distance"."""
    tests = {}
    for c, f in column_quantiles(table, columns, [0.25, 0.75]).items():
        if f["n"] == 0:
            tests[c] = F.lit(False)
            continue
        q1, q3 = f["quantiles"]
        reach = IQR_FACTOR * (q3 - q1)
        # A limit that is not a number, from infinite quartiles, excludes nothing.
        low = F.lit(False) if math.isnan(q1 - reach) else col(c) < F.lit(q1 - reach)
        high = F.lit(False) if math.isnan(q3 + reach) else col(c) > F.lit(q3 + reach)
        tests[c] = low | high
    return tests


def outliers(df: DataFrame, method: str = "zscore", columns: Sequence[str] | None = None,
             z: float = Z_LIMIT) -> DataFrame:
    """``(column, n_outliers, pct_outliers)``; the share is of all rows.

    ``method`` is ``zscore`` or ``iqr``; any other name gives no rows.
    """
    columns = pick(df, columns, NUMERIC)
    if method not in ("zscore", "iqr") or not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, n_outliers long, pct_outliers double")
    table = as_doubles(df, columns)
    tests = zscore_tests(table, columns, z) if method == "zscore" else iqr_tests(table, columns)
    return _counts(table, tests)


def outlier_values(df: DataFrame, order_by: str, columns: Sequence[str] | None = None,
                   z: float = Z_LIMIT, k: int = 10) -> DataFrame:
    """``(column, position, value)``: the first k z-score outliers in the given order."""
    columns = pick(df, columns, NUMERIC)
    table = as_doubles(df, columns)
    tests = zscore_tests(table, columns, z)
    ordered = as_doubles(df.withColumn("_order", col(order_by)), columns, keep=["_order"])
    found = (ordered.select("_order", F.inline(F.array(*[
        F.when(t, F.struct(F.lit(c).alias("column"), col(c).alias("value")))
        for c, t in tests.items()]))).where("column is not null"))
    first = Window.partitionBy("column").orderBy("_order", "value")
    return (found.withColumn("position", F.row_number().over(first))
            .where(F.col("position") <= k).select("column", "position", "value"))
