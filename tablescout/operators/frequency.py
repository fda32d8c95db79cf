"""Value frequencies: counts, top values, modes, distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (BOOLEAN, CATEGORICAL, DATETIME, col, columns_of, melt,
                                 missing_as_null, pick, rows_to_columns)

DISTINCT_AT_ONCE = 8    # distinct counts that share one pass


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, value, n)`` of the categorical columns, missing values left out."""
    return _counts(df, pick(df, columns, CATEGORICAL))


def _counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n long")
    text = df.select(*[col(c).cast("string").alias(c) for c in columns])
    return (melt(text, columns).where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """``(column, position, value, n)``: the k most frequent values, ties by value."""
    best = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return (value_counts(df, columns).withColumn("position", F.row_number().over(best))
            .where(F.col("position") <= k).select("column", "position", "value", "n"))


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, count, unique, top, freq)``; ties for the top go to the smallest value."""
    return _summarise(value_counts(df, columns))


def _summarise(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("n")).alias("rarity"), "value"))["value"].alias("top"),
        F.max("n").alias("freq"))


def column_modes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, mode, n)``: the most frequent value as text, ties to the smallest.

    Covers the non-numeric columns: text, boolean, date and time.
    """
    if columns is None:
        columns = [c for c in df.columns if c in {
            *columns_of(df, CATEGORICAL), *columns_of(df, BOOLEAN), *columns_of(df, DATETIME)}]
    return _summarise(_counts(df, columns)).select(
        "column", F.col("top").alias("mode"), F.col("freq").alias("n"))


def unique_counts(df: DataFrame, columns: Sequence[str] | None = None,
                  approx: bool = False) -> DataFrame:
    """``(column, n_unique)``: distinct non-missing values, exact unless ``approx``."""
    columns = list(df.columns if columns is None else columns)
    table = missing_as_null(df)
    count = F.approx_count_distinct if approx else F.count_distinct
    out = None
    for i in range(0, len(columns), DISTINCT_AT_ONCE):
        part = columns[i:i + DISTINCT_AT_ONCE]
        rows = table.agg(*[count(col(c)).alias(f"c{j}") for j, c in enumerate(part)]).select(
            rows_to_columns([F.struct(F.lit(c).alias("column"), F.col(f"c{j}").alias("n_unique"))
                             for j, c in enumerate(part)]))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return df.sparkSession.createDataFrame([], "column string, n_unique long")
    return out
