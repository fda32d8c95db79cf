"""Descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (CATEGORICAL, DATETIME, NUMERIC, as_doubles, col, pick,
                                 rows_to_columns)
from .frequency import describe_categorical, top_values, unique_counts
from .quantiles import column_quantiles

EPOCH = "timestamp_ntz '1970-01-01 00:00:00'"
NUMERIC_SCHEMA = ("column string, count long, mean double, std double, min double, "
                  "q25 double, q50 double, q75 double, max double")


def numeric_facts(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, dict]:
    """Count, mean, deviation, range and quartiles per numeric column, for operators to share."""
    return column_quantiles(df, pick(df, columns, NUMERIC), measures={
        "mean": F.avg, "std": F.stddev_samp})


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None,
                     facts: dict[str, dict] | None = None) -> DataFrame:
    """``(column, count, mean, std, min, q25, q50, q75, max)``, quartiles exact."""
    facts = numeric_facts(df, columns) if facts is None else facts
    return df.sparkSession.createDataFrame(
        [(c, f["n"], f["mean"], f["std"], f["lowest"], *f["quantiles"], f["highest"])
         for c, f in facts.items()], NUMERIC_SCHEMA)


def _micros(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(col(name))
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), col(name).cast("timestamp_ntz"))


def describe_datetime(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, count, mean, min, q25, q50, q75, max)`` as timestamps, to the microsecond."""
    columns = pick(df, columns, DATETIME)
    facts = column_quantiles(df.select(*[_micros(df, c).alias(c) for c in columns]), columns,
                             measures={"mean": F.avg})
    names = ["mean", "min", "q25", "q50", "q75", "max"]
    rows = []
    for c, f in facts.items():
        values = [f["mean"], f["lowest"], *f["quantiles"], f["highest"]]
        rows.append((c, f["n"], *[None if v is None else int(v // 1) for v in values]))
    table = df.sparkSession.createDataFrame(
        rows, "column string, count long, " + ", ".join(f"{n} long" for n in names))
    return table.select("column", "count", *[
        F.timestamp_add("MICROSECOND", F.col(n), F.expr(EPOCH)).alias(n) for n in names])


def mean_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, mean, median)`` of the numeric columns."""
    facts = column_quantiles(df, pick(df, columns, NUMERIC), [0.5], {"mean": F.avg})
    return df.sparkSession.createDataFrame(
        [(c, f["mean"], f["quantiles"][0]) for c, f in facts.items()],
        "column string, mean double, median double")


def column_spread(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, std_sample, std_population)`` of the numeric columns."""
    columns = pick(df, columns, NUMERIC)
    return as_doubles(df, columns).agg(*[
        F.struct(F.lit(c).alias("column"), F.stddev_samp(col(c)).alias("std_sample"),
                 F.stddev_pop(col(c)).alias("std_population")).alias(f"c{i}")
        for i, c in enumerate(columns)]).select(
            rows_to_columns([F.col(f"c{i}") for i in range(len(columns))]))


def summary_statistics(df: DataFrame, top: int = 10,
                       facts: dict[str, dict] | None = None) -> DataFrame:
    """The summary bundle in long form ``(section, column, metric, value, text)``.

    Sections: ``numerical`` (describe), ``categorical`` (unique values and the most
    frequent ones), ``data_types`` and ``unique_counts``.
    """
    empty = F.lit(None).cast("string")
    stats = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    numeric, categorical = pick(df, None, NUMERIC), pick(df, None, CATEGORICAL)
    parts = []
    if df.columns:
        parts.append(unique_counts(df).select(
            F.lit("unique_counts").alias("section"), "column", F.lit("unique").alias("metric"),
            F.col("n_unique").cast("double").alias("value"), empty.alias("text")))
    parts.append(df.sparkSession.createDataFrame(
        [("data_types", f.name, "dtype", None, f.dataType.simpleString())
         for f in df.schema.fields],
        "section string, column string, metric string, value double, text string"))
    if numeric:
        described = describe_numeric(df, facts=facts).withColumn("count", F.col("count").cast("double"))
        parts.append(described.unpivot(["column"], stats, "metric", "value").select(
            F.lit("numerical").alias("section"), "column", "metric", "value",
            empty.alias("text")))
    if categorical:
        parts.append(describe_categorical(df).select(
            F.lit("categorical").alias("section"), "column",
            F.lit("unique_values").alias("metric"),
            F.col("unique").cast("double").alias("value"), empty.alias("text")))
        parts.append(top_values(df, k=top).select(
            F.lit("categorical").alias("section"), "column",
            F.concat(F.lit("top_"), F.col("position")).alias("metric"),
            F.col("n").cast("double").alias("value"), F.col("value").alias("text")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
