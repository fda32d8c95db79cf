"""Features: label codes, one-hot columns, standardised numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (CATEGORICAL, NUMERIC, as_doubles, col, missing_as_null, pick)
from ..functions.scale import attach, running_total, settle
from .frequency import value_counts


def label_codes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, value, n, code)``: codes 0, 1, ... in value order, per column."""
    counts = settle(value_counts(df, columns))
    return settle(running_total(counts, ["column"], "value", "n")
                  .select("column", "value", "n", F.col("position").cast("double").alias("code")))


def label_encode(df: DataFrame, columns: Sequence[str] | None = None,
                 codes: DataFrame | None = None) -> DataFrame:
    """Add ``<column>_encoded`` (double) per categorical column; missing stays missing."""
    columns = pick(df, columns, CATEGORICAL)
    if not columns:
        return df
    codes = label_codes(df, columns) if codes is None else codes
    sizes = dict(codes.groupBy("column").count().collect())
    out = df
    for c in columns:
        table = codes.where(F.col("column") == c).select(
            F.col("value").alias(c), F.col("code").alias(c + "_encoded"), F.col("n").alias("_n"))
        out = attach(out, table, [c], "_n", sizes.get(c, 0)).drop("_n")
    return out.select(*[col(c) for c in df.columns], *[col(c + "_encoded") for c in columns])


def onehot_encode(df: DataFrame, columns: Sequence[str] | None = None,
                  max_categories: int | None = None) -> DataFrame:
    """Replace categorical columns by boolean columns ``<column>_<value>``, in value order.

    Each category is an output column, and so its name comes to the driver; a caller who
    wants no table so wide can set a limit, beyond which this is an error. ``label_encode``
    codes any number of categories without that.
    """
    columns = pick(df, columns, CATEGORICAL)
    values: dict[str, list[str]] = {c: [] for c in columns}
    for r in value_counts(df, columns).select("column", "value").collect():
        values[r["column"]].append(r["value"])
    values = {c: sorted(v) for c, v in values.items()}
    wide = [c for c in columns if max_categories is not None and len(values[c]) > max_categories]
    if wide:
        raise ValueError(f"over {max_categories} categories in {wide}")
    rest = [c for c in df.columns if c not in columns]
    new = [f"{c}_{v}" for c in columns for v in values[c]]
    if len(set(rest + new)) < len(rest + new):
        raise ValueError("a one-hot column name is already taken")
    return df.select(*[col(c) for c in rest], *[
        F.coalesce(col(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}")
        for c in columns for v in values[c]])


def onehot_sparse(df: DataFrame, columns: Sequence[str] | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    """Categorical columns as one sparse vector per row, however many categories there are.

    Returns the rows, with ``onehot`` (``size``, ``indices``, ``values``, as a sparse vector
    holds them) in place of the columns, and the places ``(place, column, value)``: columns in
    schema order, values in their order. A missing value has no place. Neither categories nor
    rows come to the driver, only the number of categories per column.
    """
    columns = pick(df, columns, CATEGORICAL)
    rest = [c for c in df.columns if c not in columns]
    codes = label_codes(df, columns)
    sizes = dict(codes.groupBy("column").count().collect())
    first, total = {}, 0
    for c in columns:
        first[c], total = total, total + sizes.get(c, 0)
    encoded = label_encode(df, columns, codes)
    indices = F.array_compact(F.array(*[
        (col(c + "_encoded") + F.lit(first[c])).cast("int") for c in columns]))
    rows = encoded.select(*[col(c) for c in rest], F.struct(
        F.lit(total).alias("size"), indices.alias("indices"),
        F.array_repeat(F.lit(1.0), F.size(indices)).alias("values")).alias("onehot"))
    start = F.lit(0)
    for c in columns:
        start = F.when(F.col("column") == c, F.lit(first[c])).otherwise(start)
    return rows, codes.select((F.col("code") + start).cast("int").alias("place"), "column",
                              "value")


def standardize(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(x - mean) / std`` of the numeric columns, with the population deviation.

    A constant column becomes 0; missing values stay missing.
    """
    columns = pick(df, columns, NUMERIC)
    if not columns:
        return df
    stats = as_doubles(df, columns).agg(*[
        e for c in columns for e in (F.avg(col(c)), F.stddev_pop(col(c)))]).first()
    scale = {c: (stats[2 * i], stats[2 * i + 1]) for i, c in enumerate(columns)}
    out = []
    for c in df.columns:
        if c in scale and scale[c][0] is not None:
            mean, std = scale[c]
            out.append(((col(c).cast("double") - F.lit(mean)) / F.lit(std or 1.0)).alias(c))
        elif c in scale:
            out.append(col(c).cast("double").alias(c))
        else:
            out.append(col(c))
    return missing_as_null(df).select(*out)
