"""Table profile: shape, types, missing values, duplicate rows, data size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scale
from ..functions.columns import (CATEGORICAL, NUMERIC, col, columns_of, comparable,
                                 missing_as_null, rows_to_columns, type_group)
from ..functions.scale import settle

FIXED_BYTES = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def _bytes(field: T.StructField) -> Column:
    """Logical bytes of a column's non-null values."""
    c = col(field.name)
    if type_group(field.dataType) == CATEGORICAL:
        return F.sum(F.octet_length(c).cast("long"))
    if isinstance(field.dataType, T.BinaryType):
        return F.sum(F.octet_length(c).cast("long"))
    if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
        return F.sum(F.octet_length(F.to_json(c)).cast("long"))
    width = FIXED_BYTES.get(field.dataType.simpleString(), 8)
    return F.count(c) * F.lit(width)


def identify_types(df: DataFrame) -> DataFrame:
    """``(position, column, dtype, type_group, n_values)`` for every column."""
    table = missing_as_null(df)
    return table.agg(*[F.count(col(f.name)).alias(f"c{i}")
                       for i, f in enumerate(df.schema.fields)]).select(rows_to_columns([
                           F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                                    F.lit(f.dataType.simpleString()).alias("dtype"),
                                    F.lit(type_group(f.dataType)).alias("type_group"),
                                    F.col(f"c{i}").alias("n_values"))
                           for i, f in enumerate(df.schema.fields)]))


def missing_profile(df: DataFrame) -> DataFrame:
    """``(column, n_rows, n_missing, pct_missing)``; one pass over all columns."""
    table = missing_as_null(df)
    fields = df.schema.fields
    wide = table.agg(F.count(F.lit(1)).alias("n"),
                     *[F.count(col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)])
    return wide.select(rows_to_columns([
        F.struct(F.lit(f.name).alias("column"), F.col("n").alias("n_rows"),
                 (F.col("n") - F.col(f"c{i}")).alias("n_missing"),
                 (F.try_divide(F.col("n") - F.col(f"c{i}"), F.col("n")) * 100.0)
                 .alias("pct_missing"))
        for i, f in enumerate(fields)]))


def data_bytes(df: DataFrame) -> DataFrame:
    """``(column, data_bytes)``: logical size of the values of each column."""
    fields = df.schema.fields
    return df.agg(*[F.coalesce(_bytes(f), F.lit(0)).cast("long").alias(f"c{i}")
                    for i, f in enumerate(fields)]).select(rows_to_columns([
                        F.struct(F.lit(f.name).alias("column"), F.col(f"c{i}").alias("data_bytes"))
                        for i, f in enumerate(fields)]))


def repeated_hashes(rows: DataFrame) -> tuple[DataFrame, int]:
    """The row hashes ``_hash`` that occur more than once, and how many there are.

    Only a 64-bit hash per row is shuffled. Rows whose hash is unique are unique, so
    just the others have to be compared in full.
    """
    repeated = settle(rows.select(row_hash(rows).alias("_hash")).groupBy("_hash")
                      .agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("_hash"))
    return repeated, repeated.count()


def row_hash(rows: DataFrame) -> Column:
    """Hash of a whole comparable row."""
    return F.xxhash64(*[col(c) for c in rows.columns])


def count_duplicates(df: DataFrame) -> int:
    """Rows minus distinct rows; missing values count as equal."""
    if not df.columns:
        return 0
    rows = comparable(df)
    repeated, size = repeated_hashes(rows)
    if size == 0:
        return 0
    if size * scale.ROW_BYTES <= scale.BROADCAST_BYTES:
        rows = rows.withColumn("_hash", row_hash(rows)).join(
            F.broadcast(repeated), "_hash", "left_semi").drop("_hash")
    copies = rows.groupBy(*[col(c) for c in rows.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0))).first()[0]


def duplicate_count(df: DataFrame) -> DataFrame:
    """``(n_rows, n_distinct, n_duplicates)``."""
    copies = count_duplicates(df)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", (F.col("n_rows") - F.lit(copies)).alias("n_distinct"),
        F.lit(copies).cast("long").alias("n_duplicates"))


def quality_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, missing values and size, with the table's duplicates.

    ``(position, column, dtype, type_group, n_rows, n_missing, pct_missing,
    data_bytes, duplicate_rows)``
    """
    table = missing_as_null(df)
    fields = df.schema.fields
    copies = count_duplicates(df)
    n = F.col("n")
    wide = table.agg(F.count(F.lit(1)).alias("n"), *[
        e for i, f in enumerate(fields) for e in (
            F.count(col(f.name)).alias(f"c{i}"),
            F.coalesce(_bytes(f), F.lit(0)).cast("long").alias(f"b{i}"))])
    return wide.select(rows_to_columns([
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.lit(type_group(f.dataType)).alias("type_group"),
                 n.alias("n_rows"), (n - F.col(f"c{i}")).alias("n_missing"),
                 (F.try_divide(n - F.col(f"c{i}"), n) * 100.0).alias("pct_missing"),
                 F.col(f"b{i}").alias("data_bytes"),
                 F.lit(copies).cast("long").alias("duplicate_rows"))
        for i, f in enumerate(fields)]))


@dataclass(frozen=True)
class Overview:
    """Totals of a table."""

    n_rows: int
    n_columns: int
    n_numerical: int
    n_categorical: int
    n_missing: int
    columns_with_missing: int
    n_duplicates: int
    data_bytes: int


def overview(df: DataFrame) -> Overview:
    """The totals, from one aggregate and one duplicate count."""
    table, fields = missing_as_null(df), df.schema.fields
    row = table.agg(F.count(F.lit(1)).alias("n"), *[
        e for i, f in enumerate(fields) for e in (
            F.count(col(f.name)).alias(f"c{i}"),
            F.coalesce(_bytes(f), F.lit(0)).cast("long").alias(f"b{i}"))]).first()
    missing = [row["n"] - row[f"c{i}"] for i in range(len(fields))]
    return Overview(row["n"], len(fields), len(columns_of(df, NUMERIC)),
                    len(columns_of(df, CATEGORICAL)), sum(missing),
                    sum(m > 0 for m in missing), count_duplicates(df),
                    sum(row[f"b{i}"] for i in range(len(fields))))


def dataset_overview(df: DataFrame) -> DataFrame:
    """The overview as one row."""
    o = overview(df)
    return df.sparkSession.createDataFrame(
        [tuple(vars(o).values())], ", ".join(f"{k} long" for k in vars(o)))
