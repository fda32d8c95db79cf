"""Column naming, type groups and small column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, CATEGORICAL, DATETIME, BOOLEAN, OTHER = (
    "numerical", "categorical", "datetime", "boolean", "other")


def q(name: str) -> str:
    """Back-quote a column name, so that dots and blanks in it are literal."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def type_group(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return CATEGORICAL
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    return OTHER


def columns_of(df: DataFrame, group: str) -> list[str]:
    """Names of the columns of one type group, in schema order."""
    return [f.name for f in df.schema.fields if type_group(f.dataType) == group]


def pick(df: DataFrame, columns: Sequence[str] | None, group: str) -> list[str]:
    """The wanted columns of a group; all of them when none are named."""
    available = columns_of(df, group)
    if columns is None:
        return available
    wrong = [c for c in columns if c not in available]
    if wrong:
        raise ValueError(f"not {group} columns of the table: {wrong}")
    return list(columns)


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN and NULL both mean "missing": keep only NULL."""
    if not any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in df.schema.fields):
        return df
    return df.select(*[
        F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else col(f.name)
        for f in df.schema.fields])


def as_doubles(df: DataFrame, columns: Iterable[str], keep: Sequence[str] = ()) -> DataFrame:
    """Project numeric columns as doubles with missing values as NULL."""
    columns = list(columns)
    kept = [col(c) for c in keep if c not in columns]
    return missing_as_null(
        df.select(*kept, *[col(c).cast("double").alias(c) for c in columns]))


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (),
         name: str = "column", value: str = "value") -> DataFrame:
    """Long form ``(keep..., name, value)``; the columns must share a type."""
    return df.unpivot([col(c) for c in keep], [col(c) for c in columns], name, value)


def complete(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The rows in which none of the columns is NULL."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & col(c).isNotNull()
    return df.where(keep)


def finite(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as doubles; infinite values have no bin and count as missing."""
    table = as_doubles(df, columns, keep)
    return table.select(*[col(c) for c in keep], *[
        F.when(F.abs(col(c)) < float("inf"), col(c)).alias(c) for c in columns])


def comparable_columns(rows: DataFrame) -> list[Column]:
    """What rows without NaN are compared by: -0.0 is 0.0, maps and variants are text."""
    out = []
    for f in rows.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = (c + F.lit(0.0).cast(f.dataType))
        elif "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString():
            c = F.to_json(c) if "map<" in f.dataType.simpleString() else c.cast("string")
        out.append(c.alias(f.name))
    return out


def comparable(df: DataFrame) -> DataFrame:
    """Make whole rows groupable: NaN is NULL, -0.0 is 0.0, maps and variants are text."""
    rows = missing_as_null(df)
    return rows.select(*comparable_columns(rows))


def rows_to_columns(structs: Sequence[Column]) -> Column:
    """Turn one wide row into many: one output row per struct."""
    return F.inline(F.array(*structs))
