"""Cleaning: duplicate rows, sparse columns, missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scale
from ..functions.columns import (BOOLEAN, CATEGORICAL, DATETIME, NUMERIC, as_doubles, col,
                                 columns_of, comparable_columns, complete, missing_as_null,
                                 type_group)
from .frequency import column_modes
from .profile import repeated_hashes
from .quantiles import column_quantiles

MAX_MISSING = 0.5
UNKNOWN = "Unknown"


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row of each set of equal rows, as it stands; missing values count as equal.

    Rows whose hash does not repeat are not compared, and stay where they are if the
    repeated hashes can be broadcast. Of equal rows that differ in writing (0.0 and
    -0.0), the one whose JSON text is smallest stays.
    """
    rows = missing_as_null(df)
    if not df.columns:
        return rows.distinct()
    keys = comparable_columns(rows)
    repeated, size = repeated_hashes(rows.select(*keys))
    if size == 0:
        return rows
    if size * scale.ROW_BYTES <= scale.BROADCAST_BYTES:
        repeated = F.broadcast(repeated)
    hashed = rows.withColumn("_hash", F.xxhash64(*keys))
    row = F.struct(*[col(c) for c in rows.columns])
    copies = (hashed.join(repeated, "_hash", "left_semi").groupBy(F.struct(*keys).alias("_key"))
              .agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*"))
    return hashed.join(repeated, "_hash", "left_anti").drop("_hash").unionByName(copies)


def missing_share(df: DataFrame) -> dict[str, float]:
    """Share of missing values per column, of all rows; 0 on an empty table."""
    row = missing_as_null(df).agg(F.count(F.lit(1)).alias("n"), *[
        F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return {c: (row["n"] - row[f"c{i}"]) / row["n"] if row["n"] else 0.0
            for i, c in enumerate(df.columns)}


def drop_sparse_columns(df: DataFrame, max_missing: float = MAX_MISSING) -> DataFrame:
    """Drop the columns whose missing share is above the limit."""
    share = missing_share(df)
    return df.select(*[col(c) for c in df.columns if share[c] <= max_missing])


def dropna_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which no numeric column (or none of the named ones) is missing."""
    wanted = columns_of(df, NUMERIC) if columns is None else list(columns)
    return complete(missing_as_null(df), wanted)


def impute(df: DataFrame, strategy: str = "smart", max_missing: float = MAX_MISSING) -> DataFrame:
    """Drop sparse columns, then fill the missing values of the others.

    Numeric columns take the mean (``mean``) or the median (``median``, ``smart``
    and any other name); text, boolean and datetime columns take the mode. A
    numeric column with missing values becomes double. Only columns that have
    missing values are looked at again.
    """
    share = missing_share(df)
    kept = missing_as_null(df.select(*[col(c) for c in df.columns if share[c] <= max_missing]))
    gaps = [c for c in kept.columns if share[c] > 0]
    numeric = [c for c in gaps if type_group(kept.schema[c].dataType) == NUMERIC]
    other = [c for c in gaps if type_group(kept.schema[c].dataType)
             in (CATEGORICAL, BOOLEAN, DATETIME)]

    fill: dict = {}
    if numeric and strategy == "mean":
        means = as_doubles(kept, numeric).agg(*[F.avg(col(c)) for c in numeric]).first()
        fill.update(dict(zip(numeric, means)))
    elif numeric:
        fill.update({c: f["quantiles"][0]
                     for c, f in column_quantiles(kept, numeric, [0.5]).items()})
    if other:
        fill.update({r["column"]: r["mode"] for r in column_modes(kept, other).collect()})

    out = []
    for f in kept.schema.fields:
        c = col(f.name)
        if f.name in numeric:
            value = fill[f.name]
            c = c.cast("double") if value is None else F.coalesce(c.cast("double"), F.lit(value))
        elif f.name in other:
            value = fill.get(f.name)
            if value is None and isinstance(f.dataType, T.StringType):
                value = UNKNOWN
            if value is not None:
                c = F.coalesce(c, F.lit(value).cast(f.dataType))
        out.append(c.alias(f.name))
    return kept.select(*out)
