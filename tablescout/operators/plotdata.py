"""The numbers behind the plots: histograms, counts, boxes and binned scatters."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import edges, equal_width
from ..functions.columns import (CATEGORICAL, NUMERIC, as_doubles, col, columns_of, finite, melt,
                                 pick)
from ..functions.scale import attach, settle
from .frequency import value_counts
from .outliers import IQR_FACTOR
from .quantiles import column_quantiles, group_quantiles

HISTOGRAM_BINS = 30
SCATTER_BINS = 20
SCATTER_COLUMNS = 5
GRID_COLUMNS = 2


def _ends(table: DataFrame, columns: Sequence[str]) -> dict[str, tuple[Column, Column]]:
    if not columns:
        return {}
    row = table.agg(*[e for c in columns for e in (F.min(col(c)), F.max(col(c)))]).first()
    return {c: (F.lit(row[2 * i]), F.lit(row[2 * i + 1]))
            for i, c in enumerate(columns) if row[2 * i] is not None}


def histogram(df: DataFrame, columns: Sequence[str] | None = None,
              bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``(column, bin, lower, upper, n)`` for each numeric column, empty bins included."""
    columns = pick(df, columns, NUMERIC)
    table = finite(df, columns)
    ends = _ends(table, columns)
    if not ends:
        return df.sparkSession.createDataFrame(
            [], "column string, bin int, lower double, upper double, n long")
    binned = table.select(*[equal_width(col(c), *ends[c], bins).alias(c) for c in ends])
    counts = (melt(binned, list(ends), value="bin").where(F.col("bin").isNotNull())
              .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n")))
    wide = {c: edges(*ends[c]) for c in ends}
    grid = df.sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), lo.alias("lo"), hi.alias("hi"))
        for c, (lo, hi) in wide.items()])).alias("g")).select("g.*").select(
            "*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return grid.join(counts, ["column", "bin"], "left").select(
        "column", "bin", (F.col("lo") + step * F.col("bin")).alias("lower"),
        (F.col("lo") + step * (F.col("bin") + 1)).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"))


def count_plot(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, value, n)``, most frequent first within a column."""
    return value_counts(df, columns).orderBy("column", F.desc("n"), "value")


def boxplot(df: DataFrame, columns: Sequence[str] | None = None,
            facts: dict[str, dict] | None = None) -> DataFrame:
    """``(column, n, q1, median, q3, whisker_low, whisker_high, n_outliers)``.

    Whiskers end at the last values within 1.5 quartile distances of the box.
    """
    columns = pick(df, columns, NUMERIC)
    facts = column_quantiles(df, columns) if facts is None else facts
    facts = {c: f for c, f in facts.items() if f["n"]}
    if not facts:
        return df.sparkSession.createDataFrame(
            [], "column string, n long, q1 double, median double, q3 double, "
            "whisker_low double, whisker_high double, n_outliers long")
    structs = []
    for c, f in facts.items():
        q1, q2, q3 = f["quantiles"]
        reach = IQR_FACTOR * (q3 - q1)
        near = col(c).between(F.lit(q1 - reach), F.lit(q3 + reach))
        structs.append(F.struct(
            F.lit(c).alias("column"), F.count(col(c)).alias("n"), F.lit(q1).alias("q1"),
            F.lit(q2).alias("median"), F.lit(q3).alias("q3"),
            F.min(F.when(near, col(c))).alias("whisker_low"),
            F.max(F.when(near, col(c))).alias("whisker_high"),
            F.count_if(~near).alias("n_outliers")))
    return as_doubles(df, list(facts)).agg(
        *[s.alias(f"c{i}") for i, s in enumerate(structs)]).select(
            F.inline(F.array(*[F.col(f"c{i}") for i in range(len(structs))])))


def _boxes(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    rows = rows.where(F.col(value).isNotNull())
    for k in keys:
        rows = rows.where(col(k).isNotNull())
    quartiles = settle(group_quantiles(rows, keys, value).select(
        *keys, F.col("n").alias("_n"), F.col("quantiles")[0].alias("q1"),
        F.col("quantiles")[1].alias("median"), F.col("quantiles")[2].alias("q3")))
    reach = F.lit(IQR_FACTOR) * (F.col("q3") - F.col("q1"))
    near = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return attach(rows, quartiles, keys, "_n").groupBy(*keys).agg(
        F.count(value).alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"), F.min(F.when(near, F.col(value))).alias("whisker_low"),
        F.max(F.when(near, F.col(value))).alias("whisker_high"),
        F.count_if(~near).alias("n_outliers"))


def boxplot_by_category(df: DataFrame, category: str | None = None,
                        number: str | None = None) -> DataFrame:
    """Box statistics of a numeric column per value of a categorical one.

    ``(category, n, q1, median, q3, whisker_low, whisker_high, n_outliers)``; the
    first column of each kind is taken when none is named.
    """
    category = category or next(iter(columns_of(df, CATEGORICAL)), None)
    number = number or next(iter(columns_of(df, NUMERIC)), None)
    if category is None or number is None:
        return df.sparkSession.createDataFrame(
            [], "category string, n long, q1 double, median double, q3 double, "
            "whisker_low double, whisker_high double, n_outliers long")
    rows = as_doubles(df, [number], [category]).select(
        col(category).cast("string").alias("category"), col(number).alias("value"))
    return _boxes(rows, ["category"], "value")


def boxplot_grid(df: DataFrame, first: int = GRID_COLUMNS) -> DataFrame:
    """Box statistics of the first numeric columns by the first categorical ones.

    ``(category_column, category, number_column, n, q1, ...)``
    """
    categories = columns_of(df, CATEGORICAL)[:first]
    numbers = columns_of(df, NUMERIC)[:first]
    if not categories or not numbers:
        return df.sparkSession.createDataFrame(
            [], "category_column string, category string, number_column string, n long, "
            "q1 double, median double, q3 double, whisker_low double, whisker_high double, "
            "n_outliers long")
    rows = as_doubles(df, numbers, categories).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("category_column"), col(c).cast("string").alias("category"),
                 F.lit(x).alias("number_column"), col(x).alias("value"))
        for c in categories for x in numbers])).alias("r")).select("r.*")
    return _boxes(rows, ["category_column", "category", "number_column"], "value")


def scatter_matrix(df: DataFrame, max_cols: int = SCATTER_COLUMNS, bins: int = SCATTER_BINS,
                   columns: Sequence[str] | None = None) -> DataFrame:
    """``(x, y, bin_x, bin_y, n)`` for each pair of the first numeric columns, or of those named."""
    columns = pick(df, columns, NUMERIC)[:max_cols if columns is None else None]
    table = finite(df, columns)
    ends = _ends(table, columns)
    pairs = list(combinations(list(ends), 2))
    if not pairs:
        return df.sparkSession.createDataFrame(
            [], "x string, y string, bin_x int, bin_y int, n long")
    binned = table.select(*[equal_width(col(c), *ends[c], bins).alias(c) for c in ends])
    return (binned.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), col(a).alias("bin_x"),
                 col(b).alias("bin_y")) for a, b in pairs])).alias("p")).select("p.*")
        .where(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull())
        .groupBy("x", "y", "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n")))


def pair_plot(df: DataFrame, max_cols: int = SCATTER_COLUMNS, bins: int = SCATTER_BINS,
              columns: Sequence[str] | None = None) -> DataFrame:
    """``(x, y, bin_x, bin_y, n)``: binned scatters of the first numeric columns (or of those
    named), and on the diagonal (``x = y``) the histogram of a column, without ``bin_y``.

    Diagonal and pairs are counted in one aggregate over binned rows.
    """
    columns = pick(df, columns, NUMERIC)[:max_cols if columns is None else None]
    table = finite(df, columns)
    ends = _ends(table, columns)
    if not ends:
        return df.sparkSession.createDataFrame(
            [], "x string, y string, bin_x int, bin_y int, n long")
    binned = table.select(*[equal_width(col(c), *ends[c], bins).alias(c) for c in ends])

    def cell(a: str, b: str) -> Column:
        return F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), col(a).alias("bin_x"),
                        (F.lit(None).cast("int") if a == b else col(b)).alias("bin_y"))

    cells = [(c, c) for c in ends] + list(combinations(list(ends), 2))
    return (binned.select(F.explode(F.array(*[cell(a, b) for a, b in cells])).alias("p"))
            .select("p.*").where(F.col("bin_x").isNotNull()
                                 & ((F.col("x") == F.col("y")) | F.col("bin_y").isNotNull()))
            .groupBy("x", "y", "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n")))


def scatter(df: DataFrame, x: str, y: str, color: str | None = None,
            bins: int = 50) -> DataFrame:
    """``(color, bin_x, bin_y, n)``: a binned scatter of two columns by a third."""
    shade = col(color).cast("string") if color else F.lit(None).cast("string")
    table = finite(df.withColumn("_color", shade), [x, y], ["_color"])
    ends = _ends(table, [x, y])
    if len(ends) < 2:
        return df.sparkSession.createDataFrame(
            [], "color string, bin_x int, bin_y int, n long")
    return (table.where(col(x).isNotNull() & col(y).isNotNull())
            .groupBy(F.col("_color").alias("color"),
                     equal_width(col(x), *ends[x], bins).alias("bin_x"),
                     equal_width(col(y), *ends[y], bins).alias("bin_y"))
            .agg(F.count(F.lit(1)).alias("n")))
