"""Relations between numeric columns: correlation, regression, mutual information.

All pairs come from partial cross-product matrices (``products``): two passes, however many
columns and pairs there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import equal_width
from ..functions.columns import NUMERIC, as_doubles, col, complete, finite, melt, pick
from ..functions import scale
from ..functions.scale import attach, running_total, settle
from .products import Facts, column_facts, cross_products, pair_products, rank_tables

STRONG = 0.7
THRESHOLD = 0.5
MI_BINS = 10
ENTRY_BYTES = 16        # of a value and its rank in a lookup table
PAIR_SCHEMA = "var1 string, var2 string, correlation double"


def _unit(r: Column) -> Column:
    """Within -1 and 1; NULL where infinite values leave no number."""
    return F.when(r.isNotNull() & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _named(place: Column | str, names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col(place) + 1)


def pearson(df: DataFrame, columns: Sequence[str] | None = None,
            facts: dict[str, Facts] | None = None) -> DataFrame:
    """``(var1, var2, correlation)`` for each pair, var1 first in the schema.

    Each pair uses the rows in which both are present; NULL if one is constant there or holds
    an infinite value. Fewer than two numeric columns give no rows.
    """
    columns = pick(df, columns, NUMERIC)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    facts = facts or column_facts(df, columns)
    sums = cross_products(df, columns, [facts[c].mean for c in columns]).where("i < j")
    n = F.col("n")
    vi = F.col("s_ii") - F.try_divide(F.col("s_i") * F.col("s_i"), n)
    vj = F.col("s_jj") - F.try_divide(F.col("s_j") * F.col("s_j"), n)
    r = ((F.col("s_ij") - F.try_divide(F.col("s_i") * F.col("s_j"), n))
         / (F.sqrt(vi) * F.sqrt(vj)))
    varied = F.array(*[F.lit(not facts[c].constant) for c in columns])
    usable = (F.element_at(varied, F.col("i") + 1) & F.element_at(varied, F.col("j") + 1)
              & (F.col("infinite") == 0) & (vi > F.col("s_ii") * 1e-12)
              & (vj > F.col("s_jj") * 1e-12))
    return sums.select(_named("i", columns).alias("var1"), _named("j", columns).alias("var2"),
                       F.when(usable, _unit(r)).alias("correlation"))


def spearman(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(var1, var2, correlation)`` of average ranks, for each pair.

    Ranks are taken among the rows in which both are present: a column is ranked
    once, and once more for each partner whose gaps take rows away from it. Distinct values are
    counted, for all partners at once, before they are ordered. Columns of few distinct values
    are ranked where their rows stand, by a lookup table. The values of the others are a long
    table of (row, column, value): one join that spreads frequent values gives them all their
    ranks, and one shuffle brings the ranks of a row together.
    """
    columns = pick(df, columns, NUMERIC)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    pairs = list(combinations(range(len(columns)), 2))
    # Adding zero turns -0.0 into 0.0, which the join of ranks relies on.
    rows = settle(as_doubles(df, columns).select(
        F.monotonically_increasing_id().alias("_row"),
        F.array(*[col(c) + F.lit(0.0) for c in columns]).alias("_values")))
    value = [F.col("_values")[i] for i in range(len(columns))]
    n, *present = rows.agg(F.count(F.lit(1)), *[F.count(v) for v in value]).first()
    if min(present) == n:
        both = dict.fromkeys(pairs, n)
    else:
        names = [f"x{i}" for i in range(len(columns))]
        both = {(r["i"], r["j"]): int(r["n"]) for r in cross_products(
            rows.select(*[v.alias(c) for v, c in zip(value, names)]), names,
            [0.0] * len(names)).select("i", "j", "n").collect()}

    # One ranked column per (column, partner that removes rows, if any).
    places: dict[tuple[int, int | None], int] = {}

    def ranked(i: int, partner: int, pair: tuple[int, int]) -> int:
        key = (i, None if both.get(pair, 0) == present[i] else partner)
        return places.setdefault(key, len(places))

    sides = [(ranked(i, j, (i, j)), ranked(j, i, (i, j))) for i, j in pairs]
    own: list[list[int]] = [[] for _ in columns]        # the places of a column
    kinds: list[list[Column]] = [[] for _ in columns]
    for (i, j), place in places.items():
        kinds[i].append(F.struct(F.lit(place).alias("place"), F.lit(len(own[i])).alias("kind"),
                                 F.col("all" if j is None else f"with{j}").alias("ties")))
        own[i].append(place)
    counted = rows.select(F.posexplode("_values").alias("column", "value"), *[
        value[j].isNotNull().cast("long").alias(f"with{j}")
        for j in sorted({j for _, j in places if j is not None})]).where(
            F.col("value").isNotNull())
    counted = counted.groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("all"), *[F.sum(c).alias(c) for c in counted.columns[2:]])
    of_column = F.when(F.lit(False), F.array(kinds[0][0]))
    for i, k in enumerate(kinds):
        of_column = of_column.when(F.col("column") == i, F.array(*k))
    counts = settle(counted.select("column", "value", "all", F.explode(of_column).alias("_k"))
                    .select("column", "value", "all", "_k.*").where("ties > 0"))
    ranks = settle(running_total(counts, ["place"], "value", "ties").withColumn(
        "rank", F.col("before") + (F.col("ties") + 1) / F.lit(2.0)).drop("before", "position"))
    t = F.col("ties").cast("double")
    totals = {r["place"]: r for r in ranks.groupBy("place").agg(
        F.sum("ties").alias("n"), F.sum(t * t * t - t).alias("tied"),
        F.count(F.lit(1)).alias("distinct")).collect()}

    def deviation(place: int) -> float:
        if place not in totals or totals[place]["distinct"] < 2:
            return 0.0
        n = float(totals[place]["n"])
        return math.sqrt(max((n ** 3 - n - totals[place]["tied"]) / 12.0, 0.0))

    # The columns whose ranks every task can hold, smallest first.
    size = [sum(ENTRY_BYTES * totals[x]["distinct"] for x in own[i] if x in totals)
            for i in range(len(columns))]
    small, held = [], 0
    for i in sorted(range(len(columns)), key=size.__getitem__):
        held += size[i]
        if held <= scale.BROADCAST_BYTES:
            small.append(i)
    large = [i for i in range(len(columns)) if i not in small]
    tables = rank_tables(ranks.where(F.col("column").isin(small)).select(
        "place", "value", "rank").toArrow() if small else None, [own[i] for i in small])

    few = F.array(*[value[i] for i in small]).cast("array<double>")
    width = max((len(own[i]) for i in large), default=0)
    parts = rows.select("_row", F.lit(-1).alias("column"), *[
        F.lit(None).cast("double").alias(f"r{k}") for k in range(width)], few.alias("few"))
    if large:
        of_large = ranks.where(F.col("column").isin(large))
        if width == 1:
            lookup = of_large.select("column", "value", "all", F.col("rank").alias("r0"))
        else:
            lookup = settle(of_large.groupBy("column", "value").agg(F.max("all").alias("all"), *[
                F.max(F.when(F.col("kind") == k, F.col("rank"))).alias(f"r{k}")
                for k in range(width)]))
        long = rows.select("_row", F.explode(F.array(*[
            F.struct(F.lit(i).alias("column"), value[i].alias("value")) for i in large])).alias("_v")
        ).select("_row", "_v.*").where(F.col("value").isNotNull())
        found = attach(long, lookup, ["column", "value"], "all").select(
            "_row", "column", *[f"r{k}" for k in range(width)],
            F.lit(None).cast("array<double>").alias("few"))
        parts = (found.unionByName(parts) if small else found).repartition(
            "_row").sortWithinPartitions("_row")
    sums = pair_products(parts, len(places), sides, [(both.get(p, 0) + 1) / 2.0 for p in pairs],
                         own, tables)
    facts = df.sparkSession.createDataFrame(
        [(k, columns[i], columns[j], deviation(x), deviation(y))
         for k, ((i, j), (x, y)) in enumerate(zip(pairs, sides))],
        "pair int, var1 string, var2 string, dev1 double, dev2 double")
    r = F.try_divide(F.try_divide(F.col("s"), F.col("dev1")), F.col("dev2"))
    return facts.join(sums, "pair", "left").select("var1", "var2", _unit(r).alias("correlation"))


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(method, var1, var2, correlation)``: Pearson and Spearman."""
    return (pearson(df, columns).withColumn("method", F.lit("pearson"))
            .unionByName(spearman(df, columns).withColumn("method", F.lit("spearman")))
            .select("method", "var1", "var2", "correlation"))


def correlation_heatmap(df: DataFrame, columns: Sequence[str] | None = None,
                        pairs: DataFrame | None = None) -> DataFrame:
    """The full Pearson matrix ``(var1, var2, correlation)``, rounded to two places."""
    columns = pick(df, columns, NUMERIC)
    half = pearson(df, columns) if pairs is None else pairs
    if len(columns) < 2:
        return half
    cells = half.select(F.explode(F.array(
        F.struct("var1", "var2", "correlation"),
        F.struct(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "correlation"))
    ).alias("c")).select("c.*")
    diagonal = df.sparkSession.createDataFrame(
        [(c, c, None if f.constant else 1.0) for c, f in column_facts(df, columns).items()],
        PAIR_SCHEMA)
    return cells.unionByName(diagonal).withColumn("correlation", F.round("correlation", 2))


def strong_relationships(df: DataFrame, threshold: float = THRESHOLD,
                         columns: Sequence[str] | None = None,
                         pairs: DataFrame | None = None) -> DataFrame:
    """``(var1, var2, correlation, strength)`` of pairs with ``|r| >= threshold``."""
    size = F.abs(F.col("correlation"))
    found = pearson(df, columns) if pairs is None else pairs
    return found.where(size >= threshold).withColumn(
        "strength", F.when(size > STRONG, "strong").otherwise("moderate"))


@dataclass(frozen=True)
class Moments:
    """Count, means and sample covariance of the complete rows."""

    columns: list[str]
    n: int
    mean: np.ndarray
    covariance: np.ndarray

    @property
    def usable(self) -> bool:
        """Whether there are two rows or more and no infinite value among them."""
        return self.n > 1 and bool(np.isfinite(self.mean).all()
                                   and np.isfinite(self.covariance).all())


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Moments over the rows in which no column is missing; the matrix is p by p."""
    columns = list(columns)
    facts, p = column_facts(df, columns, complete=True), len(columns)
    n = min((f.n for f in facts.values()), default=0)
    if n < 2:
        return Moments(columns, n, np.zeros(p), np.zeros((p, p)))
    if any(f.infinite for f in facts.values()):
        return Moments(columns, n, np.full(p, np.nan), np.full((p, p), np.nan))
    centre = np.array([facts[c].mean for c in columns])
    shift, covariance = np.zeros(p), np.zeros((p, p))
    for r in cross_products(df, columns, centre, complete=True).collect():
        i, j = r["i"], r["j"]
        shift[i] = r["s_i"] / n if i == j else shift[i]
        covariance[i, j] = covariance[j, i] = (r["s_ij"] - r["s_i"] * r["s_j"] / n) / (n - 1)
    return Moments(columns, n, centre + shift, covariance)


@dataclass(frozen=True)
class LinearFit:
    """Ordinary least squares of one column on all others."""

    target: str
    features: list[str]
    coefficients: dict[str, float]
    intercept: float
    r2: float

    def table(self, df: DataFrame) -> DataFrame:
        """``(term, value)``: coefficients, ``(intercept)`` and ``(r2)``."""
        return df.sparkSession.createDataFrame(
            [*self.coefficients.items(), ("(intercept)", self.intercept), ("(r2)", self.r2)],
            "term string, value double")

    def predict(self, df: DataFrame) -> DataFrame:
        """``(actual, predicted)`` for the complete rows."""
        columns = [*self.features, self.target]
        table = complete(as_doubles(df, columns), columns)
        guess = F.lit(self.intercept)
        for c, b in self.coefficients.items():
            guess = guess + col(c) * F.lit(b)
        return table.select(col(self.target).alias("actual"), guess.alias("predicted"))


def _least_squares(m: Moments) -> tuple[np.ndarray, float]:
    """Coefficients of the last column on the others, of smallest norm if not unique."""
    s_xx, s_xy, s_yy = m.covariance[:-1, :-1], m.covariance[:-1, -1], m.covariance[-1, -1]
    deviation = np.sqrt(np.diag(s_xx))
    scale = np.where(deviation > 0, deviation, 1.0)
    values, vectors = np.linalg.eigh(s_xx / np.outer(scale, scale))
    free = values <= 1e-10 * max(values.max(initial=0.0), 1e-300)
    basis = vectors[:, ~free]
    beta = (basis @ ((basis.T @ (s_xy / scale)) / values[~free])) / scale
    if free.any():
        # Collinear columns: take out the part that does not change any prediction.
        null = np.linalg.qr(vectors[:, free] / scale[:, None])[0]
        beta = beta - null @ (null.T @ beta)
    residual = s_yy - 2 * beta @ s_xy + beta @ s_xx @ beta
    return beta, float(1.0 - residual / s_yy) if s_yy > 0 else 1.0


def linear_regression(df: DataFrame, target: str | None = None,
                      columns: Sequence[str] | None = None) -> LinearFit | None:
    """Fit the target (the last numeric column) on all other numeric columns.

    None if the target is not numeric, no feature is left, under two rows are complete,
    or a complete row holds an infinite value.
    """
    columns = pick(df, columns, NUMERIC)
    target = target or (columns[-1] if columns else None)
    if target not in columns or len(columns) < 2:
        return None
    features = [c for c in columns if c != target]
    m = moments(df, [*features, target])
    if not m.usable:
        return None
    beta, r2 = _least_squares(m)
    return LinearFit(target, features, {c: float(b) for c, b in zip(features, beta)},
                     float(m.mean[-1] - beta @ m.mean[:-1]), r2)


def mutual_information(df: DataFrame, target: str | None = None,
                       columns: Sequence[str] | None = None, bins: int = MI_BINS) -> DataFrame:
    """``(feature, mi)`` in nats between equal-width bins of each feature and the target.

    Uses the complete rows; an infinite value has no bin and counts as missing. Only bin counts are shuffled. Highest first.
    """
    empty = df.sparkSession.createDataFrame([], "feature string, mi double")
    columns = pick(df, columns, NUMERIC)
    target = target or (columns[-1] if columns else None)
    if target not in columns or len(columns) < 2:
        return empty
    table = complete(finite(df, columns), columns)
    ends = table.agg(*[e for c in columns for e in (F.min(col(c)), F.max(col(c)))]).first()
    if ends[0] is None:
        return empty
    binned = table.select(*[
        equal_width(col(c), F.lit(ends[2 * i]), F.lit(ends[2 * i + 1]), bins).alias(c)
        for i, c in enumerate(columns)])
    features = [c for c in columns if c != target]
    joint = melt(binned, features, [target], "feature", "x").select(
        "feature", "x", col(target).alias("y")).groupBy("feature", "x", "y").agg(
            F.count(F.lit(1)).cast("double").alias("n"))

    def margin(*by: str) -> Column:
        return F.sum("n").over(Window.partitionBy("feature", *by))

    cells = joint.select("feature", "n", margin("x").alias("nx"), margin("y").alias("ny"),
                         margin().alias("total"))
    term = F.col("n") / F.col("total") * F.log(
        F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))
    return (cells.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))
            .orderBy(F.desc("mi"), "feature"))
