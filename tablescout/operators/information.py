"""Mutual information from distances to nearest neighbours.

For each feature, the rows are points in the plane of feature and target. A point's radius is the
largest-coordinate distance to its k-th neighbour; how many rows lie within the radius along each
axis alone gives the information. Both are exact:

* Equal points are one point with a count, so that frequent values cost nothing.
* Points are dealt into cells of about equally many, by ranges of the feature and, inside these,
  of the target. The k nearest in a point's own cell bound its radius; only cells whose box lies
  nearer than that are asked, each by the points that need it.
* Rows within an interval are the difference of two running totals of an ordered column.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import NUMERIC, col, complete, finite, pick
from ..functions.scale import attach, running_total, settle
from .products import column_facts, cross_products

NEIGHBOURS = 3
CELL = 512              # distinct points of a cell, more where there would be too many cells
CELLS = 50_000          # whose boxes every task holds
BLOCK = 2048            # points that ask one cell, in one unit of work
ROWS_AT_ONCE = 256
SAME = 1e-10            # share by which distances differ that are equal but for rounding

# What runs in tasks travels with them, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def digamma(x: Column) -> Column:
    """The digamma function of a positive number, by recurrence and the asymptotic series."""
    y = x + 8.0
    series = (F.log(y) - 0.5 / y - 1 / (12 * y ** 2) + 1 / (120 * y ** 4) - 1 / (252 * y ** 6)
              + 1 / (240 * y ** 8))
    for i in range(8):
        series = series - 1 / (x + float(i))
    return series


def _smallest(away: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distances of each row, a point counted as often as it stands; inf if
    there are fewer. ``counts`` may differ by row."""
    few = min(k + 1, away.shape[1])
    place = np.argpartition(away, few - 1, axis=1)[:, :few]
    near = np.take_along_axis(away, place, 1)
    times = np.minimum(np.take_along_axis(np.broadcast_to(counts, away.shape), place, 1), k)
    each = np.where(np.arange(k)[None, None, :] < times[:, :, None], near[:, :, None], np.inf)
    each = np.sort(each.reshape(len(away), -1), axis=1)[:, :k]
    return np.pad(each, ((0, 0), (0, k - each.shape[1])), constant_values=np.inf)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest-coordinate distances of two lists of points."""
    return np.maximum(np.abs(a[:, 0, None] - b[None, :, 0]), np.abs(a[:, 1, None] - b[None, :, 1]))


def _own(boxes: dict[int, np.ndarray], k: int):
    """The k nearest in a point's own cell, and the cells that may hold nearer ones."""
    def work(key, cell: pd.DataFrame) -> pd.DataFrame:
        points, counts = cell[["x", "y"]].to_numpy(), cell["n"].to_numpy()
        every, own = boxes[int(key[0])], int(key[1])
        near, asked = [], []
        for at in range(0, len(points), ROWS_AT_ONCE):
            some = points[at:at + ROWS_AT_ONCE]
            others = np.broadcast_to(counts, (len(some), len(counts))).copy()
            others[np.arange(len(some)), at + np.arange(len(some))] -= 1
            found = _smallest(_apart(some, points), others, k)
            reach = found[:, -1]
            far = reach.max()
            close = np.flatnonzero(
                (every[:, 1] <= some[:, 0].max() + far) & (every[:, 2] >= some[:, 0].min() - far)
                & (every[:, 3] <= some[:, 1].max() + far) & (every[:, 4] >= some[:, 1].min() - far)
                & (every[:, 0] != own))
            low, high = every[close][:, [1, 3]], every[close][:, [2, 4]]
            gap = np.maximum(np.maximum(low[None] - some[:, None], some[:, None] - high[None]), 0)
            wanted = gap.max(2) < reach[:, None]
            near += list(found)
            asked += [every[close[w], 0].astype(np.int64) for w in wanted]
        return cell[["f", "x", "y", "n"]].assign(near=near, asked=asked)
    return work


def _foreign(k: int):
    """The k nearest of a cell to points of other cells."""
    def work(key, unit: pd.DataFrame) -> pd.DataFrame:
        held, asking = unit[unit["n"] > 0], unit[unit["n"] == 0]
        points, some = held[["x", "y"]].to_numpy(), asking[["x", "y"]].to_numpy()
        near = []
        for at in range(0, len(some), ROWS_AT_ONCE):
            near += list(_smallest(_apart(some[at:at + ROWS_AT_ONCE], points),
                                   held["n"].to_numpy(), k))
        return asking[["f", "x", "y"]].assign(near=near)
    return work


def _ordered(v: np.ndarray) -> np.ndarray:
    """Floats as whole numbers in the same order; its own inverse on their bits."""
    bits = v.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF))


def _ends(v: np.ndarray, radius: np.ndarray, sign: float) -> np.ndarray:
    """The farthest floats on one side whose distance from v, as subtraction rounds it, is at
    most the radius: a bisection over all floats between."""
    good = _ordered(v)
    bad = _ordered(np.nextafter(v + sign * 2 * radius, sign * np.inf))
    for _ in range(66):
        middle = (good & bad) + ((good ^ bad) >> 1)
        value = _ordered(middle.view(np.float64)).view(np.float64)
        inside = np.abs(value - v) <= radius
        good, bad = np.where(inside, middle, good), np.where(inside, bad, middle)
    return _ordered(good.view(np.float64)).view(np.float64) + 0.0


def _intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Closed intervals of the values nearer than the radius, along both axes."""
    for batch in batches:
        radius = batch["radius"].to_numpy(float) * (1 - SAME)
        for axis, name in enumerate("xy"):
            v = batch[name].to_numpy(float) + 0.0
            yield pd.DataFrame({"f": batch["f"], "axis": axis, "lo": _ends(v, radius, -1.0),
                                "hi": _ends(v, radius, 1.0), "n": batch["n"]})


def _cells(points: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """``points`` with a number ``cell`` within their feature."""
    total = sum(sizes.values())
    strips, wide, deep = {}, {}, {}
    for f, n in sizes.items():
        cells = max(1, math.ceil(n / max(CELL, total / CELLS)))
        strips[f] = math.ceil(math.sqrt(cells))
        wide[f] = math.ceil(n / strips[f])
        deep[f] = math.ceil(wide[f] / math.ceil(cells / strips[f]))

    def of(values: dict[int, int]) -> Column:
        return F.element_at(F.array(*[F.lit(values.get(f, 1)) for f in range(max(sizes) + 1)]),
                            F.col("f") + 1)

    one = points.select("f", F.struct("x", "y").alias("p"), "n", F.lit(1).alias("one"))
    along = running_total(one, ["f"], "p", "one").select(
        "f", F.floor(F.col("position") / of(wide)).cast("int").alias("strip"),
        F.struct(F.col("p.y"), F.col("p.x")).alias("p"), "n", "one")
    inside = running_total(along, ["f", "strip"], "p", "one")
    part = F.floor(F.col("position") / of(deep)).cast("long")
    return inside.select("f", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "n",
                         (F.col("strip") * F.lit(1 << 20) + part).alias("cell"))


def _radii(points: DataFrame, k: int) -> DataFrame:
    """``(f, x, y, n, radius)``: the distance to the k-th other row."""
    sizes = {r["f"]: r["count"] for r in points.groupBy("f").count().collect()}
    placed = settle(_cells(points, sizes))
    boxes: dict[int, list] = {}
    for r in placed.groupBy("f", "cell").agg(      # at most about CELLS rows
            F.min("x"), F.max("x"), F.min("y"), F.max("y")).collect():
        boxes.setdefault(r["f"], []).append(tuple(r)[1:])
    table = {f: np.array(sorted(b), float) for f, b in boxes.items()}
    own = settle(placed.groupBy("f", "cell").applyInPandas(
        _own(table, k), "f int, x double, y double, n long, near array<double>, "
        "asked array<long>"))
    asking = settle(own.select("f", "x", "y", F.explode("asked").alias("cell")))
    units = settle(asking.groupBy("f", "cell").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("units"),
        F.count(F.lit(1)).alias("weight")))
    asked = attach(asking, units, ["f", "cell"], "weight").select(
        "f", "cell", "x", "y", F.lit(0).cast("long").alias("n"),
        F.pmod(F.xxhash64("x", "y"), F.col("units")).cast("int").alias("unit"))
    held = attach(placed, units, ["f", "cell"], "weight").where("units is not null").select(
        "f", "cell", "x", "y", "n", F.explode(F.sequence(F.lit(0), F.col("units") - 1))
        .alias("unit"))
    more = asked.unionByName(held).groupBy("f", "cell", "unit").applyInPandas(
        _foreign(k), "f int, x double, y double, near array<double>")
    every = own.select("f", "x", "y", "n", "near").unionByName(
        more.select("f", "x", "y", F.lit(0).cast("long").alias("n"), "near"))
    return every.groupBy("f", "x", "y").agg(
        F.sum("n").alias("n"), F.array_sort(F.flatten(F.collect_list("near")))[k - 1]
        .alias("radius"))


def neighbour_information(df: DataFrame, target: str | None = None,
                          columns: Sequence[str] | None = None, k: int = NEIGHBOURS) -> DataFrame:
    """``(feature, mi)`` in nats between each feature and the target, highest first.

    Values are divided by their deviation; distances are the larger of both coordinates'; a row's
    own value counts in its interval, values at the radius itself (but for rounding) do not. Rows with a missing or infinite value are left out. A
    constant feature, or no more than ``k`` rows, gives 0.
    """
    empty = df.sparkSession.createDataFrame([], "feature string, mi double")
    columns = pick(df, columns, NUMERIC)
    target = target or (columns[-1] if columns else None)
    if target not in columns or len(columns) < 2:
        return empty
    features = [c for c in columns if c != target]
    table = complete(finite(df, columns), columns)
    facts = column_facts(table, columns)
    total = facts[target].n
    varied = [f for f in features if not facts[f].constant]
    flat = df.sparkSession.createDataFrame(
        [(f, 0.0) for f in features if f not in varied or total <= k or facts[target].constant],
        "feature string, mi double")
    if not varied or total <= k or facts[target].constant:
        return flat
    used = [*varied, target]
    spread = {used[r["i"]]: math.sqrt((r["s_ii"] - r["s_i"] ** 2 / r["n"]) / r["n"])
              for r in cross_products(table, used, [facts[c].mean for c in used])
              .where("i = j").collect()}
    points = settle(table.select(F.posexplode(F.array(*[
        col(f) / F.lit(spread[f]) + F.lit(0.0) for f in varied])).alias("f", "x"),
        (col(target) / F.lit(spread[target]) + F.lit(0.0)).alias("y")).groupBy("f", "x", "y")
        .agg(F.count(F.lit(1)).alias("n")))
    radii = _radii(points, k)
    ranges = settle(radii.mapInPandas(
        _intervals, "f int, axis int, lo double, hi double, n long")
        .groupBy("f", "axis", "lo", "hi").agg(F.sum("n").alias("n")))
    values = points.select("f", "n", F.posexplode(F.array("x", "y")).alias("axis", "v")).select(
        "f", "axis", F.struct("v", F.lit(1).alias("o")).alias("e"), "n")
    ends = [ranges.select("f", "axis", F.struct(F.col(c).alias("v"), F.lit(o).alias("o"))
                          .alias("e"), F.lit(0).cast("long").alias("n"))
            for c, o in (("lo", 0), ("hi", 2))]
    counted = running_total(
        values.unionByName(ends[0]).unionByName(ends[1]).groupBy("f", "axis", "e")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("w")), ["f", "axis"], "e", "n")
    counted = settle(counted.select("f", "axis", "e.v", "e.o", "before", "w"))
    inside = ranges
    for end, order in (("lo", 0), ("hi", 2)):
        known = counted.where(F.col("o") == order).select(
            "f", "axis", F.col("v").alias(end), F.col("before").alias("_" + end), "w")
        inside = attach(inside, known, ["f", "axis", end], "w").drop("w")
    within = digamma((F.col("_hi") - F.col("_lo")).cast("double"))
    names = F.element_at(F.array(*[F.lit(f) for f in varied]), F.col("f") + 1)
    mi = (digamma(F.lit(float(total))) + digamma(F.lit(float(k)))
          - F.sum(within * F.col("n")) / F.lit(float(total)))
    found = inside.groupBy("f").agg(F.greatest(mi, F.lit(0.0)).alias("mi")).select(
        names.alias("feature"), "mi")
    return found.unionByName(flat).orderBy(F.desc("mi"), "feature")
