"""Exact quantiles of very large columns and groups.

A sketch brackets each wanted rank, one pass counts what lies below the bracket,
and only the few values inside it are counted and ordered. No task ever holds a
column's distinct values, and the answer does not depend on the sketch's error:
a bracket that misses its rank is widened to the end of the range.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scale
from ..functions.columns import as_doubles, col, melt, q
from ..functions.scale import attach, running_total, settle

QUARTILES = (0.25, 0.5, 0.75)
SKETCH = 10_000             # rank error of the sketch is n / SKETCH
MARGIN = 2.0 / SKETCH
SMALL_GROUP = 20_000        # columns up to this size are counted without a bracket
BRACKETS_AT_ONCE = 12       # brackets per scan: the optimizer is slow on long conditions


def _marks(probs: Sequence[float]) -> list[float]:
    return [m for p in probs for m in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))]


def _number(v: float) -> str:
    """A double as an SQL literal."""
    return f"{v!r}D" if math.isfinite(v) else f"double('{v}')"


def _between(a: float, b: float, part: float) -> float:
    return a if a == b else a + (b - a) * part


def column_quantiles(df: DataFrame, columns: Sequence[str],
                     probs: Sequence[float] = QUARTILES,
                     measures: Mapping[str, Callable[[Column], Column]] | None = None,
                     ) -> dict[str, dict]:
    """Exact quantiles of whole numeric columns, with other measures of the same pass.

    Gives ``{column: {"n", "lowest", "highest", "quantiles", measures...}}``: a few
    numbers per column, so the size is set by the schema. Quantiles are
    interpolated linearly between order statistics; missing values are left out.
    """
    columns, probs, measures = list(columns), list(probs), dict(measures or {})
    if not columns:
        return {}
    table = as_doubles(df, columns)
    facts = table.select([col(c).alias(f"c{i}") for i, c in enumerate(columns)]).agg(*[
        e for i in range(len(columns)) for x in [F.col(f"c{i}")] for e in (
            F.struct(F.count(x).alias("n"), F.min(x).alias("lowest"), F.max(x).alias("highest"),
                     F.percentile_approx(x, _marks(probs), SKETCH).alias("marks"),
                     *[m(x).alias(k) for k, m in measures.items()]).alias(f"c{i}"),)]).first()
    found = {c: facts[i].asDict() for i, c in enumerate(columns)}

    # One bracket serves all ranks of a column that share it.
    brackets: dict[tuple, list[int]] = {}
    for c, f in found.items():
        if f["n"] == 0:
            continue
        for i, p in enumerate(probs):
            whole = f["n"] <= SMALL_GROUP
            lo = f["lowest"] if whole else f["marks"][2 * i]
            hi = f["highest"] if whole else f["marks"][2 * i + 1]
            at = p * (f["n"] - 1)
            brackets.setdefault((c, lo, hi), []).extend((math.floor(at), math.ceil(at)))
    order = _order_statistics(table, found, brackets)

    for c, f in found.items():
        f.pop("marks")
        f["quantiles"] = []
        for p in probs:
            at = p * (f["n"] - 1)
            f["quantiles"].append(
                _between(order[c, math.floor(at)], order[c, math.ceil(at)], at - math.floor(at))
                if f["n"] else None)
    return found


def _order_statistics(table: DataFrame, found: dict, brackets: dict) -> dict:
    """Values at the wanted 0-based ranks: ``{(column, rank): value}``."""
    order: dict = {}

    def open_range(lo: float, hi: float, c: str) -> bool:
        return lo > found[c]["lowest"] or hi < found[c]["highest"]

    narrow = [b for b in brackets if open_range(b[1], b[2], b[0])]
    inside = {b: (0, found[b[0]]["n"]) for b in brackets if b not in narrow}
    if narrow:
        counts = table.agg(*[
            e for i, (c, lo, hi) in enumerate(narrow) for e in (
                F.expr(f"count_if({q(c)} < {_number(lo)})").alias(f"b{i}"),
                F.expr(f"count_if({q(c)} <= {_number(hi)})").alias(f"u{i}"))]).first()
        for i, (c, lo, hi) in enumerate(narrow):
            below, upto = counts[f"b{i}"], counts[f"u{i}"]
            ranks = brackets[c, lo, hi]
            if below > min(ranks) or upto <= max(ranks):
                lo, hi, below, upto = found[c]["lowest"], found[c]["highest"], 0, found[c]["n"]
                brackets.setdefault((c, lo, hi), []).extend(ranks)
            inside[c, lo, hi] = (below, upto)

    todo = []
    for b, (below, upto) in inside.items():
        c, lo, hi = b
        if lo == hi:
            order.update({(c, r): lo for r in brackets[b]})
        else:
            todo.append((b, below, upto))
    if not todo:
        return order

    counts = None
    whole = [(i, b) for i, (b, _, _) in enumerate(todo) if not open_range(b[1], b[2], b[0])]
    if whole:
        counts = (melt(table.select(*[col(b[0]).alias(str(i)) for i, b in whole]),
                       [str(i) for i, _ in whole], name="bracket", value="x")
                  .where("x is not null").groupBy("bracket", "x")
                  .agg(F.count(F.lit(1)).alias("ties"))
                  .withColumn("bracket", F.col("bracket").cast("int")))
    cut = [(i, b) for i, (b, _, _) in enumerate(todo) if open_range(b[1], b[2], b[0])]
    for first in range(0, len(cut), BRACKETS_AT_ONCE):
        part = cut[first:first + BRACKETS_AT_ONCE]
        tests = [f"{q(c)} between {_number(lo)} and {_number(hi)}" for _, (c, lo, hi) in part]
        values = ", ".join(
            f"if({test}, named_struct('bracket', {i}, 'x', {q(b[0])}), null)"
            for test, (i, b) in zip(tests, part))
        found_here = (table.where(" or ".join(tests)).select(F.expr(f"inline(array({values}))"))
                      .where("bracket is not null")
                      .groupBy("bracket", "x").agg(F.count(F.lit(1)).alias("ties")))
        counts = found_here if counts is None else counts.unionByName(found_here)
    wanted = F.expr("array(" + ", ".join(
        "array(" + ", ".join(f"{r - below}L" for r in sorted(set(brackets[b]))) + ")"
        for b, below, _ in todo) + ")")
    if max(upto - below for _, below, upto in todo) <= scale.WINDOW_ROWS:
        placed = counts.withColumn("before", F.sum("ties").over(
            Window.partitionBy("bracket").orderBy("x")) - F.col("ties"))
    else:
        placed = running_total(settle(counts), ["bracket"], "x", "ties")
    holds = F.filter(F.element_at(wanted, F.col("bracket") + 1),
                     lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("ties")))
    for row in placed.select("bracket", "x", holds.alias("ranks")).where(
            F.size("ranks") > 0).collect():
        (c, _, _), below, _ = todo[row["bracket"]]
        order.update({(c, r + below): row["x"] for r in row["ranks"]})
    return order


def group_quantiles(rows: DataFrame, keys: Sequence[str], value: str,
                    probs: Sequence[float] = QUARTILES) -> DataFrame:
    """Exact quantiles per key: ``(keys..., n, lowest, highest, quantiles)``.

    The number of keys is not bounded, nor is the share of rows one key holds.
    Groups that one task can order are ordered; larger ones are bracketed.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    rows = rows.select(*[col(k) for k in keys], col(value).cast("double").alias("_x")).where(
        "_x is not null")
    large = settle(rows.groupBy(*keys).agg(
        F.count("_x").alias("n"), F.min("_x").alias("lowest"), F.max("_x").alias("highest"))
        .where(F.col("n") > scale.WINDOW_ROWS))
    size = large.count()
    if size == 0:
        return _ordered_groups(rows, keys, probs)
    located = attach(rows, large, keys, "n", size)
    small = located.where("n is null").select(*rows.columns)
    return _ordered_groups(small, keys, probs).unionByName(
        _bracketed_groups(rows, large, size, keys, probs))


def _interpolate(probs: Sequence[float], at_rank: Callable[[Column], Column]) -> Column:
    """The array of quantiles, given the value at a 0-based rank of ``n``."""
    out = []
    for p in probs:
        at = (F.col("n") - 1) * p
        a, b = at_rank(F.floor(at)), at_rank(F.ceil(at))
        out.append(F.when(a == b, a).otherwise(a + (b - a) * (at - F.floor(at))))
    return F.array(*out)


def _ordered_groups(rows: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Quantiles of groups that are each ordered in one task: a single shuffle."""
    group = Window.partitionBy(*keys)
    ranked = rows.select(
        *keys, "_x", F.count("_x").over(group).alias("n"),
        (F.row_number().over(group.orderBy("_x")) - 1).alias("_rank"))
    quantiles = _interpolate(probs, lambda r: F.max(F.when(F.col("_rank") == r, F.col("_x"))))
    return ranked.groupBy(*keys, "n").agg(
        F.min("_x").alias("lowest"), F.max("_x").alias("highest"), quantiles.alias("quantiles"))


def _bracketed_groups(rows: DataFrame, large: DataFrame, size: int, keys: list[str],
                      probs: list[float]) -> DataFrame:
    """Quantiles of the large groups: only values near a wanted rank are ordered."""
    each, x, n = range(len(probs)), F.col("_x"), F.col("n")
    sketch = settle(attach(rows, large, keys, "n", size).where(n.isNotNull()).groupBy(
        *keys, "n", "lowest", "highest").agg(
            F.percentile_approx(x, _marks(probs), SKETCH).alias("marks")))
    counted = attach(rows, sketch, keys, "n", size).where(n.isNotNull()).groupBy(*keys).agg(*[
        e for i in each for e in (
            F.count_if(x < F.col("marks")[2 * i]).alias(f"below{i}"),
            F.count_if(x <= F.col("marks")[2 * i + 1]).alias(f"upto{i}"))])

    def bracket(i: int) -> Column:
        low, high = F.floor((n - 1) * probs[i]), F.ceil((n - 1) * probs[i])
        good = (F.col(f"below{i}") <= low) & (F.col(f"upto{i}") > high)
        return F.struct(
            F.lit(i).alias("bracket"), F.array_distinct(F.array(low, high)).alias("ranks"),
            F.when(good, F.col("marks")[2 * i]).otherwise(F.col("lowest")).alias("lo"),
            F.when(good, F.col("marks")[2 * i + 1]).otherwise(F.col("highest")).alias("hi"),
            F.when(good, F.col(f"below{i}")).otherwise(F.lit(0)).cast("long").alias("below"))

    brackets = settle(sketch.join(counted, keys).select(
        *keys, "n", F.array(*[bracket(i) for i in each]).alias("brackets")))
    inside = settle(
        attach(rows, brackets, keys, "n", size).where(n.isNotNull())
        .select(*keys, "_x", F.explode(F.filter(
            "brackets", lambda b: x.between(b["lo"], b["hi"]))).alias("_b"))
        .groupBy(*keys, "_b.bracket", "_b.ranks", "_b.below", "_x")
        .agg(F.count(F.lit(1)).alias("ties")))
    placed = running_total(inside, [*keys, "bracket"], "_x", "ties")

    start = F.col("below") + F.col("before")
    held = F.filter("ranks", lambda r: (r >= start) & (r < start + F.col("ties")))
    picked = (placed.select(*keys, "_x", F.explode(held).alias("_rank"))
              .groupBy(*keys).agg(F.map_from_entries(
                  F.collect_set(F.struct("_rank", "_x"))).alias("_at")))
    return sketch.join(picked, keys).select(
        *keys, "n", "lowest", "highest",
        _interpolate(probs, lambda r: F.element_at("_at", r)).alias("quantiles"))
