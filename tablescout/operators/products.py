"""Cross-products of numeric columns as partial matrices.

Two passes serve any number of columns, with gaps or without: one for counts, means and
ranges, one in which every Arrow batch is a matrix of centred values and a matrix of presence,
whose products with each other hold all sums of all pairs. A task adds its batches up and hands
on its matrices once, row by row; Spark sums them by pair. A task holds seven p by p matrices.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_doubles

SUMS = ["n", "s_i", "s_j", "s_ii", "s_jj", "s_ij", "infinite"]
ROWS_AT_ONCE = 1024     # rows whose products of single pairs are held at once

# The products travel with their tasks, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Columns of doubles as a matrix, one row per column; NaN where a value is missing."""
    if not batch.num_columns:
        return np.zeros((0, batch.num_rows))
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])


@dataclass(frozen=True)
class Facts:
    """Of a column: rows, values, mean of the finite ones, range, and whether any is infinite."""

    rows: int
    n: int
    mean: float
    low: float | None
    high: float | None
    infinite: bool

    @property
    def constant(self) -> bool:
        return self.n == 0 or self.low == self.high


def _numbered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Doubles named x0, x1, ...: tasks take no names with dots."""
    return as_doubles(df, columns).toDF(*[f"x{i}" for i in range(len(columns))])


def column_facts(df: DataFrame, columns: Sequence[str], complete: bool = False
                 ) -> dict[str, Facts]:
    """``Facts`` of each column in one pass; with ``complete``, of the rows without gaps."""
    p = len(columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n, total, infinite = 0, np.zeros(p), np.zeros(p), np.zeros(p, bool)
        low, high = np.full(p, np.inf), np.full(p, -np.inf)
        for batch in batches:
            x = matrix(batch)
            if complete:
                x = x[:, ~np.isnan(x).any(0)]
            there, finite = ~np.isnan(x), np.isfinite(x)
            rows += x.shape[1]
            n += there.sum(1)
            total += np.where(finite, x, 0.0).sum(1)
            infinite |= (there & ~finite).any(1)
            low = np.minimum(low, np.where(there, x, np.inf).min(1, initial=np.inf))
            high = np.maximum(high, np.where(there, x, -np.inf).max(1, initial=-np.inf))
        yield pa.RecordBatch.from_pydict({
            "i": np.arange(p, dtype=np.int32), "rows": np.full(p, rows, np.int64),
            "n": n.astype(np.int64), "total": total, "low": low, "high": high,
            "infinite": infinite})

    parts = _numbered(df, columns).mapInArrow(
        work, "i int, rows long, n long, total double, low double, high double, infinite boolean")
    found = parts.groupBy("i").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("infinite").alias("inf"))
    out = {c: Facts(0, 0, 0.0, None, None, False) for c in columns}
    for r in found.collect():       # one row per column
        n = r["n"]
        out[columns[r["i"]]] = Facts(r["rows"], n, r["total"] / n if n else 0.0,
                                     r["low"] if n else None, r["high"] if n else None, r["inf"])
    return out


def cross_products(df: DataFrame, columns: Sequence[str], centres: Sequence[float],
                   complete: bool = False) -> DataFrame:
    """``(i, j, n, s_i, s_j, s_ii, s_jj, s_ij, infinite)`` of each pair of places i <= j.

    Sums over the rows in which both columns are present (with ``complete``, all columns), of
    values less their ``centres``; ``infinite`` counts infinite values of either among them,
    which the sums leave out.
    """
    p, centre = len(columns), np.array(centres, float)[:, None]
    schema = "i int, " + ", ".join(f"{s} array<double>" for s in SUMS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, both, infinite = (np.zeros((p, p)) for _ in range(5))
        for batch in batches:
            x = matrix(batch)
            if complete:
                x = x[:, ~np.isnan(x).any(0)]
            there, finite = (~np.isnan(x)).astype(float), np.isfinite(x)
            x = np.where(finite, x - centre, 0.0)
            n += there @ there.T
            s += x @ there.T
            q += (x * x) @ there.T
            both += x @ x.T
            if not finite.all():
                odd = (there - finite) @ there.T
                infinite += odd + odd.T
        for i in range(p):
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32())} | {
                name: pa.array([row[i, i:]]) for name, row in zip(
                    SUMS, (n, s, s.T, q, q.T, both, infinite))})

    parts = _numbered(df, columns).mapInArrow(work, schema)
    return (parts.select("i", F.posexplode(F.arrays_zip(*SUMS)).alias("at", "v"))
            .groupBy("i", (F.col("i") + F.col("at")).alias("j"))
            .agg(*[F.sum(f"v.{s}").alias(s) for s in SUMS]))


def rank_tables(ranks: pa.Table | None, places: Sequence[Sequence[int]]) -> list[tuple]:
    """Per column: its ``places``, its sorted values, and their ranks, one row per value.

    ``ranks`` is ``(place, value, rank)``; a value without a rank in one of the places has NaN.
    """
    if ranks is None:
        return []
    place, value, rank = (ranks.column(c).to_numpy() for c in ("place", "value", "rank"))
    out = []
    for own in places:
        values = np.unique(value[np.isin(place, own)])
        table = np.full((len(values), len(own)), np.nan)
        for k, x in enumerate(own):
            table[np.searchsorted(values, value[place == x]), k] = rank[place == x]
        out.append((list(own), values, table))
    return out


def pair_products(rows: DataFrame, width: int, pairs: Sequence[tuple[int, int]],
                  centres: Sequence[float], places: Sequence[Sequence[int]],
                  tables: Sequence[tuple]) -> DataFrame:
    """``(pair, s)``: sums of products of centred ranks for chosen pairs of places.

    ``rows`` is ``(_row, column, r0, r1, ..., few)``, a row's parts next to each other: the ranks
    of one column, for each of its ``places``, or (column -1) the values ``few`` of the columns
    that have ``tables``, whose ranks are looked up. ``centres`` has one centre per pair, which
    both of its columns share.
    """
    left, right = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    centre = np.array(centres, float)

    def placed(part: pa.RecordBatch, number: np.ndarray) -> np.ndarray:
        """The ranks of the rows, each in its place; NaN where there is none."""
        x = np.full((int(number[-1]) + 1, width), np.nan)
        column = part.column("column").to_numpy()
        for c in np.unique(column[column >= 0]):
            here = np.flatnonzero(column == c)
            for k, place in enumerate(places[c]):
                x[number[here], place] = part.column(f"r{k}").to_numpy(zero_copy_only=False)[here]
        here = np.flatnonzero(column < 0)
        if len(here) and tables:
            few = part.column("few").filter(pa.array(column < 0)).flatten().to_numpy(
                zero_copy_only=False).reshape(len(here), len(tables))
            for c, (own, values, ranks) in enumerate(tables):
                if len(values):
                    at = np.minimum(np.searchsorted(values, few[:, c]), len(values) - 1)
                    known = np.flatnonzero(values[at] == few[:, c])
                    x[np.ix_(number[here[known]], own)] = ranks[at[known]]
        return x

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pairs))

        def add(part: pa.RecordBatch) -> None:
            row = part.column("_row").to_numpy()
            number = np.cumsum(np.concatenate([[0], row[1:] != row[:-1]]))
            x = placed(part, number)
            for at in range(0, len(x), ROWS_AT_ONCE):
                for low in range(0, len(pairs), ROWS_AT_ONCE):
                    some, here = slice(low, low + ROWS_AT_ONCE), x[at:at + ROWS_AT_ONCE]
                    total[some] += np.nansum((here[:, left[some]] - centre[some])
                                             * (here[:, right[some]] - centre[some]), 0)

        rest: list[pa.RecordBatch] = []     # parts of the last row, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            every = pa.concat_batches([*rest, batch])
            row = every.column("_row").to_numpy()
            end = int(np.flatnonzero(row != row[-1])[-1]) + 1 if row[0] != row[-1] else 0
            if end:
                add(every.slice(0, end))
            rest = [every.slice(end)]
        for part in rest:
            add(part)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total])})

    parts = rows.mapInArrow(work, "sums array<double>")
    return (parts.select(F.posexplode("sums").alias("pair", "v"))
            .groupBy("pair").agg(F.sum("v").alias("s")))
