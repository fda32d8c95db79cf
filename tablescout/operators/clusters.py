"""K-means clusters, their silhouette, and the two main components."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import equal_width
from ..functions.columns import NUMERIC, as_doubles, col, complete, finite, pick
from ..functions.scale import settle
from .products import column_facts, matrix
from .relations import moments

RESTARTS = 10
MAX_K = 10
SEED = 42
STEPS = 20              # passes over the rows that move centers, at most
TOLERANCE = 1e-4        # share of the mean variance by which a center still moves
REFINED = 3             # seeds of each k, the best over the sample, that move over all rows
SAMPLE = 4096           # rows (expected) from which first centers are chosen
ROWS_AT_ONCE = 4096     # whose distances to all centers are held at once
ROWS_IN_CACHE = 512     # of those, so few that their distances to all fits stay in a core's cache
BLOCK = 32_768          # points of a cluster, and points that ask for it, in one unit of work
MOST_PARTS = 1000       # tasks that share the units of work, at most

# What runs in tasks travels with them, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The numeric columns of the rows in which all of them are finite, as x0, x1, ..."""
    table = complete(finite(df, columns), columns)
    return table.select(*[col(c).alias(f"x{i}") for i, c in enumerate(columns)])


def _blocks(batches: Iterator[pa.RecordBatch], centre: np.ndarray) -> Iterator[np.ndarray]:
    for batch in batches:
        x = matrix(batch).T - centre
        for at in range(0, len(x), ROWS_AT_ONCE):
            yield x[at:at + ROWS_AT_ONCE]


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)


def _first_centers(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centers drawn one by one, rows far from those drawn before being likelier."""
    rng = np.random.default_rng(seed)
    centers = [sample[rng.integers(len(sample))]]
    for _ in range(k - 1):
        away = np.maximum(_squares(sample, np.array(centers)).min(1), 0.0)
        total = away.sum()
        centers.append(sample[rng.choice(len(sample), p=away / total) if total > 0
                              else rng.integers(len(sample))])
    return np.array(centers)


def _settled(sample: np.ndarray, centers: np.ndarray, least: float) -> np.ndarray:
    """Centers moved over the sample alone until they rest."""
    for _ in range(2 * STEPS):
        own = _squares(sample, centers).argmin(1)
        count = np.bincount(own, minlength=len(centers))[:, None]
        sums = np.stack([np.bincount(own, v, len(centers)) for v in sample.T], 1)
        new = np.where(count > 0, sums / np.maximum(count, 1), centers)
        moved = ((new - centers) ** 2).sum(1).max()
        centers = new
        if moved <= least:
            break
    return centers


def _sums(blocks: Iterator[np.ndarray], fits: list[np.ndarray]) -> np.ndarray:
    """Rows, sums of values and sum of squares (a row each) of the points nearest to each center.

    One product gives the distances of a few points to the centers of all fits, another the sums;
    what is between them stays in a core's cache.
    """
    p, ends, every = fits[0].shape[1], np.cumsum([0, *map(len, fits)]), np.concatenate(fits)
    norms, twice = (every * every).sum(1)[:, None], -2 * every
    out = np.zeros((len(every), p + 2))
    room = np.empty((2, len(every), ROWS_IN_CACHE))
    for block in blocks:
        for at in range(0, len(block), ROWS_IN_CACHE):
            x = block[at:at + ROWS_IN_CACHE]
            values = np.column_stack([np.ones(len(x)), x, (x * x).sum(1)])
            away, nearest = room[:, :, :len(x)]     # of a point, less the same for all centers
            np.add(twice @ x.T, norms, out=away)
            for low, high in zip(ends, ends[1:]):
                np.equal(away[low:high], away[low:high].min(0), out=nearest[low:high])
            found = nearest @ values
            if (np.add.reduceat(found[:, 0], ends[:-1]) != len(x)).any():   # ties: the first center
                for low, high in zip(ends, ends[1:]):
                    np.equal(away[low:high].argmin(0), np.arange(high - low)[:, None],
                             out=nearest[low:high])
                found = nearest @ values
            out += found
    return out.T


def _members(points: DataFrame, centre: np.ndarray, fits: list[np.ndarray]) -> list[tuple]:
    """(rows, sums of values, sum of squares) per center of each fit, in one pass for all fits."""
    p, ends = len(centre), np.cumsum([0, *map(len, fits)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _sums(_blocks(batches, centre), fits)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([out.ravel()])})

    parts = points.mapInArrow(work, "sums array<double>")
    total = np.zeros((p + 2, ends[-1]))
    for r in (parts.select(F.posexplode("sums").alias("at", "v")).groupBy("at")
              .agg(F.sum("v").alias("v")).collect()):       # numbers per center
        total.flat[r["at"]] = r["v"]
    return [(total[0, a:b], total[1:-1, a:b].T, total[-1, a:b]) for a, b in zip(ends, ends[1:])]


def _fits(points: DataFrame, centre: np.ndarray, spread: float, n: int, sizes: Sequence[int],
          restarts: int) -> dict[int, np.ndarray]:
    """For each k the centers of lowest cost over several seeds.

    First centers of all seeds come to rest over a sample; the best ``REFINED`` seeds of each k
    go on. They move together over all rows: one pass serves every k and seed that still moves.
    """
    some = points if n <= SAMPLE else points.sample(False, SAMPLE / n, SEED)
    sample = np.array(sorted(map(tuple, some.collect())), float) - centre
    least = TOLERANCE * spread
    fits = []
    for k in sizes:
        tried = [_settled(sample, _first_centers(sample, k, SEED + 1000 * i + k), least)
                 for i in range(restarts)]
        tried.sort(key=lambda own: _squares(sample, own).min(1).sum())
        fits += [(k, own) for own in tried[:REFINED]]
    centers, moving = [c for _, c in fits], list(range(len(fits)))
    for _ in range(STEPS):
        if not moving:
            break
        found = _members(points, centre, [centers[f] for f in moving])
        still = []
        for f, (count, sums, _) in zip(moving, found):
            new = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers[f])
            if ((new - centers[f]) ** 2).sum(1).max() > least:
                still.append(f)
            centers[f] = new
        moving = still
    best: dict[int, tuple] = {}
    for (k, _), own, (count, sums, squares) in zip(
            fits, centers, _members(points, centre, centers)):
        cost = (squares - 2 * (own * sums).sum(1) + count * (own * own).sum(1)).sum()
        if k not in best or cost < best[k][0]:
            best[k] = (cost, own[count > 0])
    return {k: own for k, (_, own) in best.items()}


def _scores(points: DataFrame, centre: np.ndarray, fits: list[np.ndarray]) -> list[float]:
    """The mean silhouette of each fit on squared distance, in two passes for all fits."""
    known = _members(points, centre, fits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(fits) + 1)
        for x in _blocks(batches, centre):
            total[-1] += len(x)
            for f, (centers, (count, sums, squares)) in enumerate(zip(fits, known)):
                own = _squares(x, centers).argmin(1)
                n = np.maximum(count, 1)
                away = np.maximum(_squares(x, sums / n[:, None]) + (
                    squares / n - ((sums / n[:, None]) ** 2).sum(1)), 0.0)
                total[f] += _row_scores(away, own, count).sum()
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total])})

    total = np.zeros(len(fits) + 1)
    for r in (points.mapInArrow(work, "sums array<double>").select(
            F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
            .collect()):
        total[r["at"]] = r["v"]
    return [float(total[f] / total[-1]) if len(c) > 1 else math.nan for f, c in enumerate(fits)]


def _row_scores(away: np.ndarray, own: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Silhouettes from mean distances to all clusters, each row counted in its own."""
    rows = np.arange(len(own))
    a = away[rows, own] * count[own] / np.maximum(count[own] - 1, 1)
    away = away.copy()
    away[rows, own] = np.inf
    b = away.min(1)
    return np.where((count[own] > 1) & (np.maximum(a, b) > 0),
                    (b - a) / np.where(np.maximum(a, b) > 0, np.maximum(a, b), 1.0), 0.0)


def silhouette(df: DataFrame, label: str, columns: Sequence[str] | None = None,
               metric: str = "squared") -> float:
    """Mean silhouette of rows with an integer label; NaN with fewer than two clusters.

    ``squared`` distance needs one sum per cluster and no pairs of rows. ``euclidean`` distance
    is exact too: bounds from the clusters' centers and variances tell which clusters can be
    the nearest of a row, and only their distances are summed, in blocks; equal points of a
    cluster are taken as one with a count. Rows with a missing
    or infinite value or label are left out; a row alone in its cluster counts 0.
    """
    columns = [c for c in pick(df, columns, NUMERIC) if c != label]
    rows = complete(finite(df.select(*[col(c) for c in columns], col(label).cast("int")
                                     .alias("_label")), columns, keep=["_label"]),
                    ["_label", *columns]).select("_label", F.array(
                        *[col(c) for c in columns]).alias("_x"))
    rows = settle(rows)
    places = (rows.select("_label", F.posexplode("_x").alias("at", "v")).groupBy("_label", "at")
              .agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"),
                   F.var_pop("v").alias("var")).collect())      # numbers per cluster
    labels = sorted({r["_label"] for r in places})
    if len(labels) < 2:
        return math.nan
    number = {c: k for k, c in enumerate(labels)}
    count, mean, var = (np.zeros(s) for s in (len(labels), (len(labels), len(columns)),
                                              len(labels)))
    for r in places:
        k = number[r["_label"]]
        count[k], mean[k, r["at"]] = r["n"], r["mean"]
        var[k] += r["var"]
    if metric != "euclidean":
        def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), ROWS_AT_ONCE):
                    some = batch.iloc[at:at + ROWS_AT_ONCE]
                    x, own = np.stack(some["_x"].to_numpy()), some["_label"].map(number).to_numpy()
                    yield pd.DataFrame({"score": _row_scores(_away(x, mean) + var, own, count)})

        return rows.mapInPandas(scores, "score double").agg(F.avg("score")).first()[0]
    return _euclidean(rows, number, count, mean, var)


def _away(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances, from differences: equal points are exactly 0 apart."""
    away = np.subtract(x[:, 0, None], others[None, :, 0])
    away *= away
    for i in range(1, x.shape[1]):
        d = np.subtract(x[:, i, None], others[None, :, i])
        d *= d
        away += d
    return away


def _euclidean(rows: DataFrame, number: dict[int, int], count: np.ndarray, mean: np.ndarray,
               var: np.ndarray) -> float:
    """The mean silhouette of ``rows (_label, _x)`` on distance, from all pairs that matter.

    Equal points of a cluster are one with a count. They lie in chunks of about ``BLOCK``; a
    chunk's points that ask for a cluster meet each chunk of it in one unit of work. Chunks are
    single rows of bytes, so that a point is shipped once for each chunk that it meets.
    """
    points = settle(rows.groupBy("_label", "_x").agg(F.count(F.lit(1)).alias("w")))
    sizes = {r["_label"]: r["count"] for r in points.groupBy("_label").count().collect()}
    parts = rows.sparkSession.createDataFrame(      # numbers per cluster
        [(c, k, math.ceil(sizes[c] / BLOCK)) for c, k in number.items()],
        "_label int, cluster int, _chunks int")
    p = mean.shape[1]

    def pack(key, some: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cluster": [int(key[0])], "chunk": [int(key[1])],
                             "x": [np.stack(some["_x"].to_numpy()).tobytes()],
                             "w": [some["w"].to_numpy(float).tobytes()]})

    chunks = settle(points.join(F.broadcast(parts), "_label").groupBy(
        "cluster", F.pmod(F.xxhash64("_x"), F.col("_chunks")).cast("int").alias("chunk"))
        .applyInPandas(pack, "cluster int, chunk int, x binary, w binary"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each chunk and cluster: the points for which the cluster can be the nearest."""
        for batch in batches:
            for row in batch.itertuples(index=False):
                x = np.frombuffer(row.x).reshape(-1, p)
                asked = np.zeros((len(x), len(count)), bool)
                for at in range(0, len(x), ROWS_AT_ONCE):
                    away = _away(x[at:at + ROWS_AT_ONCE], mean)
                    most = np.sqrt(away + var)
                    most[:, row.cluster] = np.inf
                    asked[at:at + ROWS_AT_ONCE] = (
                        np.sqrt(away) <= most.min(1)[:, None] * (1 + 1e-12))
                asked[:, row.cluster] = True
                for k in np.flatnonzero(asked.any(0)):
                    places = np.flatnonzero(asked[:, k]).astype(np.int32)
                    yield pd.DataFrame({
                        "own": [row.cluster], "block": [row.chunk], "cluster": [int(k)],
                        "at": [places.tobytes()], "x": [x[places].tobytes()],
                        "w": [row.w if k == row.cluster else b""]})

    asking = settle(chunks.mapInPandas(
        near, "own int, block int, cluster int, at binary, x binary, w binary"))
    nothing = F.lit(None).cast("binary")
    held = asking.select("own", "block", "cluster").join(chunks, "cluster").select(
        "own", "block", "cluster", "chunk", nothing.alias("at"), "x", "w")
    wanted = asking.join(F.broadcast(parts), "cluster").select(
        "own", "block", "cluster", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))
        .alias("chunk"), "at", "x", "w")

    def sums(key, unit: pd.DataFrame) -> pd.DataFrame:
        there = unit["at"].notna()
        if there.all():
            return unit.iloc[:0][["own", "block", "cluster", "at", "w"]].assign(total=None)
        mine, other = unit[there].iloc[0], unit[~there].iloc[0]
        x = np.frombuffer(mine["x"]).reshape(-1, p)
        y, w = np.frombuffer(other["x"]).reshape(-1, p), np.frombuffer(other["w"])
        total = np.zeros(len(x))
        for low in range(0, len(y), 2048):      # pieces that stay in a core's cache
            far, weight = y[low:low + 2048], w[low:low + 2048]
            for at in range(0, len(x), 64):
                away = _away(x[at:at + 64], far)
                total[at:at + 64] += np.sqrt(away, out=away) @ weight
        return pd.DataFrame([(*map(int, key[:3]), mine["at"], mine["w"], total.tobytes())],
                            columns=["own", "block", "cluster", "at", "w", "total"])

    unit = ["own", "block", "cluster", "chunk"]
    n_units = wanted.count()
    summed = (held.unionByName(wanted).repartition(max(1, min(n_units, MOST_PARTS)), *unit)
              .groupBy(*unit).applyInPandas(
                  sums, "own int, block int, cluster int, at binary, w binary, total binary"))

    def finish(key, found: pd.DataFrame) -> pd.DataFrame:
        own = int(key[0])
        mine = found[found["cluster"] == own]
        w, a = np.frombuffer(mine["w"].iloc[0]), 0.0
        b: dict[int, np.ndarray] = {}
        for r in found.itertuples(index=False):
            total, at = np.frombuffer(r.total), np.frombuffer(r.at, np.int32)
            if r.cluster == own:
                a = a + total
            else:
                b.setdefault(r.cluster, np.full(len(w), np.inf))
                b[r.cluster][at] = np.where(np.isinf(b[r.cluster][at]), 0.0, b[r.cluster][at]) + total
        nearest = np.full(len(w), np.inf)
        for k, total in b.items():
            nearest = np.minimum(nearest, total / count[k])
        a = a / max(count[own] - 1, 1)
        most = np.maximum(a, nearest)
        score = np.where((count[own] > 1) & (most > 0),
                         (nearest - a) / np.where(most > 0, most, 1.0), 0.0)
        return pd.DataFrame({"score": [float(score @ w)], "n": [float(w.sum())]})

    total = summed.groupBy("own", "block").applyInPandas(finish, "score double, n double").agg(
        F.sum("score").alias("score"), F.sum("n").alias("n")).first()
    return total["score"] / total["n"]


@dataclass(frozen=True)
class Clustering:
    """A k-means fit; ``assign`` gives every complete row its cluster."""

    columns: list[str]
    k: int
    centers: list[list[float]]
    silhouette: float
    scores: dict[int, float] = field(default_factory=dict)

    def assign(self, df: DataFrame) -> DataFrame:
        """The rows with finite columns and a column ``cluster``: the place of the nearest center."""
        values = [col(c).cast("double") for c in self.columns]
        rows = df
        for v in values:
            rows = rows.where(v.isNotNull() & (F.abs(v) < float("inf")))
        centers = F.array(*[F.array(*[F.lit(m) for m in c]) for c in self.centers])
        away = F.transform(centers, lambda c, k: F.struct(F.aggregate(
            F.zip_with(F.array(*values), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0),
            lambda total, d: total + d).alias("d"), k.cast("int").alias("k")))
        return rows.withColumn("cluster", F.array_min(away)["k"])


def kmeans(df: DataFrame, k: int | None = None, columns: Sequence[str] | None = None,
           restarts: int = RESTARTS) -> Clustering | None:
    """K-means on the rows whose columns are all finite.

    Without ``k``, the k from 2 to 9 (under half the rows) with the best silhouette
    is taken, the smallest on ties. Clusters are numbered by their centers in
    ascending order. None with fewer than two numeric columns or too few rows. First centers
    come from a sample of about ``SAMPLE`` rows; every pass that moves them reads all rows.
    """
    columns = pick(df, columns, NUMERIC)
    if len(columns) < 2:
        return None
    points = _points(df, columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        facts = column_facts(points, points.columns)
        n = min(f.n for f in facts.values())
        wanted = [k] if k else list(range(2, min(MAX_K, n // 2)))
        if not wanted or n < max(k or 0, 1):
            return None
        centre = np.array([facts[c].mean for c in points.columns])
        count, sums, squares = _members(points, centre, [np.zeros((1, len(centre)))])[0]
        spread = float(squares[0] / count[0] - ((sums[0] / count[0]) ** 2).sum()) / len(centre)
        fits = _fits(points, centre, spread, n, wanted, restarts)
        scores = dict(zip(wanted, _scores(points, centre, [fits[size] for size in wanted])))
    finally:
        points.unpersist()
    chosen = wanted[0] if k else max(wanted, key=lambda size: (
        -math.inf if math.isnan(scores[size]) else scores[size], -size))
    centers = sorted([float(v) for v in c] for c in fits[chosen] + centre)
    return Clustering(columns, len(centers), centers, scores[chosen], scores)


@dataclass(frozen=True)
class Components:
    """The two directions of most variance."""

    columns: list[str]
    mean: list[float]
    loadings: list[list[float]]
    ratio: list[float]

    def table(self, df: DataFrame) -> DataFrame:
        """``(component, explained_ratio, column, loading)``."""
        return df.sparkSession.createDataFrame(
            [(i + 1, self.ratio[i], c, self.loadings[i][j])
             for i in range(len(self.loadings)) for j, c in enumerate(self.columns)],
            "component int, explained_ratio double, column string, loading double")

    def project(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``(keep..., pc1, pc2)`` of the complete rows."""
        table = complete(as_doubles(df, self.columns, keep), self.columns)
        out = []
        for i, weights in enumerate(self.loadings):
            total = F.lit(0.0)
            for c, m, w in zip(self.columns, self.mean, weights):
                total = total + (col(c) - F.lit(m)) * F.lit(w)
            out.append(total.alias(f"pc{i + 1}"))
        return table.select(*[col(c) for c in keep], *out)


def pca(df: DataFrame, columns: Sequence[str] | None = None, k: int = 2) -> Components | None:
    """Main components of the complete rows; the largest loading of each is positive.

    None with fewer than two columns or complete rows, or with an infinite value in one.
    """
    columns = pick(df, columns, NUMERIC)
    if len(columns) < 2:
        return None
    m = moments(df, columns)
    if not m.usable:
        return None
    values, vectors = np.linalg.eigh(m.covariance)
    order = np.argsort(values)[::-1][:k]
    total = float(np.trace(m.covariance))
    loadings = []
    for i in order:
        v = vectors[:, i]
        loadings.append([float(x) for x in v * np.sign(v[np.argmax(np.abs(v))])])
    return Components(columns, [float(x) for x in m.mean], loadings,
                      [float(max(values[i], 0.0) / total) if total > 0 else 0.0 for i in order])


def cluster_projection(df: DataFrame, clustering: Clustering, bins: int = 50) -> DataFrame:
    """``(cluster, bin_x, bin_y, n)``: clusters on the two main components, binned."""
    parts = pca(df, clustering.columns)
    if parts is None:
        return df.sparkSession.createDataFrame(
            [], "cluster int, bin_x int, bin_y int, n long")
    placed = parts.project(clustering.assign(df), keep=["cluster"])
    lo_x, hi_x, lo_y, hi_y = placed.agg(
        F.min("pc1"), F.max("pc1"), F.min("pc2"), F.max("pc2")).first()
    return placed.groupBy(
        "cluster",
        equal_width(F.col("pc1"), F.lit(lo_x), F.lit(hi_x), bins).alias("bin_x"),
        equal_width(F.col("pc2"), F.lit(lo_y), F.lit(hi_y), bins).alias("bin_y"),
    ).agg(F.count(F.lit(1)).alias("n"))
