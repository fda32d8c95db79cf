"""Cross-products, ranks, neighbours, silhouettes and sparse features against brute force."""

from __future__ import annotations

import math
import threading
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tablescout as ts
from tablescout.functions import scale
from tablescout.operators import clusters, information, products, relations


def frame(spark, data: dict) -> tuple:
    table = pd.DataFrame(data)
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r)
            for r in table.astype(float).itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in table)).repartition(3), table


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)) + 1e6
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=300)
    x[:, 2] = np.round(x[:, 2], 0)
    for c in range(1, 7):
        x[rng.random(300) < 0.1 * c, c] = np.nan
    x[:, 7] = 5.0
    return frame(spark, {f"c{i}": x[:, i] for i in range(8)})


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_gappy_pairs(gappy, method):
    df, table = gappy
    want = table.corr(method)
    rows = getattr(ts, method)(df).collect()
    assert len(rows) == 28
    for r in rows:
        expected = want.loc[r["var1"], r["var2"]]
        if math.isnan(expected) or "c7" in (r["var1"], r["var2"]):
            assert r["correlation"] is None
        else:
            assert r["correlation"] == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("limit", [2, 400, 6000])
def test_gappy_ranks_by_join_and_by_lookup(gappy, monkeypatch, limit):
    """Columns of many values are joined, others looked up: all, some or few of them."""
    monkeypatch.setattr(scale, "BROADCAST_BYTES", limit)
    test_gappy_pairs(gappy, "spearman")


def test_ranks_with_gaps_are_counted_once_per_column(gappy, monkeypatch):
    """A column is one list of values, however many partners have gaps."""
    sizes = []

    def settle(df):
        kept = scale.settle(df)
        if "_values" in df.columns:
            sizes.append(kept.select(F.size("_values")).first()[0])
        return kept

    monkeypatch.setattr(relations, "settle", settle)
    assert ts.spearman(gappy[0]).count() == 28
    assert sizes == [8]


def test_plans_do_not_grow_with_pairs(spark):
    def stages(width: int, relation) -> int:
        df = spark.range(50).select(*[F.when(F.col("id") % (i + 3) != 0, F.rand(i)).alias(f"c{i}")
                                      for i in range(width)])
        plan = relation(df)._jdf.queryExecution().executedPlan().toString()
        return plan.count("Join") + plan.count("MapInArrow") + plan.count("Union")

    assert stages(4, ts.pearson) == stages(30, ts.pearson)
    assert stages(3, ts.spearman) == stages(8, ts.spearman)


def test_infinite_values_concern_their_pairs_only(spark):
    df, _ = frame(spark, {"a": [1, 2, 3, 5], "b": [2, 1, 4, 9], "c": [1, np.inf, 2, 7],
                          "d": [3, np.nan, 1, 4]})
    found = {(r["var1"], r["var2"]): r["correlation"] for r in ts.pearson(df).collect()}
    assert found["a", "b"] is not None and found["a", "c"] is None
    assert found["c", "d"] is not None      # the infinite value stands where d is missing
    assert not ts.operators.relations.moments(df.select("a", "c"), ["a", "c"]).usable


def test_facts_of_nothing(spark):
    none = spark.createDataFrame([], "a double, b double")
    assert products.column_facts(none, ["a", "b"])["a"].constant
    assert [r["correlation"] for r in ts.pearson(none).collect()] in ([], [None])
    assert ts.linear_regression(none) is None and ts.kmeans(none) is None


def digamma(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def brute_information(x, y, k=3):
    x, y = x / x.std(), y / y.std()
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    both = np.maximum(dx, dy)
    np.fill_diagonal(both, np.inf)
    radius = np.sort(both, 1)[:, k - 1, None] * (1 - information.SAME)
    nx, ny = (dx <= radius).sum(1), (dy <= radius).sum(1)
    return max(0.0, digamma(len(x)) + digamma(k) - np.mean([digamma(n) for n in nx])
               - np.mean([digamma(n) for n in ny]))


def test_digamma(spark):
    rows = spark.range(1, 40).select("id", information.digamma(F.col("id").cast("double"))
                                     .alias("d")).collect()
    assert all(r["d"] == pytest.approx(digamma(r["id"]), abs=1e-10) for r in rows)


@pytest.mark.parametrize("cell", [512, 7])
def test_neighbour_information(spark, monkeypatch, cell):
    """Smooth, tied, hot and unrelated features; many small cells, or one."""
    monkeypatch.setattr(information, "CELL", cell)
    rng = np.random.default_rng(8)
    y = rng.normal(size=400)
    data = {"near": y + rng.normal(size=400) / 5, "far": rng.random(400),
            "tied": np.round(y * 2), "hot": np.where(rng.random(400) < 0.6, 3.0, y),
            "flat": np.ones(400), "y": np.append(y[:390], [50.0] * 10)}
    df, table = frame(spark, data)
    got = {r["feature"]: r["mi"] for r in ts.neighbour_information(df).collect()}
    assert got.pop("flat") == 0.0
    for f, mi in got.items():
        assert mi == pytest.approx(brute_information(table[f].to_numpy(), table["y"].to_numpy()),
                                   abs=1e-9), f
    assert max(got, key=got.get) == "near"


def test_neighbour_information_of_little(spark):
    df, _ = frame(spark, {"a": [1, 2, 3], "b": [3, 1, 2]})
    assert [tuple(r) for r in ts.neighbour_information(df).collect()] == [("a", 0.0)]
    assert ts.neighbour_information(df.where("a > 9")).count() <= 1
    assert ts.neighbour_information(spark.range(3)).collect() == []


def brute_silhouette(x, labels):
    away = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    scores = []
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() == 1:
            scores.append(0.0)
            continue
        a = away[i, mine].sum() / (mine.sum() - 1)
        b = min(away[i, labels == c].mean() for c in set(labels) - {own})
        scores.append((b - a) / max(a, b))
    return np.mean(scores)


@pytest.mark.parametrize("block", [2048, 30])
def test_euclidean_silhouette(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, s, size=(n, 3)) for c, s, n in
                        [(0, 1, 100), (2, 1, 80), (9, 0.1, 50), (50, 1, 1)]])
    labels = np.repeat([4, -1, 7, 2], [100, 80, 50, 1])
    df, _ = frame(spark, {"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "k": labels})
    got = ts.silhouette(df, "k", ["a", "b", "c"], metric="euclidean")
    assert got == pytest.approx(brute_silhouette(x, labels), abs=1e-9)


def test_euclidean_silhouette_of_many_equal_points(spark, monkeypatch):
    """Copies are one point with a count; row by row this would be millions of units of work."""
    monkeypatch.setattr(clusters, "BLOCK", 1)
    x = np.repeat([[0.0, 1.0], [2.0, 0.0], [2.5, 0.0], [3.0, 3.0], [9.0, 9.0]],
                  [900, 300, 700, 99, 1], axis=0)
    labels = np.repeat([0, 0, 1, 1, 2], [900, 300, 700, 99, 1])
    df, _ = frame(spark, {"a": x[:, 0], "b": x[:, 1], "k": labels})
    late = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = ts.silhouette(df, "k", ["a", "b"], metric="euclidean")
    finally:
        late.cancel()
    assert got == pytest.approx(brute_silhouette(x, labels), abs=1e-9)


def test_kmeans_in_shared_passes(spark):
    """All k and seeds together; rows with gaps or infinite values have no cluster."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.3, size=(60, 2)) for c in (-9, 0, 9, 30)])
    df, _ = frame(spark, {"a": np.append(x[:, 0], [np.nan, np.inf]),
                          "b": np.append(x[:, 1], [1.0, 2.0])})
    fit = ts.kmeans(df, restarts=5)
    assert fit.k == 4 and set(fit.scores) == set(range(2, 10))
    rows = fit.assign(df).collect()
    assert len(rows) == 240
    assert all(r["cluster"] == int(np.searchsorted([-5, 5, 20], r["a"])) for r in rows)


def test_kmeans_sums_of_a_pass():
    """Ties go to the first center; no more than a few rows' distances are held at once."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(4096, 3)), 1)
    fits = [np.round(rng.normal(size=(k, 3)), 1) for k in range(1, 10) for _ in range(3)]
    fits.append(np.array([[1.0, 0, 0], [-1.0, 0, 0], [1.0, 0, 0]]))
    x[:, 0] = np.where(np.arange(len(x)) % 5 == 0, 0.0, x[:, 0])    # as near to both
    want = []
    for centers in fits:
        own = (-2 * x @ centers.T + (centers * centers).sum(1)).argmin(1)
        of = np.arange(len(centers))[:, None] == own
        want.append(np.column_stack([of.sum(1), of @ x, of @ (x * x).sum(1)]))
    tracemalloc.start()
    got = clusters._sums(iter([x[:1000], x[1000:]]), fits)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0, -3:].sum() == 4096 and got[0, -1] == 0
    np.testing.assert_allclose(got.T, np.concatenate(want), atol=1e-8)
    assert most < 4 << 20       # all distances of the rows take 4.5 MB


def test_sparse_onehot(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", None), (3, None, None), (4, "b", "y")],
                               "id int, c string, d string")
    rows, places = ts.onehot_sparse(df)
    assert rows.columns == ["id", "onehot"]
    assert sorted(map(tuple, places.collect())) == [
        (0, "c", "a"), (1, "c", "b"), (2, "d", "x"), (3, "d", "y")]
    found = {r["id"]: r["onehot"] for r in rows.collect()}
    assert {k: v["indices"] for k, v in found.items()} == {1: [1, 2], 2: [0], 3: [], 4: [1, 3]}
    assert all(v["size"] == 4 and v["values"] == [1.0] * len(v["indices"]) for v in found.values())


def test_sparse_onehot_of_many_categories(spark):
    many = spark.range(100_000).select(F.concat(F.lit("v"), "id").alias("c"))
    rows, places = ts.onehot_sparse(many)
    assert rows.where(F.size("onehot.indices") == 1).count() == 100_000
    assert places.agg(F.count_distinct("place"), F.max("place")).first()[:] == (100_000, 99_999)


def test_pair_plot_has_its_diagonal(spark):
    df, table = frame(spark, {"a": [1, 2, 3, np.nan], "b": [1, 1, 5, 9]})
    cells = {tuple(r)[:4]: r["n"] for r in ts.pair_plot(df, bins=2).collect()}
    assert cells == {("a", "a", 0, None): 1, ("a", "a", 1, None): 2,
                     ("b", "b", 0, None): 2, ("b", "b", 1, None): 2,
                     ("a", "b", 0, 0): 1, ("a", "b", 1, 0): 1, ("a", "b", 1, 1): 1}
    assert ts.pair_plot(spark.createDataFrame([], "a string")).collect() == []
