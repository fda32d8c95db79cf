"""The building blocks, on the paths meant for very large tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescout.functions import scale
from tablescout.functions.scale import attach, running_total, settle
from tablescout.operators import quantiles
from tablescout.operators.quantiles import column_quantiles, group_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def skewed(spark, n=3000):
    """A third of the rows share one key and one value; some keys are missing."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 40).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(
            (F.col("id") * 7919 % 1009).cast("double") / 8).alias("x"))


def test_attach_finds_every_key_with_and_without_broadcast(spark, monkeypatch):
    rows = skewed(spark).withColumn("k", F.when(F.col("x") != 3.0, F.col("k")))
    table = settle(rows.where("k is not null and k < 30").groupBy("k").agg(
        F.count("*").alias("n"), F.max("x").alias("top")))
    plain = sorted(map(repr, attach(rows, table, ["k"], "n").collect()))
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 2)
    joined = attach(rows, table, ["k"], "n")
    assert joined.columns == ["k", "x", "n", "top"]
    assert sorted(map(repr, joined.collect())) == plain


@pytest.mark.parametrize("limit", [10_000, 25])
def test_running_total_equals_a_plain_window(spark, monkeypatch, limit):
    monkeypatch.setattr(scale, "WINDOW_ROWS", limit)
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 2 if limit < 100 else 1 << 20)
    counts = settle(skewed(spark).groupBy("k", "x").agg(F.count("*").alias("n")))
    got = {(r["k"], r["x"]): (r["before"], r["position"])
           for r in running_total(counts, ["k"], "x", "n").collect()}
    by_key: dict = {}
    for r in counts.collect():
        by_key.setdefault(r["k"], []).append((r["x"], r["n"]))
    want = {}
    for k, values in by_key.items():
        total = 0
        for i, (x, n) in enumerate(sorted(values)):
            want[k, x] = (total, i)
            total += n
    assert got == want


def check_columns(spark, df):
    found = column_quantiles(df, df.columns, PROBS)
    for c in df.columns:
        values = [r[0] for r in df.select(F.col(f"`{c}`").cast("double")).collect()
                  if r[0] is not None and r[0] == r[0]]
        if not values:
            assert found[c]["quantiles"] == [None] * len(PROBS)
        else:
            assert found[c]["quantiles"] == pytest.approx(list(np.quantile(values, PROBS)))


@pytest.fixture
def numbers(spark):
    i = F.col("id")
    return spark.range(1500).select(
        i, (i % 7).cast("int").alias("few values"), F.lit(2.5).alias("constant"),
        F.when(i % 3 == 0, F.lit(9.0)).otherwise(i.cast("double") ** 3 / 97).alias("a.b"),
        F.when(i % 5 != 0, (i * 7919 % 1009).cast("double")).alias("gaps"),
        F.when(i % 2 == 0, float("nan")).otherwise(i.cast("double")).alias("nan"),
        F.lit(None).cast("double").alias("none"))


def test_column_quantiles(spark, numbers):
    check_columns(spark, numbers)


def test_column_quantiles_on_the_large_path(spark, numbers, tight):
    check_columns(spark, numbers)


def test_column_quantiles_survive_a_useless_sketch(spark, numbers, tight, monkeypatch):
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)
    monkeypatch.setattr(quantiles, "SKETCH", 5)
    check_columns(spark, numbers)


@pytest.mark.parametrize("large", [False, True])
def test_group_quantiles_with_a_hot_group(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(scale, "BROADCAST_BYTES", 2)
        monkeypatch.setattr(scale, "WINDOW_ROWS", 20)
        monkeypatch.setattr(quantiles, "SMALL_GROUP", 30)
        monkeypatch.setattr(quantiles, "SKETCH", 50)
    rows = skewed(spark)
    groups: dict = {}
    for r in rows.collect():
        groups.setdefault(r["k"], []).append(r["x"])
    found = {r["k"]: r for r in group_quantiles(rows, ["k"], "x", PROBS).collect()}
    assert set(found) == set(groups)
    for k, values in groups.items():
        assert found[k]["n"] == len(values)
        assert found[k]["quantiles"] == pytest.approx(list(np.quantile(values, PROBS)))


def test_infinite_values_are_ordered(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,), (2.0,), (3.0,)], ["x"])
    assert column_quantiles(df, ["x"], [0.25, 0.5, 0.75])["x"]["quantiles"] == [1.0, 2.0, 3.0]


def test_infinite_values_leave_no_correlation(spark):
    from tablescout.operators.relations import pearson, strong_relationships
    rows = [(float(i), float(i % 7), float("inf") if i == 3 else float(i * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    found = {(r["var1"], r["var2"]): r["correlation"] for r in pearson(df).collect()}
    assert found["a", "c"] is None and found["b", "c"] is None
    assert -1 <= found["a", "b"] <= 1
    assert all("c" not in (r["var1"], r["var2"]) for r in strong_relationships(df).collect())
