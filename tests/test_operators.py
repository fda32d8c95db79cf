"""Operators on small tables with known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tablescout as ts


def rows(df, key=0):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def messy(spark):
    """105 rows: gaps, a missing category, five copied rows, two planted outliers."""
    i = F.col("id")
    base = spark.range(100).select(
        i, (18 + F.floor(F.rand(1) * 60)).alias("age"),
        F.when(i % 5 != 0, 50000 + F.randn(2) * 15000).alias("income"),
        F.when(i % 4 == 0, "A").when(i % 4 == 1, "B").when(i % 4 == 2, "C").alias("category"),
        F.when(i % 7 != 0, F.rand(3) * 100).alias("score"))
    spiked = base.withColumn("income", F.when(i == 1, 1_000_000.0).otherwise(F.col("income")))
    return spiked.unionByName(spiked.where("id between 10 and 14")).cache()


# Profile

def test_quality_profile(spark, messy):
    found = rows(ts.quality_profile(messy), "column")
    assert found["income"]["n_missing"] == 21 and found["income"]["n_rows"] == 105
    assert found["income"]["pct_missing"] == pytest.approx(20.0)
    assert found["category"]["type_group"] == "categorical"
    assert found["id"]["duplicate_rows"] == 5


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, None), (None, "b")], "x double, s string")
    assert rows(ts.missing_profile(df))["x"]["n_missing"] == 2
    assert rows(ts.unique_counts(df))["x"]["n_unique"] == 1


def test_duplicates_with_nulls_and_zeros_and_maps(spark):
    df = spark.createDataFrame(
        [(0.0, None, {"a": 1}), (-0.0, None, {"a": 1}), (float("nan"), "x", None), (None, "x", None)],
        "x double, s string, m map<string,int>")
    assert ts.duplicate_count(df).first()["n_duplicates"] == 2
    assert ts.drop_duplicates(df.drop("m")).count() == 2
    assert ts.drop_duplicates(df.where("s = 'x'")).count() == 1


def test_duplicates_beyond_the_broadcast_limit(spark, tight):
    df = spark.range(300).selectExpr("id % 100 as a", "id % 50 as b")
    assert ts.duplicate_count(df).first()["n_duplicates"] == 200
    assert ts.drop_duplicates(df).count() == 100


def test_rows_without_copies_are_not_shuffled(spark):
    df = spark.range(50).selectExpr("id", "cast(id as string) as s")
    plan = ts.drop_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_drop_duplicates_twice_is_once(messy):
    once = ts.drop_duplicates(messy)
    assert once.count() == 100 and ts.drop_duplicates(once).count() == 100


def test_empty_table(spark):
    df = spark.createDataFrame([], "a long, b double, c string, d timestamp")
    assert ts.describe_numeric(df).collect()[0]["count"] == 0
    assert ts.outliers(df).collect()[0]["pct_outliers"] is None
    assert ts.pearson(df).collect()[0]["correlation"] is None
    assert ts.spearman(df).collect()[0]["correlation"] is None
    assert ts.linear_regression(df) is None and ts.kmeans(df) is None and ts.pca(df) is None
    assert ts.mutual_information(df).count() == 0 and ts.histogram(df).count() == 0
    assert ts.boxplot(df).count() == 0 and ts.boxplot_by_category(df).count() == 0
    assert ts.impute(df).columns == df.columns
    assert ts.standardize(df).count() == 0 and ts.label_encode(df).count() == 0
    assert ts.overview(df).n_rows == 0


def test_text_only_table(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z")], ["p", "q"])
    assert ts.standardize(df) is df
    assert ts.pearson(df).count() == 0
    top = rows(ts.describe_categorical(df))["p"]
    assert (top["count"], top["unique"], top["top"], top["freq"]) == (3, 2, "a", 2)
    assert ts.analyse(df).status_table().where("status = 'failed'").count() == 0


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, 2, "x"), (2.0, 4, "y"), (4.0, 9, "x")], ["a.b", "c d", "e`f"])
    assert set(rows(ts.describe_numeric(df))) == {"a.b", "c d"}
    assert ts.pearson(df).first()["correlation"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4, 9])[0, 1])
    assert ts.spearman(df).first()["correlation"] == pytest.approx(1.0)
    assert "e`f_encoded" in ts.label_encode(df).columns
    assert ts.impute(df).columns == df.columns
    assert ts.mutual_information(df).first()["feature"] == "a.b"
    assert ts.kmeans(df, 2).assign(df).count() == 3
    assert ts.onehot_encode(df).columns == ["a.b", "c d", "e`f_x", "e`f_y"]


# Statistics

def test_describe_equals_pandas(messy):
    numeric = messy.select("age", "income", "score")
    want = numeric.toPandas().describe()
    for r in ts.describe_numeric(numeric).collect():
        got = [r["count"], r["mean"], r["std"], r["min"], r["q25"], r["q50"], r["q75"], r["max"]]
        assert got == pytest.approx(list(want[r["column"]]))


def test_describe_datetime(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,id) as t, "
                   "date'2024-01-01' + cast(id as int) as d from range(5)")
    for r in ts.describe_datetime(df).collect():
        assert str(r["q50"]) == "2024-01-03 00:00:00" and str(r["max"]) == "2024-01-05 00:00:00"


def test_mode_ties_take_the_smallest_value(spark):
    df = spark.createDataFrame([("b", True), ("a", False), ("b", None), ("a", None)], "s string, t boolean")
    assert {r["column"]: r["mode"] for r in ts.column_modes(df).collect()} == {"s": "a", "t": "false"}


def test_top_values(spark):
    df = spark.range(1000).selectExpr("case when id < 400 then 'hot' else cast(id % 50 as string) end as s")
    top = ts.top_values(df).orderBy("position").collect()
    assert len(top) == 10 and top[0]["value"] == "hot" and top[0]["n"] == 400


def test_top_values_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("cast(id % 50 as string) as s")
    plan = ts.top_values(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# Cleaning

def test_impute_leaves_nothing_missing(messy):
    for strategy in ("mean", "median", "smart"):
        filled = ts.impute(messy, strategy)
        assert ts.overview(filled).n_missing == 0 and filled.count() == 105


def test_impute_values(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "x", True), (2, 2.0, "x", None), (3, 9.0, "y", False), (None, None, None, False)],
        "a long, b double, s string, t boolean")
    last = [r for r in ts.impute(df, "median").collect() if r["b"] == 2.0 and r["s"] == "x"]
    assert any(r["a"] == 2.0 for r in last)
    filled = ts.impute(df, "mean").where("b = 4.0").first()
    assert (filled["a"], filled["b"], filled["s"], filled["t"]) == (2.0, 4.0, "x", False)


def test_sparse_columns(spark):
    df = spark.range(100).selectExpr("id", "case when id < 5 then 1.0D end as mostly",
                                     "case when id < 50 then 1.0D end as half")
    assert ts.drop_sparse_columns(df).columns == ["id", "half"]
    assert ts.impute(df.select("id", F.lit(None).cast("string").alias("s")),
                     max_missing=1.0).first()["s"] == "Unknown"


# Outliers, checks

def test_outliers(spark):
    df = spark.range(200).selectExpr(
        "id", "case when id = 0 then 500.0D when id = 1 then -200.0D when id = 2 then 450.0D "
        "else 50 + (id % 10) end as x", "3.0D as constant")
    found = rows(ts.outliers(df))
    assert found["x"]["n_outliers"] == 3 and found["constant"]["n_outliers"] == 0
    assert found["x"]["pct_outliers"] == pytest.approx(1.5)
    assert rows(ts.outliers(df, "iqr"))["x"]["n_outliers"] == 3
    assert ts.outliers(df, "other").count() == 0
    first = ts.outlier_values(df, "id", ["x"], k=2).orderBy("position").collect()
    assert [r["value"] for r in first] == [500.0, -200.0]


def test_infinite_values_are_no_outliers_of_themselves(spark):
    df = spark.createDataFrame([(float("inf"),)] * 3 + [(float("-inf"),)] * 3 + [(1.0,)], ["x"])
    assert rows(ts.outliers(df))["x"]["n_outliers"] == 0
    assert rows(ts.outliers(df, "iqr"))["x"]["n_outliers"] == 0


def test_outliers_equal_pandas(messy):
    p = messy.toPandas()["income"]
    want = int((((p - p.mean()) / p.std()).abs() > 3).sum())
    assert rows(ts.outliers(messy))["income"]["n_outliers"] == want


def test_validate(messy):
    checks = {(r["column"], r["check"]): r for r in ts.validate(messy).collect()}
    assert checks["id", "not_null"]["passed"] and not checks["income", "not_null"]["passed"]
    assert checks["income", "not_null"]["failing_rows"] == 21
    assert all(r["passed"] for (_, check), r in checks.items() if check != "not_null")


# Features

def test_label_codes_follow_value_order(spark):
    df = spark.createDataFrame([("B",), ("a",), (None,), ("C",), ("B",)], "s string")
    assert {r["s"]: r["s_encoded"] for r in ts.label_encode(df).collect()} == {
        "B": 0.0, "C": 1.0, "a": 2.0, None: None}


def test_label_codes_on_the_large_path(spark, tight):
    df = spark.range(900).selectExpr(
        "case when id % 3 = 0 then 'hot' when id % 11 = 0 then null else concat('v', id % 130) end as s")
    got = {r["s"]: r["s_encoded"] for r in ts.label_encode(df).distinct().collect()}
    values = sorted(v for v in got if v is not None)
    assert len(values) > 100 and got[None] is None
    assert [got[v] for v in values] == [float(i) for i in range(len(values))]
    assert ts.label_encode(df).count() == 900


@pytest.mark.parametrize("large", [False, True])
def test_label_codes_of_a_dotted_column(spark, large, request):
    if large:
        request.getfixturevalue("tight")
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("b",)], ["x.y"])
    assert {r[0]: r[1] for r in ts.label_encode(df).collect()} == {
        "a": 0.0, "b": 1.0, "c": 2.0, None: None}


def test_onehot(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "i long, s string")
    out = ts.onehot_encode(df)
    assert out.columns == ["i", "s_a", "s_b"]
    assert sorted(map(tuple, out.collect())) == [(1, False, True), (2, False, False), (3, True, False)]
    with pytest.raises(ValueError):
        ts.onehot_encode(df, max_categories=1)


def test_standardize(messy):
    out = ts.standardize(messy.withColumn("constant", F.lit(3.0)))
    facts = rows(out.agg(F.lit("x"), F.avg("income"), F.stddev_pop("income"), F.max("constant")))["x"]
    assert facts[1] == pytest.approx(0, abs=1e-9) and facts[2] == pytest.approx(1) and facts[3] == 0


# Relations

def correlation_table(df):
    return {(r["var1"], r["var2"]): r["correlation"] for r in df.collect()}


@pytest.fixture(scope="module")
def related(spark):
    i = F.col("id")
    base = spark.range(400).select(
        "id", F.round(F.randn(1) * 4).alias("a"), F.randn(2).alias("b"), F.randn(3).alias("c"))
    return base.select(
        F.when(i % 6 != 0, F.col("a")).alias("x"),
        F.when(i % 5 != 0, F.col("a") * 2 + F.col("b")).alias("y"),
        F.when(i % 3 == 0, F.lit(0.0)).otherwise(F.col("c")).alias("z"),
        F.lit(4.2).alias("constant")).cache()


def equal_pandas(got, frame, method):
    want = frame.corr(method=method)
    for (a, b), r in got.items():
        if math.isnan(want.loc[a, b]):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b])


def average_rank_correlation(frame):
    """Spearman by pandas ranks within each pair's complete rows (needs no other library)."""
    out = pd.DataFrame(index=frame.columns, columns=frame.columns, dtype=float)
    for a in frame:
        for b in frame:
            both = frame[[a, b]].dropna() if a != b else frame[[a]].dropna()
            x, y = both.iloc[:, 0].rank(), both.iloc[:, -1].rank()
            out.loc[a, b] = np.nan if x.std() == 0 or y.std() == 0 else np.corrcoef(x, y)[0, 1]
    return out


def test_pearson_equals_pandas(related):
    equal_pandas(correlation_table(ts.pearson(related)), related.toPandas(), "pearson")


@pytest.mark.parametrize("large", [False, True])
def test_spearman_equals_pandas(related, large, request):
    if large:
        request.getfixturevalue("tight")
    got = correlation_table(ts.spearman(related))
    want = average_rank_correlation(related.toPandas())
    assert len(got) == 6
    for (a, b), r in got.items():
        if "constant" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b])


def test_many_columns_are_split(spark):
    df = spark.range(50).select(*[(F.rand(i) + F.col("id") * i).alias(f"c{i}") for i in range(15)])
    got = correlation_table(ts.pearson(df))
    assert len(got) == 105
    equal_pandas(got, df.toPandas(), "pearson")


def test_wide_tables_use_one_matrix(spark):
    df = spark.range(80).select(
        *[(F.rand(i) + F.col("id") * (i % 3)).alias(f"c{i}") for i in range(44)],
        F.when(F.col("id") % 4 != 0, F.rand(99)).alias("gappy"), F.lit(1.0).alias("constant"))
    got = correlation_table(ts.pearson(df))
    assert len(got) == 46 * 45 / 2
    equal_pandas(got, df.toPandas(), "pearson")
    fit = ts.pca(df)
    p = df.toPandas().dropna()
    values = np.linalg.eigvalsh(np.cov(p.to_numpy().T))
    assert fit.ratio == pytest.approx(list(values[::-1][:2] / values.sum()))


def test_strong_relationships(related):
    found = ts.strong_relationships(related.select("x", "y", "z")).collect()
    assert [(r["var1"], r["var2"], r["strength"]) for r in found] == [("x", "y", "strong")]


def test_heatmap_is_the_whole_matrix(related):
    cells = correlation_table(ts.correlation_heatmap(related))
    assert len(cells) == 16 and cells["x", "x"] == 1.0 and cells["x", "y"] == cells["y", "x"]
    assert cells["constant", "constant"] is None


def test_regression_equals_least_squares(spark):
    df = spark.range(300).select(F.randn(1).alias("a"), F.rand(2).alias("b"), (F.randn(3) * 50).alias("c"))
    df = df.withColumn("y", 3 * F.col("a") + 2 * F.col("b") - 0.5 * F.col("c") + F.randn(4)).cache()
    fit = ts.linear_regression(df)
    p = df.toPandas()
    want = np.linalg.lstsq(np.c_[p[["a", "b", "c"]], np.ones(len(p))], p["y"], rcond=None)[0]
    assert [*fit.coefficients.values(), fit.intercept] == pytest.approx(list(want))
    assert 0 <= fit.r2 <= 1
    guess = fit.predict(df).toPandas()
    residual = ((guess["actual"] - guess["predicted"]) ** 2).sum()
    assert fit.r2 == pytest.approx(1 - residual / ((p["y"] - p["y"].mean()) ** 2).sum())


def test_collinear_regression_has_the_smallest_norm(spark):
    df = spark.range(100).select(F.randn(1).alias("a"), F.lit(1.0).alias("one")).selectExpr(
        "a", "2 * a as b", "one", "5 * a + 1 as y")
    fit = ts.linear_regression(df)
    assert fit.coefficients["a"] == pytest.approx(1.0) and fit.coefficients["b"] == pytest.approx(2.0)
    assert fit.coefficients["one"] == pytest.approx(0.0, abs=1e-9) and fit.r2 == pytest.approx(1.0)


def test_regression_without_target_or_features(related):
    assert ts.linear_regression(related, "nothing") is None
    assert ts.linear_regression(related.select("x")) is None


def test_mutual_information_orders_features(spark):
    df = spark.range(2000).select(F.randn(1).alias("near"), F.randn(2).alias("noise"))
    df = df.withColumn("y", F.col("near") * 2 + F.randn(3) * 0.1)
    found = ts.mutual_information(df).collect()
    assert [r["feature"] for r in found] == ["near", "noise"]
    assert found[0]["mi"] > 0.5 and found[1]["mi"] >= 0


# Clusters

@pytest.fixture(scope="module")
def blobs(spark):
    i = F.col("id") % 3
    return spark.range(300).select(
        "id", (i * 20 + F.randn(1)).alias("x"),
        F.when(F.col("id") % 50 != 7, i * -10 + F.randn(2)).alias("y")).cache()


def brute_silhouette(points, labels):
    away = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    out = []
    for i, own in enumerate(labels):
        mean = {c: away[i][labels == c].sum() / ((labels == c).sum() - (c == own))
                for c in set(labels)}
        a, b = mean.pop(own), min(mean.values())
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_kmeans_finds_the_blobs(blobs):
    fit = ts.kmeans(blobs, columns=["x", "y"], restarts=2)
    assert fit.k == 3 and set(fit.scores) == set(range(2, 10))
    labelled = fit.assign(blobs)
    assert labelled.count() == 294 and labelled.columns == ["id", "x", "y", "cluster"]
    assert labelled.where("cluster <> id % 3").count() == 0
    p = labelled.toPandas()
    want = brute_silhouette(p[["x", "y"]].to_numpy(), p["cluster"].to_numpy())
    assert fit.silhouette == pytest.approx(want)
    assert ts.silhouette(labelled, "cluster", ["x", "y"]) == pytest.approx(want)


def test_fixed_k(blobs):
    fit = ts.kmeans(blobs, 4, ["x", "y"], restarts=1)
    assert fit.assign(blobs).select("cluster").distinct().count() == 4


def test_too_little_to_cluster(spark):
    assert ts.kmeans(spark.range(9)) is None
    assert ts.kmeans(spark.range(5).selectExpr("id as a", "id * 2 as b")) is None


def test_pca_equals_numpy(blobs):
    fit = ts.pca(blobs, ["x", "y"])
    p = blobs.toPandas()[["x", "y"]].dropna().to_numpy()
    values, vectors = np.linalg.eigh(np.cov(p.T))
    assert fit.ratio == pytest.approx(list(values[::-1] / values.sum()))
    first = vectors[:, -1] * np.sign(vectors[np.argmax(np.abs(vectors[:, -1])), -1])
    assert fit.loadings[0] == pytest.approx(list(first))
    placed = fit.project(blobs).toPandas()
    assert placed["pc1"].mean() == pytest.approx(0, abs=1e-9)
    assert placed["pc1"].var() == pytest.approx(values[-1])
    assert ts.cluster_projection(blobs, ts.kmeans(blobs, 3, ["x", "y"], 1)).agg(
        F.sum("n")).first()[0] == 294


# Plot data

def test_histogram_equals_numpy(messy):
    got = ts.histogram(messy, ["score"]).orderBy("bin").collect()
    values = messy.toPandas()["score"].dropna()
    counts, edges = np.histogram(values, 30)
    assert [r["n"] for r in got] == list(counts)
    assert [r["lower"] for r in got] == pytest.approx(list(edges[:-1]))


def test_histogram_of_constant_and_infinite(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, float("inf")), (2.0, 3.0)], "c double, i double")
    got = ts.histogram(df).where("n > 0").collect()
    assert {(r["column"], r["bin"], r["n"]) for r in got} == {("c", 15, 3), ("i", 0, 1), ("i", 29, 1)}


def test_boxes(messy):
    whole = rows(ts.boxplot(messy, ["age"]))["age"]
    ages = messy.toPandas()["age"]
    assert (whole["q1"], whole["median"], whole["q3"]) == pytest.approx(
        tuple(ages.quantile([0.25, 0.5, 0.75])))
    grouped = rows(ts.boxplot_by_category(messy, "category", "age"))
    for name, part in messy.toPandas().groupby("category")["age"]:
        assert grouped[name]["median"] == pytest.approx(part.median())
    assert ts.boxplot_grid(messy).count() == 6


def test_scatter(messy):
    bins = ts.scatter(messy, "age", "score", "category")
    assert bins.agg(F.sum("n")).first()[0] == messy.where("score is not null").count()
    assert ts.scatter_matrix(messy).select("x", "y").distinct().count() == 6


# Report and the whole analysis

def test_report_and_narrative(spark, messy):
    report = ts.summary_report(messy)
    values = {(r["section"], r["item"]): r["value"] for r in report.collect()}
    assert values["overview", "total_rows"] == 105 and values["quality", "duplicate_rows"] == 5
    page = ts.report_html(report.unionByName(spark.createDataFrame(
        [("quality", "<&>", 1.0)], report.schema)))
    assert "&lt;&amp;&gt;" in page and page.count("<table>") == page.count("</table>") == 3
    text = [r["text"] for r in ts.narrative(messy).orderBy("line").collect()]
    assert text[0] == "Total records: 105" and text[-1] == "Duplicate rows: 5"


def test_recommendations(spark, messy):
    names = [r["analysis"] for r in ts.recommend_analyses(messy).orderBy("position").collect()]
    assert names[0] == "data_quality" and names[-1] == "groupby_analysis" and len(names) == 8
    assert ts.recommend_analyses(spark.range(3)).count() == 5


def test_analysis_of_a_messy_table(messy):
    run = ts.analyse(messy)
    assert [s for s in run.status if s[2] == "failed"] == [] and len(run.status) == 22
    assert run.table.count() == 100
    assert run.table.columns == ["id", "age", "income", "category", "score", "category_encoded"]
    assert ts.overview(run.table).n_missing == 0
    assert run.results["perform_regression_analysis"].where("term = '(r2)'").count() == 1
    assert run.results["plot_distributions"].select("column").distinct().count() == 5
    run.close()


def test_analysis_of_a_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n" + "\n".join(f"{i},{i % 3}" for i in range(30)))
    run = ts.analyse(str(tmp_path / "t.csv"), spark)
    assert [s for s in run.status if s[2] == "failed"] == [] and run.table.columns == ["a", "b"]


def test_analysis_of_four_rows(spark):
    run = ts.analyse(spark.createDataFrame(
        [(1.0, 4.0, "x"), (2.0, 5.0, "y"), (3.0, None, "z"), (None, 6.0, None)], ["a", "b", "c"]))
    assert [s for s in run.status if s[2] == "failed"] == []


def test_a_failing_step_does_not_end_the_run(messy, monkeypatch):
    from tablescout.plans import workflow
    monkeypatch.setattr(workflow, "histogram", lambda df: 1 / 0)
    status = {s[1]: s[2:] for s in ts.analyse(messy).status}
    assert status["plot_distributions"] == ("failed", "division by zero")
    assert status["plot_boxplots"][0] == "success" and len(status) == 22
