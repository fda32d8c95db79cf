"""The whole exploratory analysis of one table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NUMERIC, col, columns_of
from ..functions.scale import settle
from ..operators.cleaning import drop_duplicates, impute
from ..operators.clusters import RESTARTS, kmeans
from ..operators.describe import numeric_facts, summary_statistics
from ..operators.features import label_encode, standardize
from ..operators.outliers import outliers
from ..operators.plotdata import (boxplot, boxplot_grid, count_plot, histogram, pair_plot,
                                  scatter_matrix)
from ..operators.profile import Overview, identify_types, overview, quality_profile
from ..operators.relations import (correlation_heatmap, correlations, linear_regression,
                                   mutual_information, strong_relationships)
from ..sources.tables import load
from .report import narrative, summary_report

STATUS = "seq int, step string, status string, error string"
ITEMS = "seq int, step string, status string, item string, value double"

# Columns of a step's result that name a row; its other numeric columns are the values.
KEYS = {"assess_data_quality": ["column"], "identify_data_types": ["column", "type_group"],
        "generate_summary_statistics": ["section", "column", "metric", "text"],
        "detect_outliers": ["column"], "plot_distributions": ["column", "bin"],
        "plot_boxplots": ["column"], "plot_countplots": ["column", "value"],
        "perform_clustering": ["cluster"], "compute_correlations": ["method", "var1", "var2"],
        "correlation_heatmap": ["var1", "var2"],
        "create_scatter_matrix": ["x", "y", "bin_x", "bin_y"],
        "plot_pairplot": ["x", "y", "bin_x", "bin_y"],
        "plot_boxplots_categorical_vs_numerical": ["category_column", "category",
                                                   "number_column"],
        "identify_strong_relationships": ["var1", "var2", "strength"],
        "perform_regression_analysis": ["term"], "compute_mutual_information": ["feature"],
        "generate_narrative_summary": ["text"],
        "handle_duplicates": ["item"], "handle_missing_values": ["item"],
        "encode_categorical_features": ["item"], "normalize_data": ["item"], "create_summary_report": ["section", "item"]}


@dataclass
class Run:
    """What an analysis gave: the state of its steps, result tables, the final table."""

    status: list[tuple] = field(default_factory=list)
    results: dict[str, DataFrame] = field(default_factory=dict)
    table: DataFrame | None = None

    def status_table(self) -> DataFrame:
        """``(seq, step, status, error)``"""
        return self.table.sparkSession.createDataFrame(self.status, STATUS)

    def items(self, leave_out: Sequence[str] = ()) -> DataFrame:
        """``(seq, step, status, item, value)``: every number of every step's result.

        ``item`` is the keys of the result's row and the name of the value, with dots between.
        A step without a result has one row without item, a result without rows none. Results
        named in ``leave_out`` have that one row too.
        """
        spark = self.table.sparkSession
        parts = []
        for seq, step, status, _ in self.status:
            result = None if step in leave_out else self.results.get(step)
            if result is None:
                parts.append(spark.createDataFrame([(seq, step, status, None, None)], ITEMS))
                continue
            parts.append(long_form(result, KEYS.get(step, [])).select(
                F.lit(seq).alias("seq"), F.lit(step).alias("step"),
                F.lit(status).alias("status"), "item", "value"))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def close(self) -> None:
        """Let go of the kept final table."""
        if self.table is not None:
            self.table.unpersist()


def long_form(result: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(item, value)``: one row per numeric column of each row that is no key."""
    named = [F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]
    values = [f.name for f in result.schema.fields
              if f.name not in keys and isinstance(f.dataType, T.NumericType)]
    if not values:
        return result.select(F.concat_ws(".", *named).alias("item"),
                             F.lit(None).cast("double").alias("value"))
    return result.select(F.explode(F.array(*[
        F.struct(F.concat_ws(".", *named, *([] if values == ["value"] else [F.lit(v)])).alias("item"),
                 col(v).cast("double").alias("value")) for v in values])).alias("v")).select("v.*")


def analyse(source: Any, spark=None, restarts: int = RESTARTS) -> Run:
    """Run the 22 steps in order: profile, clean, encode, scale, explore, relate, report.

    Cleaning, encoding and scaling each replace the table that the later steps
    see. They are plans over one another; one pass keeps the final table in memory and on disk,
    and what is observed in it (rows, gaps, means and deviations) is what the four steps did. A
    step that fails is noted with its error and the run goes on; if the kept pass itself fails,
    so do the four steps, and the run goes on with the table as it was read. Results are
    settled, so an error shows in its own step. A step that has nothing to work on (no two
    numeric columns, say) is ``empty``.
    """
    df = source if isinstance(source, DataFrame) else load(spark, source)
    run = Run(table=df)
    facts: dict[str, Any] = {}
    made: dict[str, DataFrame] = {}

    def step(name: str, work: Callable[[], DataFrame | None]) -> None:
        seq = len(run.status) + 1
        try:
            result = work()
            if result is not None:
                run.results[name] = settle(result)
            run.status.append((seq, name, "empty" if result is None else "success", None))
        except Exception as error:    # one failed step must not end the run
            run.status.append((seq, name, "failed", str(error)))

    def replace(name: str, make: Callable[[DataFrame], DataFrame]) -> None:
        def work() -> None:
            run.table = made[name] = make(run.table)
        step(name, work)

    def keep() -> None:
        """The one pass over the cleaned table; it also gives the replacing steps their results."""
        observation, table = Observation("cleaned"), run.table
        numeric = columns_of(table, NUMERIC)
        try:
            run.table = table.observe(
                observation, F.count(F.lit(1)).alias("rows"),
                *[F.count(_present(table, c)).alias(f"n{i}") for i, c in enumerate(table.columns)],
                *[e for i, c in enumerate(numeric) for e in (
                    F.avg(_present(table, c)).alias(f"m{i}"),
                    F.stddev_pop(_present(table, c)).alias(f"s{i}"))],
            ).persist(StorageLevel.MEMORY_AND_DISK)
            run.table.count()
            seen = observation.get
            missing = {c: seen["rows"] - seen[f"n{i}"] for i, c in enumerate(table.columns)}
            spread = {c: (seen[f"m{i}"], seen[f"s{i}"]) for i, c in enumerate(numeric)}
            for name, after in made.items():
                run.results[name] = settle(_cleaned(name, after, seen["rows"], missing, spread))
            state = "success", None
            if "single" in facts:
                facts["single"].unpersist()
        except Exception as error:
            run.table, state = df, ("failed", str(error))
        run.status = [(seq, name, *(state if name in made else (status, error)))
                      for seq, name, status, error in run.status]

    def totals() -> Overview:
        if "final" not in facts:
            facts["final"] = overview(run.table)
        return facts["final"]

    def numbers() -> dict[str, dict]:
        if "numbers" not in facts:
            facts["numbers"] = numeric_facts(run.table)
        return facts["numbers"]

    def assess() -> DataFrame:
        profile = settle(quality_profile(run.table))
        first = profile.first()
        facts["copies"] = first["duplicate_rows"] if first else 0
        return profile

    def without_copies(table: DataFrame) -> DataFrame:
        if facts.get("copies") == 0:
            return table
        # the statistics of the next three steps read it, so it is kept until they are done
        facts["single"] = drop_duplicates(table).persist(StorageLevel.MEMORY_AND_DISK)
        return facts["single"]

    def clusters() -> DataFrame | None:
        fit = kmeans(run.table, restarts=restarts)
        if fit is None:
            return None
        return fit.assign(run.table).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).select(
            "cluster", "n", F.lit(fit.k).alias("k"), F.lit(fit.silhouette).alias("silhouette"))

    def related() -> DataFrame:
        both = settle(correlations(run.table))
        facts["pairs"] = both.where(F.col("method") == "pearson").drop("method")
        run.results["correlation_heatmap"] = settle(
            correlation_heatmap(run.table, pairs=facts["pairs"]))
        return both

    def regression() -> DataFrame | None:
        fit = linear_regression(run.table)
        return None if fit is None else fit.table(run.table)

    def card() -> DataFrame:
        return run.table.sparkSession.createDataFrame([tuple(vars(totals()).values())], ", ".join(
            f"{k} long" for k in vars(totals())))

    step("assess_data_quality", assess)
    replace("handle_duplicates", without_copies)
    replace("handle_missing_values", impute)
    step("identify_data_types", lambda: identify_types(run.table))
    replace("encode_categorical_features", label_encode)
    replace("normalize_data", standardize)
    keep()
    step("generate_summary_statistics",
         lambda: summary_statistics(run.table, facts=numbers()))
    step("detect_outliers", lambda: outliers(run.table))
    step("plot_distributions", lambda: histogram(run.table))
    step("plot_boxplots", lambda: boxplot(run.table, facts=numbers()))
    step("plot_countplots", lambda: count_plot(run.table))
    step("perform_clustering", clusters)
    step("compute_correlations", related)
    step("create_scatter_matrix", lambda: scatter_matrix(run.table))
    step("plot_pairplot", lambda: pair_plot(run.table))
    step("plot_boxplots_categorical_vs_numerical", lambda: boxplot_grid(run.table))
    step("identify_strong_relationships",
         lambda: strong_relationships(run.table, pairs=facts.get("pairs")))
    step("perform_regression_analysis", regression)
    step("compute_mutual_information", lambda: mutual_information(run.table))
    step("generate_narrative_summary", lambda: narrative(run.table, totals()))
    step("create_summary_report",
         lambda: summary_report(run.table, totals(), numbers(), run.results))
    step("create_interactive_dashboard", card)
    return run


def _present(df: DataFrame, name: str) -> Column:
    """A column's values, with missing ones as NULL."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def _cleaned(name: str, after: DataFrame, rows: int, missing: dict[str, int],
             spread: dict[str, tuple]) -> DataFrame:
    """``(item, value)`` of a cleaning step, as the final table shows it."""
    if name == "handle_duplicates":
        values = [("rows", rows)]
    elif name == "normalize_data":
        values = [(f"{c}.{k}", v) for c, both in spread.items() for k, v in zip(
            ("mean", "std"), both)]
    else:
        values = [("columns", len(after.columns)),
                  ("missing", sum(missing[c] for c in after.columns))]
    return after.sparkSession.createDataFrame(
        [(k, None if v is None else float(v)) for k, v in values], "item string, value double")
