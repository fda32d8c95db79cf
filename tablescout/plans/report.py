"""Report rows, narrative and recommended analyses."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.describe import describe_numeric
from ..operators.profile import Overview, overview

MEGABYTE = 1024.0 ** 2

# Names of the analyses, in the order they are recommended.
FOR_NUMBERS = ["summary_statistics", "distributions", "correlations", "clustering", "regression"]
FOR_CATEGORIES = ["categorical_analysis", "groupby_analysis"]
FOR_DEFECTS = ["data_quality"]


def recommend_analyses(df: DataFrame, facts: Overview | None = None) -> DataFrame:
    """``(position, analysis)``: what the table's columns and defects call for."""
    facts = facts or overview(df)
    names = ((FOR_DEFECTS if facts.n_missing or facts.n_duplicates else [])
             + (FOR_NUMBERS if facts.n_numerical else [])
             + (FOR_CATEGORIES if facts.n_categorical else []))
    return df.sparkSession.createDataFrame(
        list(enumerate(names, 1)), "position int, analysis string")


def narrative(df: DataFrame, facts: Overview | None = None) -> DataFrame:
    """``(line, text)``: the totals of the table in words."""
    facts = facts or overview(df)
    rows = [("Total records", facts.n_rows), ("Total features", facts.n_columns),
            ("Numerical features", facts.n_numerical),
            ("Categorical features", facts.n_categorical),
            ("Missing values", facts.n_missing), ("Duplicate rows", facts.n_duplicates)]
    table = df.sparkSession.createDataFrame(
        [(i, name, n) for i, (name, n) in enumerate(rows, 1)], "line int, name string, n long")
    return table.select("line", F.concat("name", F.lit(": "), F.format_number("n", 0)).alias("text"))


def result_rows(results: dict[str, DataFrame]) -> DataFrame | None:
    """``(analysis, content)``: every row of every result, whatever its columns, as a variant."""
    out = None
    for name, result in results.items():
        rows = result.select(F.lit(name).alias("analysis"), F.parse_json(F.to_json(
            F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in result.columns]))
        ).alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return out


def summary_report(df: DataFrame, facts: Overview | None = None,
                   numbers: dict[str, dict] | None = None,
                   results: dict[str, DataFrame] | None = None) -> DataFrame:
    """``(section, item, value)``: overview, statistics and quality of a table, and the number
    of rows of each of the ``results`` (``result_rows`` has the rows themselves)."""
    facts = facts or overview(df)
    spark = df.sparkSession
    rows = [("overview", "total_rows", facts.n_rows), ("overview", "total_columns", facts.n_columns),
            ("overview", "numerical_columns", facts.n_numerical),
            ("overview", "categorical_columns", facts.n_categorical),
            ("overview", "data_megabytes", facts.data_bytes / MEGABYTE),
            ("quality", "missing_values", facts.n_missing),
            ("quality", "duplicate_rows", facts.n_duplicates),
            ("quality", "columns_with_missing", facts.columns_with_missing)]
    out = spark.createDataFrame([(s, i, float(v)) for s, i, v in rows],
                                "section string, item string, value double")
    counted = None
    for name, result in (results or {}).items():
        one = result.agg(F.lit("results").alias("section"), F.lit(name).alias("item"),
                         F.count(F.lit(1)).cast("double").alias("value"))
        counted = one if counted is None else counted.unionByName(one)
    if counted is not None:
        out = out.unionByName(counted)
    if not facts.n_numerical:
        return out
    described = describe_numeric(df, facts=numbers).withColumn("count", F.col("count").cast("double"))
    stats = described.unpivot(["column"], [c for c in described.columns if c != "column"],
                              "metric", "value")
    return out.unionByName(stats.select(
        F.lit("statistics").alias("section"),
        F.concat_ws(".", "column", "metric").alias("item"), "value"))


def report_html(report: DataFrame, title: str = "Data report",
                results: dict[str, DataFrame] | None = None, shown: int = 20) -> str:
    """A report of ``summary_report`` as a small HTML page; a few rows per column.

    Of each of the ``results`` the first ``shown`` rows are printed; all text is escaped.
    """
    parts = [f"<html><head><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]

    def listed(name: str, rows: list[tuple]) -> None:
        cells = "".join("<tr>" + "".join(f"<td>{'' if v is None else escape(str(v))}</td>"
                                         for v in row) + "</tr>" for row in rows)
        parts.append(f"<h2>{escape(name)}</h2><table>{cells}</table>")

    rows = report.collect()
    for section in ("overview", "statistics", "quality", "results"):
        inside = [(r["item"], r["value"]) for r in rows if r["section"] == section]
        if inside:
            listed(section, inside)
    for name, result in (results or {}).items():
        listed(name, [tuple(result.columns), *map(tuple, result.limit(shown).collect())])
    return "".join(parts) + "</body></html>"
