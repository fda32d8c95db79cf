"""The registered query of the whole analysis, and the SQL of every step that SQL can state."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..plans import workflow
from .exploring import _bin_sql, _box_sql, _spearman_sql, _union
from .registry import query, table

# The steps of the analysis, in order.
STEPS = ["assess_data_quality", "handle_duplicates", "handle_missing_values",
         "identify_data_types", "encode_categorical_features", "normalize_data",
         "generate_summary_statistics", "detect_outliers", "plot_distributions", "plot_boxplots",
         "plot_countplots", "perform_clustering", "compute_correlations",
         "create_scatter_matrix", "plot_pairplot", "plot_boxplots_categorical_vs_numerical",
         "identify_strong_relationships", "perform_regression_analysis",
         "compute_mutual_information", "generate_narrative_summary", "create_summary_report",
         "create_interactive_dashboard"]

COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "grade", "zone", "o_orderdate"]
NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice", "grade_encoded", "zone_encoded"]
TEXTS = ["grade", "zone"]
STATS = {"count": "count({0})", "mean": "avg({0})", "std": "stddev_samp({0})", "min": "min({0})",
         "q25": "quantile_cont({0}, 0.25)", "q50": "quantile_cont({0}, 0.5)",
         "q75": "quantile_cont({0}, 0.75)", "max": "max({0})"}


def flawed_orders(spark, sf_dir):
    """Orders with gaps, outliers, repeated rows and two categories."""
    key = F.col("o_orderkey")
    price = F.when(key % 500 == 1, F.col("o_totalprice") * 50).otherwise(F.col("o_totalprice"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.when(key % 10 != 0, price).alias("o_totalprice"),
        F.when(key % 7 != 0, F.concat(F.lit("g"), (key * 7919 + F.col("o_custkey")) % 8))
        .alias("grade"),
        F.concat(F.lit("z"), F.least(F.floor(F.col("o_custkey") / 100), F.lit(11)) + 10)
        .alias("zone"), "o_orderdate")
    return rows.unionByName(rows.where(key % 50 == 0))


def _scaled(c: str) -> str:
    return f"({c} - (select avg({c}) from coded)) / (select stddev_pop({c}) from coded) as {c}"


TABLES = f"""
with one as (select o_orderkey, o_custkey,
    case when o_orderkey % 10 <> 0 then
      case when o_orderkey % 500 = 1 then o_totalprice * 50 else o_totalprice end end as o_totalprice,
    case when o_orderkey % 7 <> 0 then 'g' || (o_orderkey * 7919 + o_custkey) % 8 end as grade,
    'z' || (least(o_custkey // 100, 11) + 10) as zone, o_orderdate from orders),
flawed as (select * from one union all select * from one where o_orderkey % 50 = 0),
single as (select distinct * from flawed),
filled as (select o_orderkey, o_custkey,
    coalesce(o_totalprice, (select quantile_cont(o_totalprice, 0.5) from single)) as o_totalprice,
    coalesce(grade, (select grade from single where grade is not null group by grade
                     order by count(*) desc, grade limit 1)) as grade, zone, o_orderdate
  from single),
coded as (select *, (dense_rank() over (order by grade) - 1)::double as grade_encoded,
    (dense_rank() over (order by zone) - 1)::double as zone_encoded from filled),
t as materialized (select {', '.join(_scaled(c) for c in NUMBERS)}, grade, zone, o_orderdate
  from coded)"""


def _values(step: str, item: str, source: str, **values: str) -> list[str]:
    """Rows of a step: one for each value of each row of ``source``."""
    seq = STEPS.index(step) + 1
    return [f"select {seq} as seq, '{step}' as step, 'success' as status, "
            f"{item}{f' || {chr(39)}{k}{chr(39)}' if k != 'value' else ''} as item, "
            f"cast({v} as double) as value from {source}" for k, v in values.items()]


def _missing(columns, source: str) -> str:
    return " + ".join(f"(select count(*) - count({c}) from {source})" for c in columns)


def _bytes(c: str, text: bool) -> str:
    return f"coalesce(sum(octet_length(encode({c}))), 0)" if text else f"count({c}) * 8"


def _quality() -> list[str]:
    copies = "(select count(*) from flawed) - (select count(*) from single)"
    return [r for i, c in enumerate(COLUMNS) for r in _values(
        STEPS[0], f"'{c}.'", "flawed", position=f"any_value({i})", n_rows="count(*)",
        n_missing=f"count(*) - count({c})",
        pct_missing=f"(count(*) - count({c})) * 100.0::double / count(*)",
        data_bytes=_bytes(c, c in TEXTS), duplicate_rows=f"any_value({copies})")]


def _types() -> list[str]:
    group = dict.fromkeys(COLUMNS[:3], "numerical") | dict.fromkeys(TEXTS, "categorical") | {
        "o_orderdate": "datetime"}
    return [r for i, c in enumerate(COLUMNS) for r in _values(
        STEPS[3], f"'{c}.{group[c]}.'", "filled", position=f"any_value({i})", n_values=f"count({c})")]


def _summary() -> list[str]:
    step, everything = STEPS[6], [*COLUMNS, "grade_encoded", "zone_encoded"]
    kinds = dict.fromkeys(NUMBERS, "double") | dict.fromkeys(TEXTS, "string") | {
        "o_orderdate": "timestamp_ntz"}
    rows = [r for c in everything for r in _values(
        step, f"'unique_counts.{c}.unique.'", "t", value=f"count(distinct {c})")]
    rows += [r for c in everything for r in _values(
        step, f"'data_types.{c}.dtype.{kinds[c]}'", "(select 1)", value="null")]
    rows += [r for c in NUMBERS for k, e in STATS.items() for r in _values(
        step, f"'numerical.{c}.{k}.'", "t", value=e.format(c))]
    for c in TEXTS:
        rows += _values(step, f"'categorical.{c}.unique_values.'", "t",
                        value=f"count(distinct {c})")
        rows += _values(step, f"'categorical.{c}.top_' || place || '.' || {c}",
                        f"(select {c}, count(*) as n, row_number() over (order by count(*) desc, "
                        f"{c}) as place from t group by {c}) where place <= 10", value="n")
    return rows


def _outliers() -> list[str]:
    return [r for c in NUMBERS for r in _values(
        STEPS[7], f"'{c}.'", f"(select {c} as x, avg({c}) over () as m, "
        f"stddev_samp({c}) over () as s from t)",
        n_outliers="count(*) filter (where abs(x - m) / s > 3)",
        pct_outliers="count(*) filter (where abs(x - m) / s > 3) * 100.0::double / count(*)")]


def _histograms() -> list[str]:
    return [r for c in NUMBERS for r in _values(
        STEPS[8], f"'{c}.' || g.bin || '.'",
        f"""(select range as bin from range(30)) g
  cross join (select min({c}) as lo, max({c}) as hi from t) e
  left join (select {_bin_sql(c, 'e2.lo', 'e2.hi', 30)} as bin, count(*) as n from t,
    (select min({c}) as lo, max({c}) as hi from t) e2 group by 1) h on g.bin = h.bin""",
        lower="lo + (hi - lo) / 30 * g.bin", upper="lo + (hi - lo) / 30 * (g.bin + 1)",
        n="coalesce(n, 0)")]


BOX = ["n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"]


def _boxes(step: str, item: str, source: str) -> list[str]:
    return _values(step, item, f"({source})", **{c: c for c in BOX})


def _correlations() -> list[str]:
    pairs = list(combinations(NUMBERS, 2))
    return [r for a, b in pairs for r in (
        *_values(STEPS[12], f"'pearson.{a}.{b}.'", "t", correlation=f"corr({a}, {b})"),
        *_values(STEPS[12], f"'spearman.{a}.{b}.'", f"({_spearman_sql(a, b, 't')})",
                 correlation="correlation"))]


def _cells(a: str, b: str) -> str:
    ends = "(select min({0}) as a, max({0}) as b from t)"
    return (f"(select {_bin_sql(a, 'e.a', 'e.b', 20)} as bx, {_bin_sql(b, 'f.a', 'f.b', 20)} as b2, "
            f"count(*) as n from t, {ends.format(a)} e, {ends.format(b)} f group by 1, 2)")


def _scatters() -> list[str]:
    out = []
    for a, b in combinations(NUMBERS, 2):
        for step in (STEPS[13], STEPS[14]):
            out += _values(step, f"'{a}.{b}.' || bx || '.' || b2 || '.'", _cells(a, b), n="n")
    for a in NUMBERS:
        out += _values(STEPS[14], f"'{a}.{a}.' || bx || '..'",
                       f"(select bx, sum(n) as n from {_cells(a, a)} group by bx)", n="n")
    return out


def _strong() -> list[str]:
    return [r for a, b in combinations(NUMBERS, 2) for r in _values(
        STEPS[16], f"'{a}.{b}.' || case when abs(r) > 0.7 then 'strong' else 'moderate' end || '.'",
        f"(select corr({a}, {b}) as r from t) where abs(r) >= 0.5", correlation="r")]


def _regression() -> tuple[str, list[str]]:
    """Gaussian elimination of the normal equations, one step per table."""
    size = len(NUMBERS) - 1

    def start(i: int, j: int) -> str:
        return f"covar_pop({NUMBERS[i]}, {NUMBERS[j]}) as a_{i}_{j}"

    steps = [f"e0 as (select {', '.join(start(i, j) for i in range(size) for j in range(size + 1))}, "
             f"var_pop({NUMBERS[size]}) as yy, "
             + ", ".join(f"covar_pop({NUMBERS[i]}, {NUMBERS[size]}) as xy_{i}" for i in range(size))
             + ", " + ", ".join(f"avg({c}) as m_{i}" for i, c in enumerate(NUMBERS)) + " from t)"]
    kept = ["yy", *[f"xy_{i}" for i in range(size)], *[f"m_{i}" for i in range(size + 1)]]
    for k in range(size):
        cells = [f"a_{k}_{j} / a_{k}_{k} as a_{k}_{j}" if i == k else
                 f"a_{i}_{j} - a_{i}_{k} * a_{k}_{j} / a_{k}_{k} as a_{i}_{j}"
                 for i in range(size) for j in range(size + 1)]
        steps.append(f"e{k + 1} as (select {', '.join(cells + kept)} from e{k})")
    beta = [f"a_{i}_{size}" for i in range(size)]
    rows = [r for i in range(size) for r in _values(
        STEPS[17], f"'{NUMBERS[i]}'", f"e{size}", value=beta[i])]
    rows += _values(STEPS[17], "'(intercept)'", f"e{size}", value=f"m_{size} - (" + " + ".join(
        f"{beta[i]} * m_{i}" for i in range(size)) + ")")
    rows += _values(STEPS[17], "'(r2)'", f"e{size}", value="(" + " + ".join(
        f"{beta[i]} * xy_{i}" for i in range(size)) + ") / yy")
    return ",\n".join(steps), rows


def _information() -> list[str]:
    target, ends = NUMBERS[-1], "(select min({0}) as a, max({0}) as b from t)"
    return [r for f in NUMBERS[:-1] for r in _values(
        STEPS[18], f"'{f}.'",
        f"""(select *, sum(n) over (partition by x) as nx, sum(n) over (partition by y) as ny,
      sum(n) over () as total from (select {_bin_sql(f, 'e.a', 'e.b', 10)} as x,
      {_bin_sql(target, 'f.a', 'f.b', 10)} as y, count(*)::double as n
      from t, {ends.format(f)} e, {ends.format(target)} f group by 1, 2))""",
        mi="greatest(sum(n / total * ln(n * total / (nx * ny))), 0)")]


EVERY = [*COLUMNS, "grade_encoded", "zone_encoded"]
SIZE = "(select " + " + ".join(_bytes(c, c in TEXTS) for c in EVERY) + " from t)"
ROWS, GAPS = "(select count(*) from t)", _missing(EVERY, "t")
COPIES = f"{ROWS} - (select count(*) from (select distinct * from t))"


def _story() -> list[str]:
    lines = [("Total records", ROWS), ("Total features", str(len(EVERY))),
             ("Numerical features", str(len(NUMBERS))), ("Categorical features", str(len(TEXTS))),
             ("Missing values", GAPS), ("Duplicate rows", COPIES)]
    rows = [r for i, (name, n) in enumerate(lines, 1) for r in _values(
        STEPS[19], f"'{name}: ' || format('{{:,}}', ({n})::bigint) || '.'", "(select 1)",
        line=str(i))]
    report = {"overview.total_rows": ROWS, "overview.total_columns": str(len(EVERY)),
              "overview.numerical_columns": str(len(NUMBERS)),
              "overview.categorical_columns": str(len(TEXTS)),
              "overview.data_megabytes": f"{SIZE} / 1048576.0::double",
              "quality.missing_values": GAPS, "quality.duplicate_rows": COPIES,
              "quality.columns_with_missing": "0"}
    rows += [r for item, e in report.items() for r in _values(
        STEPS[20], f"'{item}'", "(select 1)", value=e)]
    rows += [r for c in NUMBERS for k, e in STATS.items() for r in _values(
        STEPS[20], f"'statistics.{c}.{k}'", "t", value=e.format(c))]
    return rows + _values(
        STEPS[21], "''", "(select 1)", n_rows=ROWS, n_columns=str(len(EVERY)),
        n_numerical=str(len(NUMBERS)), n_categorical=str(len(TEXTS)), n_missing=GAPS,
        columns_with_missing="0", n_duplicates=COPIES, data_bytes=SIZE)


def _counted(rows: list[str]) -> list[str]:
    """How many rows each result has, as the report says: items by their values per row."""
    per_row = {STEPS[0]: 6, STEPS[3]: 2, STEPS[7]: 2, STEPS[8]: 3, STEPS[9]: len(BOX),
               STEPS[15]: len(BOX)}
    names = [s for s in STEPS[:19] if s != "perform_clustering"]
    out = [r for s in names for r in _values(
        STEPS[20], f"'results.{s}'", f"steps where step = '{s}'",
        value=f"count(*) / {per_row.get(s, 1)}")]
    return out + _values(STEPS[20], "'results.generate_narrative_summary'", "(select 1)",
                         value="6") + _values(STEPS[20], "'results.correlation_heatmap'",
                                              "(select 1)", value=str(len(NUMBERS) ** 2))


def _sql() -> str:
    elimination, regression = _regression()
    rows = [*_quality(), *_values(STEPS[1], "''", "single", rows="count(*)"),
            *_values(STEPS[2], "''", "(select 1)", columns="6", missing=_missing(COLUMNS, "filled")),
            *_types(), *_values(STEPS[4], "''", "(select 1)", columns="8", missing=GAPS),
            *[r for c in NUMBERS for r in _values(
                STEPS[5], f"'{c}.'", "t", mean=f"avg({c})", std=f"stddev_pop({c})")],
            *_summary(), *_outliers(), *_histograms(),
            *[r for c in NUMBERS for r in _boxes(STEPS[9], f"'{c}.'", _box_sql(
                "t", c, {'"column"': f"'{c}'"}))],
            *[r for c in TEXTS for r in _values(
                STEPS[10], f"'{c}.' || {c} || '.'", f"t group by {c}", n="count(*)")],
            *_correlations(), *_scatters(),
            *[r for c in TEXTS for x in NUMBERS[:2] for r in _boxes(
                STEPS[15], f"'{c}.' || category || '.{x}.'", _box_sql(
                    "t", x, {"category": c}))],
            *_strong(), *regression, *_information(), *_story()]
    left = (f"select {STEPS.index('perform_clustering') + 1}, 'perform_clustering', 'success', "
            "cast(null as varchar), cast(null as double)")
    return (f"{TABLES},\n{elimination},\nsteps as (" + _union(rows) + ")\n"
            "select cast(seq as integer) as seq, step, status, item, round(value, 4) + 0.0 as value "
            "from (select * from steps\nunion all\n" + _union([*_counted(rows), left]) + ")")


@query(_sql())
def eda_run(spark, sf_dir):
    """All numbers of all steps but the fitted clusters, which other queries check."""
    run = workflow.analyse(flawed_orders(spark, sf_dir))
    items = run.items(leave_out=["perform_clustering"]).where(
        "item is null or item <> 'results.perform_clustering'")
    run.close()
    return items.withColumn("value", F.round("value", 4) + F.lit(0.0))
