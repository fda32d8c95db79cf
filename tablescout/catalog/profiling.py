"""Registered queries: profile, frequencies, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import describe, expectations, frequency, profile
from ..plans import report
from .registry import (COPIED_ORDERS, GAPPY_CUSTOMER, LABELLED_DOCUMENTS, copied_orders,
                       gappy_customer, labelled_documents, query, rounded, table)

LINE_COLUMNS = [("l_orderkey", "bigint", "numerical"), ("l_partkey", "bigint", "numerical"),
                ("l_suppkey", "bigint", "numerical"), ("l_linenumber", "int", "numerical"),
                ("l_quantity", "double", "numerical"), ("l_extendedprice", "double", "numerical"),
                ("l_discount", "double", "numerical"), ("l_tax", "double", "numerical"),
                ("l_returnflag", "string", "categorical"),
                ("l_linestatus", "string", "categorical"),
                ("l_shipdate", "timestamp_ntz", "datetime")]
CUSTOMER_COLUMNS = [("c_custkey", "bigint", "numerical", "8"), ("c_name", "string", "categorical", ""),
                    ("c_nationkey", "int", "numerical", "4"),
                    ("c_acctbal", "double", "numerical", "8"),
                    ("c_mktsegment", "string", "categorical", "")]


def _union(parts) -> str:
    return "\nunion all\n".join(parts)


def _bytes(c: str, width: str) -> str:
    return (f"cast(count({c}) * {width} as bigint)" if width
            else f"cast(coalesce(sum(octet_length(encode({c}))), 0) as bigint)")


DUPLICATES = "(select count(*) from t) - (select count(*) from (select distinct * from t))"


@query(_union(
    f"select cast({i} as integer) as position, '{c}' as \"column\", '{d}' as dtype, "
    f"'{g}' as type_group, count({c}) as n_values from lineitem"
    for i, (c, d, g) in enumerate(LINE_COLUMNS)))
def identify_types(spark, sf_dir):
    return profile.identify_types(table(spark, sf_dir, "lineitem"))


@query(f"with t as ({LABELLED_DOCUMENTS}) " + _union(
    f"select '{c}' as \"column\", count(*) as n_rows, count(*) - count({c}) as n_missing, "
    f"round((count(*) - count({c})) / cast(count(*) as double) * 100, 6) as pct_missing from t"
    for c in ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]))
def missing_profile(spark, sf_dir):
    return rounded(profile.missing_profile(labelled_documents(spark, sf_dir)), pct_missing=6)


@query(f"with t as ({GAPPY_CUSTOMER}) " + _union(
    f"select cast({i} as integer) as position, '{c}' as \"column\", '{d}' as dtype, "
    f"'{g}' as type_group, count(*) as n_rows, count(*) - count({c}) as n_missing, "
    f"round((count(*) - count({c})) / cast(count(*) as double) * 100, 6) as pct_missing, "
    f"{_bytes(c, w)} as data_bytes, cast({DUPLICATES} as bigint) as duplicate_rows from t"
    for i, (c, d, g, w) in enumerate(CUSTOMER_COLUMNS)))
def quality_profile(spark, sf_dir):
    return rounded(profile.quality_profile(gappy_customer(spark, sf_dir)), pct_missing=6)


@query(f"""with t as ({COPIED_ORDERS})
select count(*) as n_rows, (select count(*) from (select distinct * from t)) as n_distinct,
       {DUPLICATES} as n_duplicates from t""")
def duplicate_count(spark, sf_dir):
    return profile.duplicate_count(copied_orders(spark, sf_dir))


@query(_union(f"select '{c}' as \"column\", {_bytes(c, w)} as data_bytes from customer"
              for c, _, _, w in CUSTOMER_COLUMNS))
def data_bytes(spark, sf_dir):
    return profile.data_bytes(table(spark, sf_dir, "customer"))


def _describe_sql(c: str, source: str) -> str:
    return (f"select '{c}' as \"column\", count({c}) as count, round(avg({c}), 4) as mean, "
            f"round(stddev_samp({c}), 4) as std, round(cast(min({c}) as double), 4) as min, "
            f"round(quantile_cont(cast({c} as double), 0.25), 4) as q25, "
            f"round(quantile_cont(cast({c} as double), 0.5), 4) as q50, "
            f"round(quantile_cont(cast({c} as double), 0.75), 4) as q75, "
            f"round(cast(max({c}) as double), 4) as max from {source}")


STATS = dict(mean=4, std=4, min=4, q25=4, q50=4, q75=4, max=4)


@query(_union(_describe_sql(c, "lineitem") for c, _, g in LINE_COLUMNS if g == "numerical"))
def describe_numeric(spark, sf_dir):
    return rounded(describe.describe_numeric(table(spark, sf_dir, "lineitem")), **STATS)


def _describe_text_sql(c: str, source: str) -> str:
    return (f"select '{c}' as \"column\", count({c}) as count, count(distinct {c}) as \"unique\", "
            f"(select {c} from {source} where {c} is not null group by {c} "
            f"order by count(*) desc, {c} limit 1) as top, "
            f"(select count(*) from {source} where {c} is not null group by {c} "
            f"order by count(*) desc limit 1) as freq from {source}")


@query(f"with t as ({GAPPY_CUSTOMER}) "
       + _union(_describe_text_sql(c, "t") for c in ["c_name", "c_mktsegment"]))
def describe_categorical(spark, sf_dir):
    return frequency.describe_categorical(gappy_customer(spark, sf_dir))


@query("""with t as (select cast(epoch_us(ts) as double) as u from events)
select 'ts' as "column", count(u) as count,
       make_timestamp(cast(floor(avg(u)) as bigint)) as mean,
       make_timestamp(cast(min(u) as bigint)) as min,
       make_timestamp(cast(floor(quantile_cont(u, 0.25)) as bigint)) as q25,
       make_timestamp(cast(floor(quantile_cont(u, 0.5)) as bigint)) as q50,
       make_timestamp(cast(floor(quantile_cont(u, 0.75)) as bigint)) as q75,
       make_timestamp(cast(max(u) as bigint)) as max from t""".replace(
           "make_timestamp(cast(floor(avg(u)) as bigint))",
           "date_trunc('second', make_timestamp(cast(floor(avg(u)) as bigint)))"))
def describe_datetime(spark, sf_dir):
    # The mean is cut to the second: a sum of microseconds depends on its order.
    return describe.describe_datetime(table(spark, sf_dir, "events")).withColumn(
        "mean", F.date_trunc("second", "mean").cast("timestamp_ntz"))


@query(_union(f"select '{c}' as \"column\", count(distinct {c}) as n_unique from lineitem"
              for c, _, _ in LINE_COLUMNS))
def unique_counts(spark, sf_dir):
    return frequency.unique_counts(table(spark, sf_dir, "lineitem"))


def _counts_sql(c: str, source: str) -> str:
    return (f"select '{c}' as \"column\", {c} as value, count(*) as n from {source} "
            f"where {c} is not null group by {c}")


@query(_union(_counts_sql(c, "orders") for c in ["o_orderstatus", "o_orderpriority"]))
def value_counts(spark, sf_dir):
    return frequency.value_counts(table(spark, sf_dir, "orders"))


@query(f"with c as ({_union(_counts_sql(c, 'part') for c in ['p_name', 'p_brand', 'p_type'])}), "
       "r as (select *, cast(row_number() over (partition by \"column\" order by n desc, value) "
       "as integer) as position from c) "
       "select \"column\", position, value, n from r where position <= 10")
def top_values(spark, sf_dir):
    return frequency.top_values(table(spark, sf_dir, "part"))


@query(f"with c as ({_union(_counts_sql(c, 'orders') for c in ['o_orderstatus', 'o_orderpriority'])}"
       """ union all select 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), count(*)
from orders group by o_orderdate),
r as (select *, row_number() over (partition by "column" order by n desc, value) as p from c)
select "column", value as mode, n from r where p = 1""")
def column_modes(spark, sf_dir):
    return frequency.column_modes(table(spark, sf_dir, "orders"))


@query(_union(f"select '{c}' as \"column\", round(avg({c}), 4) as mean, "
              f"round(median(cast({c} as double)), 4) as median from part"
              for c in ["p_partkey", "p_size", "p_retailprice"]))
def mean_median(spark, sf_dir):
    return rounded(describe.mean_median(table(spark, sf_dir, "part")), mean=4, median=4)


@query(_union(f"select '{c}' as \"column\", round(stddev_samp({c}), 6) as std_sample, "
              f"round(stddev_pop({c}), 6) as std_population from part"
              for c in ["p_partkey", "p_size", "p_retailprice"]))
def column_spread(spark, sf_dir):
    return rounded(describe.column_spread(table(spark, sf_dir, "part")),
                   std_sample=6, std_population=6)


ORDER_TYPES = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
               ("o_orderpriority", "string")]
ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDER_TEXTS = ["o_orderstatus", "o_orderpriority"]
METRICS = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]


@query("with d as (" + _union(_describe_sql(c, "orders") for c in ORDER_NUMBERS) + "), c as ("
       + _union(_counts_sql(c, "orders") for c in ORDER_TEXTS) + """),
r as (select *, row_number() over (partition by "column" order by n desc, value) as p from c)
""" + _union(
    [f"select 'unique_counts' as section, '{c}' as \"column\", 'unique' as metric, "
     f"cast(count(distinct {c}) as double) as value, cast(null as varchar) as text from orders"
     for c, _ in ORDER_TYPES]
    + [f"select 'data_types', '{c}', 'dtype', case when count(*) < 0 then 1.0::double end, "
       f"'{d}' from orders" for c, d in ORDER_TYPES]
    + [f"select 'numerical', \"column\", '{m}', cast(\"{m}\" as double), null from d"
       for m in METRICS]
    + ["select 'categorical', \"column\", 'unique_values', cast(count(*) as double), null "
       "from c group by \"column\"",
       "select 'categorical', \"column\", 'top_' || p, cast(n as double), value from r "
       "where p <= 10"]))
def summary_statistics(spark, sf_dir):
    return rounded(describe.summary_statistics(table(spark, sf_dir, "orders")), value=4)


@query(f"""with t as ({LABELLED_DOCUMENTS}),
f as (select (count(*) - count(quality)) + (count(*) - count(toxic)) > 0
             or {DUPLICATES} > 0 as defects from t),
a as (select * from (values (1, 'data_quality'), (2, 'summary_statistics'), (3, 'distributions'),
      (4, 'correlations'), (5, 'clustering'), (6, 'regression'), (7, 'categorical_analysis'),
      (8, 'groupby_analysis')) v(p, analysis))
select cast(row_number() over (order by p) as integer) as position, analysis
from a, f where defects or p > 1""")
def recommend_analyses(spark, sf_dir):
    return report.recommend_analyses(labelled_documents(spark, sf_dir))


def _check_sql(column, check, passed, failing, detail="cast(null as varchar)") -> str:
    return (f"select '{column}' as \"column\", '{check}' as \"check\", {passed} as passed, "
            f"cast({failing} as bigint) as failing_rows, {detail} as detail from t")


CHECKS = f"with t as ({GAPPY_CUSTOMER}) " + _union(
    [_check_sql(c, "exists", "count(*) >= 0", "0")
     for c in ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]]
    + [_check_sql("c_phone", "exists", "count(*) < 0", "count(*)"),
       _check_sql("c_phone", "dtype", "count(*) < 0", "count(*)"),
       _check_sql("c_custkey", "dtype", "count(*) >= 0", "0", "'bigint'"),
       _check_sql("c_name", "dtype", "count(*) >= 0", "0", "'string'"),
       _check_sql("c_nationkey", "dtype", "count(*) < 0", "count(*)", "'int'"),
       _check_sql("c_acctbal", "dtype", "count(*) >= 0", "0", "'double'")]
    + [_check_sql(c, "not_null", f"count({c}) = count(*)", f"count(*) - count({c})")
       for c in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]])


@query(CHECKS)
def validate_expectations(spark, sf_dir):
    from pyspark.sql.types import StructType
    expected = StructType.fromDDL(
        "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_phone string")
    return expectations.validate(gappy_customer(spark, sf_dir), expected)


TOTALS = f"""n as (select count(*) as n_rows, 5 as n_columns, 3 as n_numerical, 2 as n_categorical,
  (count(*) - count(c_acctbal)) + (count(*) - count(c_mktsegment)) as n_missing,
  cast(count(c_acctbal) < count(*) as int) + cast(count(c_mktsegment) < count(*) as int)
    as columns_with_missing, {DUPLICATES} as n_duplicates,
  {' + '.join(_bytes(c, w) for c, _, _, w in CUSTOMER_COLUMNS)} as data_bytes from t)"""
NAMES = ["n_rows", "n_columns", "n_numerical", "n_categorical", "n_missing",
         "columns_with_missing", "n_duplicates", "data_bytes"]


@query(f"with t as ({GAPPY_CUSTOMER}), {TOTALS} select "
       + ", ".join(f"cast({n} as bigint) as {n}" for n in NAMES) + " from n")
def dataset_overview(spark, sf_dir):
    return profile.dataset_overview(gappy_customer(spark, sf_dir))


@query(f"with t as ({GAPPY_CUSTOMER}), {TOTALS} " + _union(
    f"select cast({i} as integer) as line, '{name}: ' || format('{{:,}}', cast({c} as bigint)) "
    "as text from n" for i, (name, c) in enumerate([
        ("Total records", "n_rows"), ("Total features", "n_columns"),
        ("Numerical features", "n_numerical"), ("Categorical features", "n_categorical"),
        ("Missing values", "n_missing"), ("Duplicate rows", "n_duplicates")], 1)))
def narrative_facts(spark, sf_dir):
    return report.narrative(gappy_customer(spark, sf_dir))


@query(f"with t as ({GAPPY_CUSTOMER}), {TOTALS}, d as ("
       + _union(_describe_sql(c, "t") for c, _, g, _ in CUSTOMER_COLUMNS if g == "numerical") + ") "
       + _union(
           [f"select '{s}' as section, '{i}' as item, round(cast({c} as double), 4) as value from n"
            for s, i, c in [("overview", "total_rows", "n_rows"),
                            ("overview", "total_columns", "n_columns"),
                            ("overview", "numerical_columns", "n_numerical"),
                            ("overview", "categorical_columns", "n_categorical"),
                            ("overview", "data_megabytes", "data_bytes / 1048576.0"),
                            ("quality", "missing_values", "n_missing"),
                            ("quality", "duplicate_rows", "n_duplicates"),
                            ("quality", "columns_with_missing", "columns_with_missing")]]
           + [f"select 'statistics', \"column\" || '.{m}', cast(\"{m}\" as double) from d"
              for m in METRICS]))
def summary_report(spark, sf_dir):
    return rounded(report.summary_report(gappy_customer(spark, sf_dir)), value=4)
