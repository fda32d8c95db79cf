"""Registered queries: relations, clusters, plot data."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import clusters, features, information, plotdata, relations
from .registry import GAPPY_LINES, gappy_lines, query, rounded, table

LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]


def _union(parts) -> str:
    return "\nunion all\n".join(parts)


@query(_union(f"select '{a}' as var1, '{b}' as var2, "
              f"round(corr({a}, {b}), 6) as correlation from lineitem"
              for a, b in combinations(LINE_NUMBERS, 2)))
def corr_pearson(spark, sf_dir):
    return rounded(relations.pearson(table(spark, sf_dir, "lineitem")), correlation=6)


GAPPY_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "one"]


def _or_null(a: str, b: str, r: str) -> str:
    return "cast(null as double)" if "one" in (a, b) else r


@query(f"with t as ({GAPPY_LINES}) " + _union(
    f"select '{a}' as var1, '{b}' as var2, "
    f"{_or_null(a, b, f'round(corr({a}, {b}), 6)')} as correlation from t"
    + (" limit 1" if "one" in (a, b) else "") for a, b in combinations(GAPPY_NUMBERS, 2)
    if "one" not in (a, b)) + "\nunion all\n" + _union(
        f"select '{a}', 'one', case when count(*) < 0 then 0.0::double end from t"
        for a in GAPPY_NUMBERS[:3]))
def corr_pearson_missing(spark, sf_dir):
    return rounded(relations.pearson(gappy_lines(spark, sf_dir)), correlation=6)


def _spearman_sql(a: str, b: str, source: str) -> str:
    def rank(c: str) -> str:
        return (f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double")
    return (f"select '{a}' as var1, '{b}' as var2, round(corr(x, y), 6) as correlation from "
            f"(select {rank(a)} as x, {rank(b)} as y from {source} "
            f"where {a} is not null and {b} is not null)")


@query(_union(_spearman_sql(a, b, "lineitem") for a, b in combinations(LINE_NUMBERS, 2)))
def corr_spearman(spark, sf_dir):
    return rounded(relations.spearman(table(spark, sf_dir, "lineitem")), correlation=6)


@query(f"with t as ({GAPPY_LINES}) " + _union(
    _spearman_sql(a, b, "t") for a, b in combinations(GAPPY_NUMBERS[:3], 2)))
def corr_spearman_missing(spark, sf_dir):
    return rounded(relations.spearman(gappy_lines(spark, sf_dir).drop("one")), correlation=6)


def _dimensions(spark, sf_dir):
    """Embeddings with one column per dimension."""
    vectors = table(spark, sf_dir, "embeddings")
    size = vectors.agg(F.max(F.size("embedding"))).first()[0]
    return vectors.select("vec_id", *[
        F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(size)]), [
            f"d{i}" for i in range(size)]


@query("""with t as (select vec_id, unnest(embedding)::double as x,
                  generate_subscripts(embedding, 1) - 1 as i from embeddings)
select 'd' || a.i as var1, 'd' || b.i as var2, round(corr(a.x, b.x), 6) as correlation
from t a join t b on a.vec_id = b.vec_id and a.i < b.i group by a.i, b.i""")
def corr_pearson_wide(spark, sf_dir):
    vectors, names = _dimensions(spark, sf_dir)
    return rounded(relations.pearson(vectors, names), correlation=6)


WIDE = 100


@query(f"""with t as materialized (select p_partkey as id, i, case when p_partkey % (5 + i % 7) <> 0
    then (p_partkey * (i + 3) % (97 + i) + p_size * (i % 4))::double end as x
  from part, range({WIDE}) r(i))
select 'c' || a.i as var1, 'c' || b.i as var2, round(corr(a.x, b.x), 6) as correlation
from t a join t b on a.id = b.id and a.i < b.i group by a.i, b.i""")
def corr_pearson_gappy_wide(spark, sf_dir):
    return rounded(relations.pearson(_arithmetic(spark, sf_dir, WIDE)), correlation=6)


def _arithmetic(spark, sf_dir, width):
    """Columns by arithmetic on ``part``, each with gaps of its own."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(*[
        F.when(key % (5 + i % 7) != 0, (key * (i + 3) % (97 + i) + size * (i % 4)).cast("double"))
        .alias(f"c{i}") for i in range(width)])


RANKED = 20


@query(f"""with t as materialized (select p_partkey as id, i, case when p_partkey % (5 + i % 7) <> 0
    then (p_partkey * (i + 3) % (97 + i) + p_size * (i % 4))::double end as x
  from part, range({RANKED}) r(i)),
pairs as (select a.i as i, b.i as j, a.x as x, b.x as y from t a join t b
  on a.id = b.id and a.i < b.i where a.x is not null and b.x is not null),
ranked as (select i, j,
  rank() over (partition by i, j order by x) + (count(*) over (partition by i, j, x) - 1) / 2.0::double as x,
  rank() over (partition by i, j order by y) + (count(*) over (partition by i, j, y) - 1) / 2.0::double as y
  from pairs)
select 'c' || i as var1, 'c' || j as var2, round(corr(x, y), 6) as correlation
from ranked group by i, j""")
def corr_spearman_gappy_wide(spark, sf_dir):
    return rounded(relations.spearman(_arithmetic(spark, sf_dir, RANKED)), correlation=6)


@query("""with t as (select l_quantity, l_extendedprice, l_discount from lineitem)
select 'l_quantity' as var1, 'l_extendedprice' as var2,
  round(corr(l_quantity, l_extendedprice), 6) as correlation from t
union all select 'l_quantity', 'l_discount', cast(null as double)
union all select 'l_extendedprice', 'l_discount', cast(null as double)""")
def corr_pearson_infinite(spark, sf_dir):
    # An infinite value leaves no correlation with its column, and the others as they are.
    return rounded(relations.pearson(table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", F.when(
            F.col("l_orderkey") % 100 != 7, F.col("l_discount")).otherwise(
                F.lit(float("inf"))).alias("l_discount"))), correlation=6)


# Groups that stand far apart, so that SQL can state which rows belong together.
@query("""select vec_id, cast(dense_rank() over (order by label) - 1 as integer) as cluster
from embeddings""")
def kmeans_embeddings(spark, sf_dir):
    vectors, names = _dimensions(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    groups = labels.select("label").distinct().count()
    codes = features.label_encode(labels.withColumn("label", F.format_string(
        "%010d", F.col("label"))) if dict(labels.dtypes)["label"] != "string" else labels)
    apart = vectors.join(codes.select("vec_id", "label_encoded"), "vec_id").withColumn(
        "d0", F.col("d0") + F.col("label_encoded") * 1000).drop("label_encoded")
    fit = clusters.kmeans(apart, groups, names)
    return fit.assign(apart).select("vec_id", "cluster")


MIXED = """select l_quantity, l_extendedprice, l_discount,
  2 * l_extendedprice + l_quantity * 1000 as mixed, l_quantity * (1 - l_discount) as net
  from lineitem"""
MIXED_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "mixed", "net"]


def _mixed(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_quantity", "l_extendedprice", "l_discount",
        "2 * l_extendedprice + l_quantity * 1000 as mixed",
        "l_quantity * (1 - l_discount) as net")


@query(f"with t as ({MIXED}), c as (" + _union(
    f"select '{a}' as var1, '{b}' as var2, corr({a}, {b}) as r from t"
    for a, b in combinations(MIXED_COLUMNS, 2)) + """)
select var1, var2, round(r, 6) as correlation,
       case when abs(r) > 0.7 then 'strong' else 'moderate' end as strength
from c where abs(r) >= 0.5""")
def strong_relationships(spark, sf_dir):
    return rounded(relations.strong_relationships(_mixed(spark, sf_dir)), correlation=6)


@query(f"with t as ({MIXED}) " + _union(
    f"select '{a}' as var1, '{b}' as var2, "
    + (f"case when min({a}) < max({a}) then 1.0::double end" if a == b
       else f"round(corr({a}, {b}), 2)") + " as correlation from t"
    for a in MIXED_COLUMNS for b in MIXED_COLUMNS))
def correlation_heatmap(spark, sf_dir):
    return relations.correlation_heatmap(_mixed(spark, sf_dir))


FIT = """with t as (select l_quantity as a, l_discount as b, l_extendedprice as y from lineitem),
m as (select var_pop(a) as aa, var_pop(b) as bb, var_pop(y) as yy, covar_pop(a, b) as ab,
             covar_pop(a, y) as ay, covar_pop(b, y) as yb, avg(a) as ma, avg(b) as mb, avg(y) as my
      from t),
k as (select *, (ay * bb - yb * ab) / (aa * bb - ab * ab) as c1,
             (yb * aa - ay * ab) / (aa * bb - ab * ab) as c2 from m)"""


def _fit(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    return lines, relations.linear_regression(lines)


@query(FIT + """
select 'l_quantity' as term, round(c1, 3) as value from k
union all select 'l_discount', round(c2, 3) from k
union all select '(intercept)', round(my - c1 * ma - c2 * mb, 3) from k
union all select '(r2)', round((c1 * ay + c2 * yb) / yy, 3) from k""")
def linear_regression(spark, sf_dir):
    lines, fit = _fit(spark, sf_dir)
    return rounded(fit.table(lines), value=3)


@query(FIT + """
select y as actual, round(my - c1 * ma - c2 * mb + a * c1 + b * c2, 3) as predicted from t, k""")
def regression_predictions(spark, sf_dir):
    lines, fit = _fit(spark, sf_dir)
    return rounded(fit.predict(lines), predicted=3)


def _bin_sql(x: str, lo: str, hi: str, bins: int) -> str:
    return (f"least(cast(floor((cast({x} as double) - {lo}) / ({hi} - {lo}) * {bins}) as int), "
            f"{bins - 1})")


MI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


def _mi_sql(feature: str, target: str) -> str:
    ends = "(select min({0}) as a, max({0}) as b from lineitem)"
    return f"""select '{feature}' as feature, round(sum(n / total * ln(n * total / (nx * ny))), 6) as mi
from (select *, sum(n) over (partition by x) as nx, sum(n) over (partition by y) as ny,
             sum(n) over () as total
  from (select {_bin_sql(feature, 'e.a', 'e.b', 10)} as x, {_bin_sql(target, 'f.a', 'f.b', 10)} as y,
               cast(count(*) as double) as n
    from lineitem, {ends.format(feature)} e, {ends.format(target)} f group by 1, 2))"""


@query(_union(_mi_sql(f, "l_tax") for f in MI_FEATURES))
def mutual_information(spark, sf_dir):
    return rounded(relations.mutual_information(
        table(spark, sf_dir, "lineitem"), columns=[*MI_FEATURES, "l_tax"]), mi=6)


@query("""select l_orderkey, l_linenumber, l_quantity + 1000 * (l_orderkey % 3) as place,
  l_discount * 100 as discount, cast(l_orderkey % 3 as integer) as cluster from lineitem""")
def kmeans_fixed(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_quantity + 1000 * (l_orderkey % 3) as place",
        "l_discount * 100 as discount")
    return clusters.kmeans(lines, 3, ["place", "discount"]).assign(lines)


def _silhouette_sql(points: str, power: str = "") -> str:
    """The mean silhouette of points (x, y) of groups c, from all pairs."""
    away = f"{power}((a.x - b.x) ** 2 + (a.y - b.y) ** 2)"
    return f"""with p as materialized (select row_number() over () as id, * from ({points})),
d as (select a.id, a.c, b.c as other, sum({away}) as total,
        count(*) as n from p a, p b group by a.id, a.c, b.c),
s as (select id, max(case when c = other and n > 1 then total / (n - 1) end) as a,
        min(case when c <> other then total / n end) as b from d group by id)
select avg(case when a is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end) as s
from s"""


GROUPED = """select p_size + 1000 * (p_partkey % 4) as x, p_retailprice / 100 as y,
  p_partkey % 4 as c from part"""


def _grouped(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_size + 1000 * (p_partkey % 4) as x", "p_retailprice / 100 as y",
        "cast(p_partkey % 4 as int) as c")


@query(f"""with q as ({_silhouette_sql(GROUPED)})
select cast(p_partkey % 4 as integer) as cluster, count(*) as n, round(any_value(s), 6) as silhouette
from part, q group by 1""")
def kmeans_auto(spark, sf_dir):
    part = _grouped(spark, sf_dir)
    fit = clusters.kmeans(part, columns=["x", "y"])
    return fit.assign(part).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "silhouette", F.round(F.lit(fit.silhouette), 6))


@query("select round(s, 6) as silhouette from (" + _silhouette_sql(
    "select p_size as x, p_retailprice / 100 as y, p_partkey % 3 as c from part", "sqrt") + ")")
def silhouette_euclidean(spark, sf_dir):
    part = table(spark, sf_dir, "part").selectExpr(
        "p_size", "p_retailprice / 100 as price", "p_partkey % 3 as c")
    value = clusters.silhouette(part, "c", ["p_size", "price"], metric="euclidean")
    return spark.createDataFrame([(value,)], "silhouette double").select(
        F.round("silhouette", 6).alias("silhouette"))


@query("""with p as (select l_quantity as x, l_discount * 100 as y, l_linenumber as c from lineitem),
g as (select c, count(*) as n, avg(x) as mx, avg(y) as my, avg(x * x + y * y) as mm from p group by c),
d as (select row_number() over () as id, x, y, c from p),
e as (select id, d.c = g.c as own, g.n,
        x * x + y * y - 2 * (x * mx + y * my) + mm as away from d, g),
s as (select id, max(case when own and n > 1 then away * n / (n - 1) end) as a,
        min(case when not own then away end) as b from e group by id)
select round(avg((b - a) / greatest(a, b)), 6) as silhouette from s""")
def silhouette(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_quantity", "l_discount * 100 as discount", "l_linenumber")
    value = clusters.silhouette(lines, "l_linenumber", ["l_quantity", "discount"])
    return spark.createDataFrame([(value,)], "silhouette double").select(
        F.round("silhouette", 6).alias("silhouette"))


@query("""with t as (select l_quantity as x, l_extendedprice / 1000 as y from lineitem),
m as (select var_samp(x) as a, var_samp(y) as d, covar_samp(x, y) as b from t),
e as (select *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) as v from m),
f as (select *, a + d - v as w, sqrt(b * b + (v - a) ** 2) as size from e)
select cast(1 as integer) as component, round(v / (a + d), 6) as explained_ratio,
       'l_quantity' as "column", round(b / size, 6) as loading from f
union all select 1, round(v / (a + d), 6), 'price', round((v - a) / size, 6) from f
union all select 2, round(w / (a + d), 6), 'l_quantity',
  round(case when abs(v - a) > abs(b) then (v - a) / size else -(v - a) / size end, 6) from f
union all select 2, round(w / (a + d), 6), 'price',
  round(case when abs(v - a) > abs(b) then -b / size else b / size end, 6) from f""")
def pca_2d(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_quantity", "l_extendedprice / 1000 as price")
    return rounded(clusters.pca(lines).table(lines), explained_ratio=6, loading=6)


@query(f"""with t as materialized ({GROUPED}),
m as (select var_samp(x) as a, var_samp(y) as d, covar_samp(x, y) as b, avg(x) as mx, avg(y) as my
  from t),
e as (select *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) as v from m),
f as (select *, sqrt(b * b + (v - a) ** 2) as size from e),
g as (select *, case when abs(v - a) > abs(b) then 1 else -1 end as turn,
        case when b < 0 and abs(b) > abs(v - a) then -1 else 1 end as flip from f),
p as materialized (select cast(c as integer) as cluster,
    flip * ((x - mx) * b + (y - my) * (v - a)) / size as pc1,
    turn * ((x - mx) * (v - a) - (y - my) * b) / size * (case when b < 0 and turn = -1 then -1 else 1 end)
      as pc2 from t, g),
ends as (select min(pc1) as a, max(pc1) as b, min(pc2) as c, max(pc2) as d from p)
select cluster, {_bin_sql('pc1', 'a', 'b', 50)} as bin_x, {_bin_sql('pc2', 'c', 'd', 50)} as bin_y,
  count(*) as n from p, ends group by 1, 2, 3""")
def cluster_projection(spark, sf_dir):
    part = _grouped(spark, sf_dir).select("x", "y")
    return clusters.cluster_projection(part, clusters.kmeans(part, 4))


DIGAMMA = ("(ln({0} + 8) - 0.5 / ({0} + 8) - 1 / (12 * ({0} + 8) ** 2) + 1 / (120 * ({0} + 8) ** 4) "
           "- 1 / (252 * ({0} + 8) ** 6) + 1 / (240 * ({0} + 8) ** 8)"
           + "".join(f" - 1 / ({{0}} + {i})" for i in range(8)) + ")")


def _neighbours_sql(feature: str, target: str, k: int = 3) -> str:
    """Information from the distances of all pairs of rows."""
    return f"""select '{feature}' as feature, round(greatest(
  {DIGAMMA.format('any_value(total)::double')} + {DIGAMMA.format(f'{k}::double')}
  - avg({DIGAMMA.format('nx::double')}) - avg({DIGAMMA.format('ny::double')}), 0), 6) as mi
from (select b.id, any_value(total) as total,
    count(*) filter (where dx <= r * (1 - 1e-10)) as nx,
    count(*) filter (where dy <= r * (1 - 1e-10)) as ny
  from (select a.id, b.id as other, abs(a.x - b.x) as dx, abs(a.y - b.y) as dy, a.total
        from {feature}_t a, {feature}_t b) b
  join (select id, r from (select a.id, greatest(abs(a.x - b.x), abs(a.y - b.y)) as r,
          row_number() over (partition by a.id order by greatest(abs(a.x - b.x), abs(a.y - b.y))) as place
        from {feature}_t a join {feature}_t b on a.id <> b.id) where place = {k}) k on k.id = b.id
  group by b.id)"""


NEAR_FEATURES = ["p_partkey", "p_size"]


@query("with " + ", ".join(
    f"{f}_t as materialized (select row_number() over () as id, count(*) over () as total, "
    f"{f} / stddev_pop({f}) over () as x, p_retailprice / stddev_pop(p_retailprice) over () as y "
    "from part)" for f in NEAR_FEATURES) + _union(
        [" " + _neighbours_sql(f, "p_retailprice") for f in NEAR_FEATURES]))
def mutual_information_neighbours(spark, sf_dir):
    return rounded(information.neighbour_information(
        table(spark, sf_dir, "part"), columns=[*NEAR_FEATURES, "p_retailprice"]), mi=6)


def _histogram_sql(c: str) -> str:
    return f"""select '{c}' as "column", cast(g.bin as integer) as bin,
  round(lo + (hi - lo) / 30 * g.bin, 4) as lower, round(lo + (hi - lo) / 30 * (g.bin + 1), 4) as upper,
  coalesce(n, 0) as n
from (select range as bin from range(30)) g
cross join (select cast(min({c}) as double) as lo, cast(max({c}) as double) as hi from orders) e
left join (select {_bin_sql(c, 'e2.lo', 'e2.hi', 30)} as bin, count(*) as n from orders,
  (select cast(min({c}) as double) as lo, cast(max({c}) as double) as hi from orders) e2
  group by 1) h on g.bin = h.bin"""


@query(_union(_histogram_sql(c) for c in ["o_orderkey", "o_custkey", "o_totalprice"]))
def histogram(spark, sf_dir):
    return rounded(plotdata.histogram(table(spark, sf_dir, "orders")), lower=4, upper=4)


@query(_union(f"select '{c}' as \"column\", {c} as value, count(*) as n from part group by {c}"
              for c in ["p_name", "p_brand", "p_type"]))
def count_plot_data(spark, sf_dir):
    return plotdata.count_plot(table(spark, sf_dir, "part"))


def _box_sql(source: str, value: str, keys: dict[str, str]) -> str:
    names = ", ".join(keys)
    chosen = ", ".join(f"{e} as {k}" for k, e in keys.items())
    return f"""select {names}, count(x) as n, round(any_value(q1), 4) as q1,
  round(any_value(q2), 4) as median, round(any_value(q3), 4) as q3,
  min(case when near then x end) as whisker_low, max(case when near then x end) as whisker_high,
  sum(cast(not near as int))::bigint as n_outliers
from (select *, x between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as near
  from (select *, quantile_cont(x, 0.25) over (partition by {names}) as q1,
          quantile_cont(x, 0.5) over (partition by {names}) as q2,
          quantile_cont(x, 0.75) over (partition by {names}) as q3
    from (select {chosen}, cast({value} as double) as x from {source})))
group by {names}"""


@query(_union(_box_sql("lineitem", c, {'"column"': f"'{c}'"}) for c in LINE_NUMBERS))
def boxplot_stats(spark, sf_dir):
    return rounded(plotdata.boxplot(table(spark, sf_dir, "lineitem")), q1=4, median=4, q3=4)


@query(_box_sql("lineitem", "l_extendedprice", {"category": "l_returnflag"}))
def boxplot_by_category(spark, sf_dir):
    return rounded(plotdata.boxplot_by_category(
        table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice"),
        q1=4, median=4, q3=4)


@query(_union(_box_sql("part", x, {"category_column": f"'{c}'", "category": c,
                                   "number_column": f"'{x}'"})
              for c in ["p_name", "p_brand"] for x in ["p_partkey", "p_size"]))
def boxplot_grid(spark, sf_dir):
    return rounded(plotdata.boxplot_grid(table(spark, sf_dir, "part")), q1=4, median=4, q3=4)


def _pair_sql(a: str, b: str) -> str:
    ends = "(select cast(min({0}) as double) as a, cast(max({0}) as double) as b from lineitem)"
    return (f"select '{a}' as x, '{b}' as y, {_bin_sql(a, 'e.a', 'e.b', 20)} as bin_x, "
            f"{_bin_sql(b, 'f.a', 'f.b', 20)} as bin_y, count(*) as n from lineitem, "
            f"{ends.format(a)} e, {ends.format(b)} f group by 3, 4")


@query(_union(_pair_sql(a, b) for a, b in combinations(LINE_NUMBERS[:5], 2)))
def scatter_matrix_bins(spark, sf_dir):
    return plotdata.scatter_matrix(table(spark, sf_dir, "lineitem"))


def _diagonal_sql(a: str) -> str:
    return (f"select '{a}' as x, '{a}' as y, {_bin_sql(a, 'e.a', 'e.b', 20)} as bin_x, "
            f"cast(null as int) as bin_y, count(*) as n from lineitem, (select cast(min({a}) as double) "
            f"as a, cast(max({a}) as double) as b from lineitem) e group by 3")


@query(_union([*[_pair_sql(a, b) for a, b in combinations(LINE_NUMBERS[:5], 2)],
               *[_diagonal_sql(a) for a in LINE_NUMBERS[:5]]]))
def pair_plot_bins(spark, sf_dir):
    return plotdata.pair_plot(table(spark, sf_dir, "lineitem"))


@query(f"""select l_returnflag as color, {_bin_sql('l_quantity', 'e.a', 'e.b', 50)} as bin_x,
  {_bin_sql('l_extendedprice', 'f.a', 'f.b', 50)} as bin_y, count(*) as n
from lineitem, (select min(l_quantity) as a, max(l_quantity) as b from lineitem) e,
  (select min(l_extendedprice) as a, max(l_extendedprice) as b from lineitem) f
group by 1, 2, 3""")
def scatter_data(spark, sf_dir):
    return plotdata.scatter(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice",
                            "l_returnflag")
