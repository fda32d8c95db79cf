"""Registered queries: sources, cleaning, outliers, features."""

from __future__ import annotations

import io
import os
import sys
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ..functions.scale import new_folder
from ..operators import cleaning, features, frequency, outliers
from ..sources import nested, tables, workbooks
from .registry import (COPIED_ORDERS, GAPPY_CUSTOMER, LABELLED_DOCUMENTS, SPIKED_ORDERS,
                       copied_orders, gappy_customer, labelled_documents, query, rounded,
                       spiked_orders, table)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CUSTOMER_ROWS = f"""with t as ({GAPPY_CUSTOMER})
select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment
from t"""


@query(CUSTOMER_ROWS)
def scan_csv(spark, sf_dir):
    path = new_folder(spark, "customer") + ".csv"
    gappy_customer(spark, sf_dir).write.csv(path, header=True, escape='"')
    return tables.load(spark, path)


@query("""select o_orderkey, o_totalprice as "amount.price", o_orderstatus as "amount.status"
from orders""")
def scan_json(spark, sf_dir):
    path = new_folder(spark, "orders-json")
    table(spark, sf_dir, "orders").select("o_orderkey", F.struct(
        F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
        .alias("amount")).write.json(path)
    return nested.scan_json(spark, path).rows


@query("""select cast(c_custkey as varchar) as "@id", c_name, c_mktsegment as "place.segment",
       cast(c_nationkey as varchar) as "place.nation" from customer""")
def scan_xml(spark, sf_dir):
    path = new_folder(spark, "customers-xml")
    table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("@id"), "c_name", F.struct(
            F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
        .alias("place")).write.xml(path, rowTag="customer", attributePrefix="@")
    return nested.scan_xml(spark, path, "customer").rows


def _workbook(rows: pd.DataFrame) -> bytes:
    """A minimal workbook: one sheet, text written in place."""
    lines = [list(rows.columns), *rows.itertuples(index=False, name=None)]

    def cell(v) -> str:
        if v is None or v != v:
            return "<c/>"
        if isinstance(v, str):
            return f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        return f"<c><v>{v}</v></c>"

    sheet = "".join("<row>" + "".join(cell(v) for v in line) + "</row>" for line in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(workbooks.SHEET, f'<worksheet xmlns="{workbooks.MAIN[1:-1]}"><sheetData>'
                                       f"{sheet}</sheetData></worksheet>")
    return out.getvalue()


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    body = rows.drop(columns=["block"])
    return pd.DataFrame({"path": [f"customers-{key[0]:05d}"], "content": [_workbook(body)]})


@query(CUSTOMER_ROWS)
def scan_workbooks(spark, sf_dir):
    # One workbook per 500 customer keys, written as files whose names tell nothing.
    folder = new_folder(spark, "customer-books")
    local = folder.removeprefix("file:")

    def write(batches):
        os.makedirs(local, exist_ok=True)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with open(f"{local}/{path}", "wb") as file:
                    file.write(content)
            yield batch[["path"]]

    rows = gappy_customer(spark, sf_dir).withColumn("block", F.floor(F.col("c_custkey") / 500))
    books = rows.groupBy("block").applyInPandas(_pack, "path string, content binary")
    books.mapInPandas(write, "path string").count()
    return tables.load(spark, folder)


@query("""select event_id, cast(regexp_extract(props, '"k": (-?[0-9]+)', 1) as bigint) as k
from events""")
def normalize_json(spark, sf_dir):
    return nested.normalize_json(table(spark, sf_dir, "events"), "props", ["event_id"]).rows


@query("""select o_orderkey, o_orderkey as "order.key", o_totalprice as "order.price",
       case when o_orderkey % 3 = 0 then null else o_orderstatus end as "order.state.code",
       cast(n as bigint) as "order.line"
from orders, (values (1), (2)) v(n)
where n = 1 or o_orderkey % 2 = 0""")
def normalize_json_nested(spark, sf_dir):
    # Even orders are an array of two objects, odd ones a single object.
    def entry(n: int):
        return F.struct(F.struct(
            F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"),
            F.lit(n).alias("line"), F.struct(F.when(
                F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("code")).alias("state")
        ).alias("order"))

    text = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.array(entry(1), entry(2)))).otherwise(
        F.to_json(entry(1)))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return nested.normalize_json(orders, "text", ["o_orderkey"]).rows


XML_CUSTOMERS = """select c_custkey, cast(c_custkey as varchar) as "customer.c_custkey",
       c_name as "customer.c_name", cast(c_acctbal as varchar) as "customer.c_acctbal",
       c_mktsegment as "customer.place.segment", cast(c_nationkey as varchar) as "customer.place.nation"
from customer"""


def _customer_struct():
    return F.struct("c_custkey", "c_name", "c_acctbal", F.struct(
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("place"))


@query(XML_CUSTOMERS)
def normalize_xml(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    text = customer.select("c_custkey", F.to_xml(
        _customer_struct(), {"rowTag": "customer"}).alias("text"))
    return nested.normalize_xml(text, "text", ["c_custkey"]).rows


@query("""select c_custkey, case when c_custkey % 2 = 0 then c_custkey end as id,
       case when c_custkey % 2 = 0 then c_mktsegment end as "place.segment",
       case when c_custkey % 2 = 1 then cast(c_custkey as varchar) end as "customer.id",
       case when c_custkey % 2 = 1 then c_mktsegment end as "customer.place.segment"
from customer where c_custkey % 5 <> 0""")
def auto_detect(spark, sf_dir):
    # Even keys as JSON, odd ones as XML, each fifth as text that is neither.
    c = F.col("c_custkey")
    row = F.struct(c.alias("id"), F.struct(F.col("c_mktsegment").alias("segment")).alias("place"))
    text = (F.when(c % 5 == 0, F.concat(F.lit("customer "), F.col("c_name")))
            .when(c % 2 == 0, F.to_json(row)).otherwise(F.to_xml(row, {"rowTag": "customer"})))
    customer = table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))
    return nested.auto_normalize(customer, "text", ["c_custkey"]).rows


@query("""select c_custkey, c_name from customer where c_custkey % 5 = 0 or c_custkey % 3 = 0""")
def reject_broken_text(spark, sf_dir):
    c = F.col("c_custkey")
    good = F.to_json(F.struct(c.alias("id")))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(
        c % 5 == 0, F.concat(F.lit("{ broken "), F.col("c_name"))).when(
            c % 3 == 0, F.concat(F.lit("<open>"), F.col("c_name"))).otherwise(good).alias("text"))
    return nested.auto_normalize(customer, "text", ["c_custkey", "c_name"]).rejects.drop("text")


@query("""select o.o_orderkey, o.o_totalprice as "amount.price", c.c_name as "customer.name",
       cast(c.c_nationkey as integer) as "customer.home.nation"
from orders o join customer c on o.o_custkey = c.c_custkey""")
def flatten_nested(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return nested.flatten(joined.select(
        "o_orderkey", F.struct(F.col("o_totalprice").alias("price")).alias("amount"),
        F.struct(F.col("c_name").alias("name"),
                 F.struct(F.col("c_nationkey").alias("nation")).alias("home")).alias("customer")))


@query("""select 'priority' as result, o_orderpriority as value, count(*) as n
from orders group by o_orderpriority
union all
select 'segment', c_mktsegment, count(*) from customer group by c_mktsegment""")
def export_results(spark, sf_dir):
    path = new_folder(spark, "results")
    tables.export_results({
        "priority": frequency.value_counts(table(spark, sf_dir, "orders"), ["o_orderpriority"]),
        "segment": frequency.value_counts(table(spark, sf_dir, "customer"), ["c_mktsegment"]),
    }, path)
    back = tables.read_results(spark, path)
    return back.select("result", F.from_json("row", "value string, n long").alias("r")).select(
        "result", "r.value", "r.n")


@query(f"with t as ({LABELLED_DOCUMENTS}) select doc_id, lang, source, n_chars from t")
def drop_sparse_columns(spark, sf_dir):
    return cleaning.drop_sparse_columns(labelled_documents(spark, sf_dir))


@query(f"with t as ({GAPPY_CUSTOMER}) select * from t where c_acctbal is not null")
def dropna_rows(spark, sf_dir):
    return cleaning.dropna_rows(gappy_customer(spark, sf_dir))


@query(f"select distinct * from ({COPIED_ORDERS})")
def drop_duplicates(spark, sf_dir):
    return cleaning.drop_duplicates(copied_orders(spark, sf_dir))


def _impute_sql(fill: str) -> str:
    return f"""with t as ({GAPPY_CUSTOMER}),
m as (select {fill} as v from t),
s as (select c_mktsegment as v from t where c_mktsegment is not null
      group by c_mktsegment order by count(*) desc, c_mktsegment limit 1)
select c_custkey, c_name, c_nationkey, round(coalesce(c_acctbal, m.v), 4) as c_acctbal,
       coalesce(c_mktsegment, s.v) as c_mktsegment from t, m, s"""


@query(_impute_sql("avg(c_acctbal)"))
def impute_mean(spark, sf_dir):
    return rounded(cleaning.impute(gappy_customer(spark, sf_dir), "mean"), c_acctbal=4)


@query(_impute_sql("median(c_acctbal)"))
def impute_median(spark, sf_dir):
    return rounded(cleaning.impute(gappy_customer(spark, sf_dir), "median"), c_acctbal=4)


@query(f"""with t as (select *, case when doc_id % 4 = 0 then null else n_chars end as length,
  case when doc_id % 6 = 0 then null else lang end as tongue from ({LABELLED_DOCUMENTS})),
m as (select median(cast(length as double)) as v from t),
s as (select tongue as v from t where tongue is not null
      group by tongue order by count(*) desc, tongue limit 1)
select doc_id, lang, source, n_chars, coalesce(cast(length as double), m.v) as length,
       coalesce(tongue, s.v) as tongue from t, m, s""")
def impute_smart(spark, sf_dir):
    # quality and toxic are missing in over half of the rows, and are dropped.
    gappy = labelled_documents(spark, sf_dir).withColumns({
        "length": F.when(F.col("doc_id") % 4 != 0, F.col("n_chars")),
        "tongue": F.when(F.col("doc_id") % 6 != 0, F.col("lang"))})
    return cleaning.impute(gappy)


SPIKED_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]


def _outlier_sql(test: str, stats: str, c: str) -> str:
    return f"""select '{c}' as "column", coalesce(sum(cast({test} as int)), 0)::bigint as n_outliers,
  round(coalesce(sum(cast({test} as int)), 0) / cast(count(*) as double) * 100, 6) as pct_outliers
  from (select cast({c} as double) as x from t) a, (select {stats} from t) b"""


@query(f"with t as ({SPIKED_ORDERS}) " + "\nunion all\n".join(
    _outlier_sql("abs((x - m) / s) > 3", f"avg({c}) as m, stddev_samp({c}) as s", c)
    for c in SPIKED_NUMBERS))
def outliers_zscore(spark, sf_dir):
    return rounded(outliers.outliers(spiked_orders(spark, sf_dir)), pct_outliers=6)


@query(f"with t as ({SPIKED_ORDERS}) " + "\nunion all\n".join(
    _outlier_sql("x < a1 - 1.5 * (a3 - a1) or x > a3 + 1.5 * (a3 - a1)",
                 f"quantile_cont(cast({c} as double), 0.25) as a1, "
                 f"quantile_cont(cast({c} as double), 0.75) as a3", c) for c in SPIKED_NUMBERS))
def outliers_iqr(spark, sf_dir):
    return rounded(outliers.outliers(spiked_orders(spark, sf_dir), "iqr"), pct_outliers=6)


@query(f"""with t as ({SPIKED_ORDERS}),
s as (select avg(o_totalprice) as m, stddev_samp(o_totalprice) as s from t),
o as (select o_totalprice as value, row_number() over (order by o_orderkey) as position
      from t, s where abs((o_totalprice - m) / s) > 3)
select 'o_totalprice' as "column", cast(position as integer) as position, value
from o where position <= 10""")
def outlier_values(spark, sf_dir):
    return outliers.outlier_values(spiked_orders(spark, sf_dir), order_by="o_orderkey")


@query("""select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice,
  cast(dense_rank() over (order by p_name) - 1 as double) as p_name_encoded,
  cast(dense_rank() over (order by p_brand) - 1 as double) as p_brand_encoded,
  cast(dense_rank() over (order by p_type) - 1 as double) as p_type_encoded from part""")
def label_encode(spark, sf_dir):
    return features.label_encode(table(spark, sf_dir, "part"))


@query(f"""with t as ({GAPPY_CUSTOMER})
select c_custkey, c_mktsegment, case when c_mktsegment is not null then cast(dense_rank() over (
  order by c_mktsegment nulls last) - 1 as double) end as c_mktsegment_encoded from t""")
def label_encode_missing(spark, sf_dir):
    return features.label_encode(
        gappy_customer(spark, sf_dir).select("c_custkey", "c_mktsegment"))


@query("select o_orderkey, " + ", ".join(
    f"o_orderstatus = '{v}' as \"o_orderstatus_{v}\"" for v in ["F", "O", "P"]) + " from orders")
def onehot_encode(spark, sf_dir):
    return features.onehot_encode(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))


@query(f"with t as ({GAPPY_CUSTOMER}), s as (select " + ", ".join(
    f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}"
    for c in ["c_custkey", "c_nationkey", "c_acctbal"]) + " from t) select " + ", ".join(
        f"round((cast({c} as double) - m_{c}) / s_{c}, 6) as {c}"
        for c in ["c_custkey", "c_nationkey", "c_acctbal"])
       + ", c_name, c_mktsegment from t, s")
def standardize(spark, sf_dir):
    return rounded(features.standardize(gappy_customer(spark, sf_dir)),
                   c_custkey=6, c_nationkey=6, c_acctbal=6)


@query("""with t as (select p_partkey, dense_rank() over (order by p_name) - 1 as name,
    dense_rank() over (order by p_type) - 1 as type from part),
n as (select count(distinct p_name) as names, count(distinct p_name) + count(distinct p_type) as size
      from part)
select p_partkey, cast(size as integer) as size, cast(name as integer) as place, 1.0::double as value
from t, n union all select p_partkey, size::integer, (names + type)::integer, 1.0 from t, n""")
def onehot_sparse(spark, sf_dir):
    rows, _ = features.onehot_sparse(table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_type"))
    return rows.select("p_partkey", "onehot.size", F.explode(
        F.arrays_zip("onehot.indices", "onehot.values")).alias("p")).select(
            "p_partkey", "size", F.col("p.indices").alias("place"),
            F.col("p.values").alias("value"))
