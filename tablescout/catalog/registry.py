"""Registered queries and the SQL each is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows."""
    def register(work: Query) -> Query:
        QUERIES[work.__name__] = work
        if sql is not None:
            ORACLES[work.__name__] = sql
        return work
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """Round columns, as the SQL does: sums of doubles depend on their order."""
    return df.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(f"`{c}`")
                       for c in df.columns])


# Defects that the given tables lack, by the same expressions in Spark and in SQL.
GAPPY_CUSTOMER = """
  select c_custkey, c_name, c_nationkey,
         case when c_custkey % 10 = 0 then null else c_acctbal end as c_acctbal,
         case when c_custkey % 7 = 0 then null else c_mktsegment end as c_mktsegment
  from customer"""
COPIED_ORDERS = """
  select * from orders union all select * from orders where o_orderkey % 50 = 0"""
SPIKED_ORDERS = """
  select o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
         case when o_orderkey % 500 = 0 then o_totalprice * 50 else o_totalprice end as o_totalprice
  from orders"""
LABELLED_DOCUMENTS = """
  select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  from documents d left join labels l on d.doc_id = l.doc_id"""
GAPPY_LINES = """
  select case when l_orderkey % 11 = 0 then null else l_quantity end as l_quantity,
         case when l_partkey % 13 = 0 then null else l_extendedprice end as l_extendedprice,
         l_discount, cast(1 as double) as one
  from lineitem"""


def gappy_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(c("c_custkey") % 10 != 0, c("c_acctbal")).alias("c_acctbal"),
        F.when(c("c_custkey") % 7 != 0, c("c_mktsegment")).alias("c_mktsegment"))


def copied_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.unionByName(orders.where("o_orderkey % 50 = 0"))


def spiked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.when(F.col("o_orderkey") % 500 == 0, F.col("o_totalprice") * 50)
        .otherwise(F.col("o_totalprice")).alias("o_totalprice"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars").join(
            table(spark, sf_dir, "labels"), "doc_id", "left")


def gappy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        F.when(c("l_orderkey") % 11 != 0, c("l_quantity")).alias("l_quantity"),
        F.when(c("l_partkey") % 13 != 0, c("l_extendedprice")).alias("l_extendedprice"),
        "l_discount", F.lit(1.0).alias("one"))
