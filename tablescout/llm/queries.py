"""The registered queries of the operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, cotrain, decontaminate, htmltext, langid, licenses, minhash, mixing, pii,
               pq, search, suffixes, suffixtree)
from .text import crc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(work: Callable[[SparkSession, str], DataFrame]):
    QUERIES[work.__name__] = work
    return work


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int) -> F.Column:
    """crc32(doc_id) mod ``modulus`` is 2; a row without doc_id is not held out."""
    return F.coalesce(crc(F.col("doc_id"), modulus) == 2, F.lit(False))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out(4)).select("text", "lang"))
    return langid.identify(docs.select("doc_id", held_out(4).alias("held_out"), "text"),
                           model).drop("text")


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return cut.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).drop("text")


@query
def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).drop("text", "spans")


@query
def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(table(spark, sf_dir, "documents"), held_out(7))


@query
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages, htmltext.fit(pages)).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cotrain.fit(docs, table(spark, sf_dir, "labels"))
    return cotrain.score(docs, model).select(
        "doc_id", "text_score", "meta_score", "score", (F.col("score") >= 0.5).alias("kept"))


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


@query
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_ranked_search"] = """
    WITH terms AS (
        SELECT doc_id, number, term, count(*) AS tf
        FROM (SELECT doc_id, number, unnest(regexp_extract_all(
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
              FROM (SELECT doc_id, text, row_number() OVER () AS number FROM documents))
        GROUP BY doc_id, number, term),
    asked AS (
        SELECT item_id, number, term, count(*) AS times
        FROM (SELECT item_id, number, unnest(regexp_extract_all(
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
              FROM (SELECT item_id, text, row_number() OVER () AS number FROM benchmark))
        GROUP BY item_id, number, term),
    lengths AS (SELECT number, sum(tf) AS n FROM terms GROUP BY number),
    corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM lengths),
    weights AS (
        SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
        FROM terms, corpus GROUP BY term),
    scored AS (
        SELECT a.item_id, a.number AS item, t.doc_id, t.number,
               sum(a.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (
                   75 + ((25 * n::BIGINT * docs) // len)))))::BIGINT AS score
        FROM asked a JOIN terms t USING (term) JOIN weights w USING (term)
             JOIN lengths l ON l.number = t.number, corpus
        GROUP BY a.item_id, a.number, t.doc_id, t.number)
    SELECT item_id, "rank", doc_id, score
    FROM (SELECT item_id, doc_id, score, row_number() OVER (
              PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS "rank"
          FROM scored WHERE score > 0)
    WHERE "rank" <= 20
"""
