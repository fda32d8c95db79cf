"""From raw documents to a training mix, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm import decontaminate, langid, minhash, mixing, suffixes
from tablescout.llm.text import fewer, lookup, written

# No SQL states a fitted classifier or hash-keyed sampling; tests hold the stages against
# brute force.
ORACLE_SQL = None


def _aside(docs: DataFrame, *used: str) -> DataFrame:
    """``docs``, whose columns but the ``used`` ones have names that no operator uses."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in used else f"_column_{k}")
                         for k, c in enumerate(docs.columns)])


def _columns(rows: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` again, under their own names."""
    return rows.select(*[F.col(f"`{c}`" if c in used else f"_column_{k}").alias(c)
                         for k, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that was learnt from the labelled ones among them.

    Rejected: texts without a letter (or null), and those that resemble no learnt language. A
    language with little labelled text rejects none that is taken for it. A missing label is
    filled in with the language found. Equal texts share their fate; other columns are passed
    on, whatever their names. No rows, no rows.
    """
    model = langid.fit(docs.select("text", "lang"))
    found = langid.identify(_aside(docs, "text", "lang"), model, "_like").where("_like")
    return _columns(found.withColumn("lang", F.coalesce("lang", "lang_pred")), docs,
                    "text", "lang")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of smallest id.

    Rows are told apart by a tag written with them, so that one stays among rows of one id or
    of none too; rows with an id go before those without, and rows of one id by a hash of the
    whole row. A null or blank text is in no group and stays. Other columns are passed on,
    whatever their names. No rows, no rows.
    """
    own = _aside(docs, "doc_id", "text")
    rows = written(own.withColumn("_row", F.monotonically_increasing_id()), "tagged")
    named = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id",
                     F.xxhash64(*own.columns).alias("hash"),
                     F.col("_row").alias("row"))
    gone = (minhash.near_duplicates(rows.select(named.alias("doc_id"), "text"))
            .where(~F.col("kept")).select(F.col("doc_id.row").alias("_row")))
    gone = written(fewer(gone, rows.count()), "near-copies")
    return _columns(lookup(rows, gone, ["_row"], 16, "left_anti"), docs, "doc_id", "text")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that repeat across or within documents.

    A cut inside a character removes the rest of the character too (and U+FFFD, which such
    rests become). Null stays null. Repeated rows are repeats of each other. Other columns are
    passed on, whatever their names, but ``n_chars`` follows the text. No rows, no rows.
    """
    cut = suffixes.remove_repeats(_aside(docs, "text", "n_chars"))
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(
        F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", ""))
    cut = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.length("text").cast(kind))
    return _columns(cut, docs, "text", "n_chars")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no question of the benchmark, re-parameterised or not.

    Null and empty texts hold none and stay; repeated rows and equal texts share their fate. An
    empty benchmark removes nothing. Other columns are passed on, whatever their names. No rows,
    no rows.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontaminate.contaminated(_aside(docs, "text"), benchmark)
    return _columns(judged.where(~F.col("contaminated")), docs, "text")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each row the mix takes, as ``mixing.mix`` states: null texts have none,
    the null source is a source, ties are broken by what rows hold, other columns are dropped.
    No rows, no rows.
    """
    return mixing.mix(docs)


STAGES = [("language ID", language), ("MinHash near-dedup", one_of_each),
          ("suffix-array dedup", without_repeats), ("benchmark decontamination", decontaminated),
          ("mixing sources to target weights", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k + 1}")
    return docs
