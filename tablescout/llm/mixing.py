"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of the mix in words. A target of r times the source takes
every document for floor(r) complete epochs. What is left is drawn without replacement:
each document gets the key -ln(u) / quality, u uniform by a hash of its id and text, and documents
are taken by ascending key until the words left are used up. The last one is cut there.

Per-source figures are one aggregate. Keys are ordered over all partitions
(``running_total``), so a source with a third of all documents fills no task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import running_total
from .text import lookup, settle

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0              # a target is at most this many times its source


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """0.05 to 1: the share of a text that is lower-case letters and spaces."""
    plain = F.length(F.regexp_replace(text, "[^\\p{Ll} ]+", "")) / F.greatest(
        F.length(text), F.lit(1))
    return F.coalesce(F.greatest(plain, F.lit(0.05)), F.lit(0.05))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(_none, _source, source_size, target) from (_none, _source, source_size).

    Sources by code point, the null source last, get the weights in turn. They share the sum
    of all sizes by weight; a target above ``most`` times its source stops there and the
    excess is shared again among the others, until none is above.
    """
    ranked = running_total(sizes.withColumn("_name", F.struct("_none", "_source")), [],
                           "_name", "source_size")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = settle(ranked.select(
        "_none", "_source", "source_size", (F.lit(most) * F.col("source_size")).alias("_stop"),
        F.get(cycle, F.pmod("position", F.lit(len(weights))).cast("int")).alias("_weight")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        over = F.col("_weight") * F.lit(level) > F.col("_stop")
        stopped, weight = ranked.agg(
            F.sum(F.when(over, F.col("_stop")).otherwise(0.0)),
            F.sum(F.when(over, 0.0).otherwise(F.col("_weight")))).first()
        new = (total - stopped) / weight if weight else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return ranked.select("_none", "_source", "source_size", F.least(
        F.col("_weight") * F.lit(level), F.col("_stop")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST,
        seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs``.

    ``docs`` has ``doc_id``, ``text`` and ``source``; other columns are ignored. ``taken`` is
    the words that the mix takes of the row, repeats counted; the sum over a source is its
    target, rounded. Null texts have size 0 and nothing to take. The null source is a source.
    Rows of equal id and text are drawn side by side, each for itself; all other ties are
    broken by what the rows hold, so reruns agree whatever the files. No rows, no rows.
    """
    u = (F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(
        float(1 << 52))
    rows = settle(docs.select(
        "doc_id", F.col("source").isNull().alias("_none"),
        F.coalesce(F.col("source"), F.lit("")).alias("_source"),
        word_count(F.col("text")).alias("size"),
        (-F.log(u) / text_quality(F.col("text"))).alias("_key"),
        F.xxhash64("text", F.lit(seed + 1)).alias("_mark")))
    plan = settle(targets(settle(rows.groupBy("_none", "_source").agg(
        F.sum("size").alias("source_size"))), weights, most))
    ordered = running_total(
        rows.withColumn("_order", F.struct(
            "_key", "doc_id", "_mark", F.monotonically_increasing_id())),
        ["_none", "_source"], "_order", "size")
    placed = lookup(ordered, plan, ["_none", "_source"], 100, "inner")
    epochs = F.when(F.col("source_size") > 0,
                    F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.round("target").cast("long") - epochs * F.col("source_size")
    part = F.least(F.greatest(left - F.col("before"), F.lit(0)), F.col("size"))
    return placed.select(
        "doc_id", F.when(~F.col("_none"), F.col("_source")).alias("source"), "size",
        "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))
