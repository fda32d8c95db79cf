"""Building blocks that keep results exact when one key is very frequent.

Three things recur in the operators: cutting lineage, attaching a per-key value
to every row, and ordering a column's values over many tasks. Each is written
once here, so that no operator sends a hot key, or a whole column, to one task.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col

BROADCAST_BYTES = 32 << 20  # largest lookup table that is sent to every executor
ROW_BYTES = 32              # of a lookup table's row, beside its values
WINDOW_ROWS = 1_000_000     # largest ordered run that one task sorts
HOT_SHARE = 1_000           # a key with over 1/HOT_SHARE of the weight is hot
SALTS = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    A folder of our own is used only where none is set and the master is local.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix="tablescout-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut lineage, on storage that outlives an executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table_bytes(table: DataFrame, size: int | None = None) -> int:
    """Bytes of a settled table in memory; ``size`` is its number of rows, if known."""
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    text = (T.StringType, T.BinaryType)
    long = [f for f in table.schema.fields if not isinstance(f.dataType, fixed)]
    row_bytes = ROW_BYTES + 8 * len(table.columns)
    if not long:
        return row_bytes * (table.count() if size is None else size)
    n, values = table.agg(F.count(F.lit(1)), sum((F.coalesce(F.sum(F.octet_length(
        col(f.name) if isinstance(f.dataType, text) else F.to_json(F.struct(col(f.name))))),
        F.lit(0)) for f in long), F.lit(0))).first()
    return row_bytes * n + values


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str,
           size: int | None = None) -> DataFrame:
    """Left join rows with a settled table that has one row per key.

    ``weight`` is the number of rows that carry the key. A table of checked size
    (in bytes; it has ``size`` rows, counted if not given) is broadcast. Beyond that, keys that hold
    over 1/1000 of the weight (at most 1000 of them) are broadcast, and their rows,
    like rows without a key, are spread by a salt, so that the shuffle join of the
    rest has no hot key.
    """
    payload = [c for c in table.columns if c not in keys]
    if table_bytes(table, size) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), list(keys), "left")

    total = table.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    packed = F.struct(*[col(c) for c in payload])
    named = [col(k) for k in keys]
    hot = table.where(is_hot).select(*named, packed.alias("_hot"))
    cold = table.where(~is_hot).select(*named, F.lit(0).alias("_salt"), packed.alias("_cold"))

    hashable = [col(f.name) for f in rows.schema.fields
                if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    spread = (F.pmod(F.xxhash64(*hashable, F.spark_partition_id()), F.lit(SALTS)) + 1).cast("int")
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | col(k).isNull()
    marked = rows.join(F.broadcast(hot), list(keys), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull() | keyless, spread).otherwise(F.lit(0)))
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return (marked.join(cold, [*keys, "_salt"], "left")
            .withColumn("_found", found)
            .select(*[col(c) for c in rows.columns],
                    *[F.col("_found")[c].alias(c) for c in payload]))


def running_total(counts: DataFrame, keys: Sequence[str], value: str, amount: str) -> DataFrame:
    """Add ``before`` (amount held by smaller values of the key) and ``position``.

    ``counts`` has one row per ``(keys, value)``, and keys that are not null. Rows are dealt
    out by ranges of (keys, value), so a frequent key covers many partitions. Each partition's
    part of a key is ordered by itself and starts from the totals of the parts before it: the
    cost of a row does not depend on the number of parts.
    """
    keys = list(keys)
    parts = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    ranged = settle(counts.repartitionByRange(parts, *[col(k) for k in keys], col(value))
                    .withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = settle(
        ranged.groupBy(*keys, "_part")
        .agg(F.sum(amount).alias("_amount"), F.count(F.lit(1)).alias("_values"))
        .select(*keys, "_part", "_values",
                F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias("_before"),
                F.coalesce(F.sum("_values").over(earlier), F.lit(0)).alias("_position")))
    inside = Window.partitionBy(*keys, "_part").orderBy(value)
    return attach(ranged, starts, [*keys, "_part"], "_values").select(
        *counts.columns,
        (F.col("_before") + F.coalesce(F.sum(amount).over(
            inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"),
        (F.col("_position") + F.row_number().over(inside) - 1).cast("long").alias("position"))
