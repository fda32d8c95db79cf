"""Words of many texts at once: NumPy over the UTF-8 bytes of Arrow batches.

Texts are handled in chunks of about ``CHUNK`` bytes, so that the arrays beside them
stay small whatever the batch holds; a longer text is a chunk of its own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scale
from ..functions.scale import new_folder

CHUNK = 1 << 20
BROADCAST_BYTES = 8 << 20       # a lookup table of more is joined by shuffle
FILE_ROWS = 50_000              # of a table in the shared folder that one file holds

BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"),)

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], row_bytes: int,
           how: str = "left") -> DataFrame:
    """Join with a settled table of one row per key.

    The table is broadcast if its counted rows fit ``BROADCAST_BYTES``. Beyond that it is
    a shuffled sort-merge join of two exchanges, whose hot keys Spark splits.
    """
    if table.count() * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), keys, how)
    return rows.join(table.hint("merge"), keys, how)


def merged(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by shuffle on both sides: the driver holds nothing of it, however many there are."""
    return rows.join(table.hint("merge"), keys, how)


def settle(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Compute once and cut lineage, in files of about ``FILE_ROWS`` rows.

    For narrow rows. ``rows`` is how many the last stage reads at most. If not known, all tasks
    leave their rows on their own disks, and when they are counted, only as many tasks as needed
    write files. A small table of many tasks is one file, as each costs the shared folder a name
    and the executor, on a local file system, several commands.
    """
    if rows is not None:
        return scale.settle(fewer(df, rows))
    own = df.persist(StorageLevel.DISK_ONLY)
    kept = scale.settle(fewer(own, own.count()))
    own.unpersist()
    return kept


def fewer(df: DataFrame, rows: int, file_rows: int = FILE_ROWS) -> DataFrame:
    """``df`` in no more partitions than its last stage's ``rows`` fill."""
    return df.coalesce(max(-(-rows // file_rows), 1))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, compressed."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session now hands Python batches of few rows and bytes.

    Ten thousand documents at once, Spark's default, take hundreds of megabytes on either
    side; a limit that the user has set stays.
    """
    conf = df.sparkSession.conf
    for key, usual, ours in BATCHES:
        if conf.get(key, usual) == usual:
            conf.set(key, ours)
    return df


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable], schema: str,
              ) -> DataFrame:
    return bounded(df).mapInArrow(work, schema)


def crc(column: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(column.cast("string")), F.lit(modulus))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes half of the output's."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(n, CHUNK).bit_length()
    up, down = _powers(size)
    return up[:n], down[:n]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets within them) of consecutive texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(
        column.type) else np.int32
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset:column.offset + n + 1].astype(np.int64)
    data = (np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None
            else np.zeros(0, np.uint8))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        own = offsets[at:end + 1]
        yield at, end, data[own[0]:own[-1]], own - own[0]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE,
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of bytes that are no separators."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~separators[data]
    edges = offsets[:-1][np.diff(offsets) > 0]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums whose differences hash any stretch of the bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=sums[1:])
    return sums


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    down = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * down[starts]
               + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased."""
    return stretch_hashes(prefix_hashes(_LOWER[data]), starts, ends)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words; a text of fewer words has one of all of them.

    ``counts`` holds the words of each text; returned are the hashes and their text numbers.
    """
    n = len(hashes)
    number = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)       # words from here to the end
    first = np.concatenate([[True], number[1:] != number[:-1]]) if n else np.zeros(0, bool)
    whole = (left >= width) | first
    out = np.zeros(n, np.uint64)
    for k in range(width):
        seed = np.uint64((2 * k + 1) * 0xA24BAED4963EE407 % (1 << 64))
        if k < n:
            part = hashes[k:] * seed
            part[left[:n - k] <= k] = 0
            out[:n - k] += mix(part)
    return mix(out)[whole], number[whole]
