"""Near-duplicate documents by b-bit MinHash.

1. One pass sketches every text: ``HASHES`` minima over its distinct shingles, ``BITS``
   low bits of each packed into a signature, and ``BANDS`` keys of ``ROWS`` whole minima.
2. Documents of equal shingle sets are one node (found by a 128-bit digest of the set).
3. Nodes that share a band key are candidates. First each is held only against the
   smallest node of its bucket. Links found join most of a group of copies, and buckets
   of one component are done. In the rest, nodes are compared across components, block
   by block, so that no task holds a bucket, and no rows are made of pairs that don't link.
4. Signatures are compared by counting bits, corrected for chance collisions; pairs
   below the threshold by more than ``SLACK`` standard errors are let go.
5. The others are confirmed on full shingle sets.

A pair at exactly 0.75 shares none of 32 bands of 4 with probability 5e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, composed, relabelled
from .text import (chunks, fewer, map_arrow, merged, mix, settle, shingles, word_hashes, words,
                   written)

WIDTH, PERCENT = 5, 75
HASHES, BANDS, BITS = 128, 32, 4
ROWS = HASHES // BANDS
SLACK = 4.5
BLOCK = 128         # partners of a node that one unit of work holds
SPAN = 1024         # nodes of a block that is compared with others
FILE_NODES = 10_000     # sketched nodes in one file
FILE_SETS = 2_000       # full sets in one file

_MULTIPLIERS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_SKETCH = "n_shingles long, node binary, bands array<long>, signature array<long>"


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, last, data, offsets in chunks(column):
        starts, ends, number = words(data, offsets)
        counts = np.bincount(number, minlength=last - first)
        hashes, of = shingles(word_hashes(data, starts, ends), counts, width)
        at = np.searchsorted(of, np.arange(last - first + 1))
        for i in range(last - first):
            yield np.unique(hashes[at[i]:at[i + 1]])


def _digest(items: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    a, b = mix(items + np.uint64(0x51ED270B)), mix(items ^ np.uint64(0x9FB21C651E98DF25))
    size = np.uint64(len(items))
    return np.array([a.sum() + size, b.sum() ^ size], np.uint64).tobytes()


def _minima(items: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 2048):
        np.minimum(least, np.multiply.outer(_MULTIPLIERS, items[at:at + 2048]).min(axis=1),
                   out=least)
    return least


def _packed(least: np.ndarray) -> list[int]:
    low = (mix(least) & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(low << shifts, axis=1).view(np.int64).tolist()


def _sketcher(width: int):
    seeds = mix(np.arange(7, 7 + BANDS, dtype=np.uint64))

    def sketch(batches):
        for batch in batches:
            rows = []
            for items in _sets(batch.column("text"), width):
                if not len(items):
                    rows.append((0, None, None, None))
                    continue
                least = _minima(items)
                keys = seeds.copy()
                for k in range(ROWS):
                    keys = mix(keys ^ least.reshape(BANDS, ROWS)[:, k])
                rows.append((len(items), _digest(items), keys.view(np.int64).tolist(),
                             _packed(least)))
            columns = list(zip(*rows)) if rows else [[]] * 4
            types = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["doc_id", "n_shingles", "node", "bands", "signature"])
    return sketch


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, node, bands, signature) of every row; an empty set has no node."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), _sketcher(width), f"doc_id {kind}, {_SKETCH}")


def _least_match(percent: int) -> float:
    """Share of equal b-bit values below which a pair is surely under the threshold."""
    chance = 1 / (1 << BITS)
    expected = chance + (1 - chance) * percent / 100
    return expected - SLACK * math.sqrt(expected * (1 - expected) / HASHES)


def estimate(a: str, b: str) -> F.Column:
    """Collision-corrected similarity of two signatures, by counting bits."""
    def differing(x):
        folded = x
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        lanes = int("1".rjust(BITS, "0") * (64 // BITS), 2)
        return F.bit_count(folded.bitwiseAND(F.lit(lanes)))

    words_each = HASHES * BITS // 64
    different = sum(differing(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(words_each))
    chance = 1 / (1 << BITS)
    return ((1 - different / F.lit(HASHES)) - chance) / (1 - chance)


def _candidates(unit: pd.DataFrame, left: int, right: int, percent: int):
    """Pairs (row, row) of two blocks, of different roots, whose signatures are near."""
    least_match = _least_match(percent)
    lanes = np.uint64(int("1".rjust(BITS, "0") * (64 // BITS), 2))
    block = unit["block"].to_numpy()
    one, two = np.flatnonzero(block == left), np.flatnonzero(block == right)
    signatures = np.array(unit["signature"].tolist(), np.int64).view(np.uint64)
    sizes = unit["n_shingles"].to_numpy()
    roots = pd.factorize(unit["root"])[0]
    for i in one:
        others = two[two > i] if left == right else two
        others = others[roots[others] != roots[i]]
        others = others[100 * np.minimum(sizes[i], sizes[others])
                        >= percent * np.maximum(sizes[i], sizes[others])]
        if not len(others):
            continue
        x = signatures[i] ^ signatures[others]
        folded = x.copy()
        for k in range(1, BITS):
            folded |= x >> np.uint64(k)
        match = 1 - np.bitwise_count(folded & lanes).sum(axis=1) / HASHES
        for j in others[match >= least_match]:
            yield i, j


def _units(rows: pd.DataFrame):
    for (left, right), unit in rows.groupby(["left", "right"], sort=False):
        yield left, right, unit.reset_index(drop=True)


def _survivors(percent: int):
    """(left, right, node) of the nodes of each unit that are in a candidate pair."""
    def find(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for left, right, unit in _units(rows):
            near = sorted({k for pair in _candidates(unit, left, right, percent) for k in pair})
            out.extend((left, right, unit["node"][k]) for k in near)
        return pd.DataFrame(out, columns=["left", "right", "node"])
    return find


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _joiner(percent: int):
    """Links between components of a unit, on full sets; none between what they have joined."""
    def join(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for left, right, unit in _units(rows):
            items = [np.array(x, np.int64) for x in unit["items"]]
            parent: dict = {}

            def top(x, parent=parent):
                while x in parent:
                    x = parent[x]
                return x

            for i, j in _candidates(unit, left, right, percent):
                a, b = top(unit["root"][i]), top(unit["root"][j])
                if a != b and _linked(items[i], items[j], percent):
                    parent[a] = b
                    out.append((unit["node"][i], unit["node"][j]))
        return pd.DataFrame(out, columns=["u", "v"])
    return join


def _checker(percent: int):
    def check(key, rows: pd.DataFrame) -> pd.DataFrame:
        hub = rows[rows["role"] == 0]
        u, base = hub["node"].iloc[0], np.array(hub["items"].iloc[0], np.int64)
        linked = [node for node, items in zip(rows["node"][rows["role"] == 1],
                                              rows["items"][rows["role"] == 1])
                  if _linked(base, np.array(items, np.int64), percent)]
        return pd.DataFrame({"u": [u] * len(linked), "v": linked})
    return check


def _set_maker(width: int):
    def make(batches):
        for batch in batches:
            sets = list(_sets(batch.column("text"), width))
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(s) for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["node", "items"])
    return make


def _full_sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, items) of the ``wanted`` nodes, made again from one text each."""
    needed = settle(merged(wanted.distinct(), reps.select("node", "doc_id"), ["node"]))
    texts = merged(docs.select("doc_id", "text").where("doc_id is not null"),
                   needed.select("doc_id").distinct(), ["doc_id"], "left_semi")
    if not needed.where("doc_id is null").isEmpty():
        texts = texts.unionByName(docs.select("doc_id", "text").where("doc_id is null"))
    sets = map_arrow(texts.select("text"), _set_maker(width), "node binary, items array<long>")
    return written(fewer(merged(sets, needed.select("node"), ["node"], "left_semi")
                         .dropDuplicates(["node"]), needed.count(), FILE_SETS), "shingle-sets")


def _starred(docs: DataFrame, reps: DataFrame, pairs: DataFrame, width: int, percent: int,
             ) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold.

    A node with many partners is dealt out in units of ``BLOCK``, each with the node's set.
    """
    pairs = settle(pairs)
    sets = _full_sets(docs, reps, pairs.select(F.col("u").alias("node")).unionByName(
        pairs.select(F.col("v").alias("node"))), width)
    sizes = pairs.groupBy("u").agg(F.count("*").alias("partners"))
    parts = F.ceil(F.col("partners") / BLOCK)
    units = settle(merged(pairs, sizes, ["u"]).select("u", "v", F.struct(
        "u", F.pmod(F.xxhash64("v"), parts).alias("part")).alias("unit")))
    hubs = units.select("unit", F.col("u").alias("node"), F.lit(0).alias("role")).distinct()
    partners = units.select("unit", F.col("v").alias("node"), F.lit(1).alias("role"))
    return (merged(hubs.unionByName(partners), sets, ["node"]).groupBy("unit")
            .applyInPandas(_checker(percent), "u binary, v binary"))


def _bridged(docs: DataFrame, nodes: DataFrame, inside: DataFrame, width: int, percent: int,
             ) -> DataFrame:
    """Links across the roots of buckets; ``inside`` is (band, bucket, members, node, root).

    Nodes are put into blocks of about ``SPAN`` by the largest bucket that they or a node
    beside them are in. Two blocks that meet in a bucket are a unit of work, once, however
    many buckets they meet in. Units are
    first cut to the nodes whose signatures come near another root's, then get full sets.
    """
    first = inside.groupBy("node").agg(F.max(F.struct("members", "bucket")).alias("_label"))
    around = merged(inside, first, ["node"]).groupBy("band", "bucket").agg(
        F.max("_label").alias("_label"))
    near_by = settle(merged(inside, around, ["band", "bucket"]).groupBy("node").agg(
        F.first("root").alias("root"), F.max("_label").alias("_label")))
    sizes = near_by.groupBy("_label").agg(F.count("*").alias("_nodes"))
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("_nodes") / SPAN))
    placed = settle(merged(near_by, sizes, ["_label"]).select(
        "node", "root", F.xxhash64("_label", chunk).alias("block")))
    span = placed.groupBy("block").agg(F.min("root").alias("_low"), F.max("root").alias("_high"))
    met = settle(merged(merged(inside.select("band", "bucket", "node"),
                               placed.select("node", "block"), ["node"])
                        .select("band", "bucket", "block").distinct(), span, ["block"]))
    left, right = met.alias("l"), met.hint("merge").alias("r")
    pairs = settle(left.join(right, F.expr(
        "l.band = r.band and l.bucket = r.bucket and l.block <= r.block "
        "and not (l._low = l._high and r._low = r._high and l._low = r._low)"))
        .select(F.col("l.block").alias("left"), F.col("r.block").alias("right")).distinct())
    lots = max(pairs.count() // 32, 1)
    ends = pairs.select("left", "right", F.explode(F.array_distinct(
        F.array("left", "right"))).alias("block"))
    members = merged(ends, placed, ["block"]).withColumn(
        "lot", F.pmod(F.xxhash64("left", "right"), F.lit(lots)))
    facts = merged(members, nodes.select("node", "n_shingles", "signature"), ["node"])
    near = settle(facts.groupBy("lot").applyInPandas(
        _survivors(percent), "left long, right long, node binary"))
    sets = _full_sets(docs, nodes, near.select("node"), width)
    return (merged(merged(facts, near, ["left", "right", "node"]), sets, ["node"])
            .groupBy("lot").applyInPandas(_joiner(percent), "u binary, v binary"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs (doc_id, text)``.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of
    ``width``-word shingles. ``component_id`` is the smallest doc_id reachable.

    A null or blank text has no shingles and stays alone (its component is its own id).
    Fewer words than ``width`` form one shingle. Repeated rows are copies: rows of one
    doc_id are one document and share its ``kept``. A row without doc_id takes part, and is
    kept only if its whole group has no id. Other columns are ignored; no rows, no rows.
    """
    sketched = written(sketches(docs, width), "sketches")
    nodes = sketched.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"),
        F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
        F.first("signature").alias("signature"))
    nodes = written(fewer(nodes, sketched.count(), FILE_NODES), "nodes")

    banded = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("band", "bucket").agg(
        F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1")
    member = settle(merged(banded, shared, ["band", "bucket"]))

    least = _least_match(percent)
    chance = 1 / (1 << BITS)
    facts = nodes.select("node", "n_shingles", "signature")
    pairs = (member.where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v"))
             .distinct())
    for end in ("u", "v"):
        pairs = merged(pairs, facts.select(
            F.col("node").alias(end), F.col("signature").alias(f"{end}_s"),
            F.col("n_shingles").alias(f"{end}_n")), [end])
    pairs = pairs.where(
        (estimate("u_s", "v_s") >= (least - chance) / (1 - chance))
        & (100 * F.least("u_n", "v_n") >= percent * F.greatest("u_n", "v_n"))).select("u", "v")
    links = settle(_starred(docs, nodes, pairs, width, percent))
    roots = components(links)

    # What a bucket still holds of several components, in blocks
    rooted = (merged(member, roots, ["node"], "left")
              .select("band", "bucket", "members", "node", F.coalesce("root", "node").alias("root")))
    mixed = rooted.groupBy("band", "bucket").agg(
        F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high")
    inside = settle(merged(rooted, mixed.select("band", "bucket"), ["band", "bucket"],
                           "left_semi"))
    parents = roots.withColumnRenamed("root", "parent")
    if not inside.isEmpty():
        more = settle(_bridged(docs, nodes, inside, width, percent))
        joined = components(relabelled(more, parents)).withColumnRenamed("root", "parent")
        # Roots that were no end of a link before are nodes of the later ones
        parents = settle(composed(parents, joined).unionByName(
            merged(joined, parents.select("node"), ["node"], "left_anti")))

    rooted = merged(nodes.select("node", "doc_id"), parents, ["node"], "left").select(
        "node", "doc_id", F.coalesce("parent", "node").alias("root"))
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = settle(merged(rooted, names, ["root"]).select("node", "component_id"))
    return (merged(sketched.select("doc_id", "n_shingles", "node"), named, ["node"], "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") == 0, F.col("doc_id"))
                    .otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
