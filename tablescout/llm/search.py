"""Ranked lexical search with hashed max-sketches.

The impact of a term on a document grows with its occurrences there, for given statistics of
the corpus. A document's sketch is an array of bytes: each term's occurrences fold into the
maximum at the coordinate that its hash names (255: that many or more). Looked up for a term, it
gives at least the term's occurrences, so the impacts of what it gives sum to an upper bound of
any query's score. Sketches have ``SPREAD`` coordinates for each distinct term of their document.

Bounds of many documents and all queries come from batched lookups. The documents of highest
bound of each query are scored exactly, which sets its threshold; then every document with a
bound that reaches a query's threshold is scored exactly, in order of descending bounds, and
thresholds rise on the way until no bound is left that reaches them. A task hands on its best
documents per query only.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import map_arrow, written

TOP = 20
SPREAD = 8              # coordinates of a sketch for each distinct term, at least
SEEDS = 32              # documents of highest bound that set a query's first threshold
QUERY_BYTES = 4 << 20   # of query texts that are held by every task; more go in several rounds
SLICE = 1 << 20         # bytes of a text that are cut into terms at once
CELLS = 1 << 22         # looked-up values in memory at once

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_OTHER = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def terms(text: str | None) -> Counter:
    """How often each term (UTF-8, A-Z lower-cased) occurs in a text."""
    data = (text or "").encode().translate(_LOWER)
    if len(data) <= SLICE:
        return Counter(_TERM.findall(data))
    counts, at = Counter(), 0
    while at < len(data):
        cut = _OTHER.search(data, min(at + SLICE, len(data)))
        end = cut.start() if cut else len(data)
        counts.update(_TERM.findall(data, at, end))
        at = end
    return counts


def places(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def sketch(counts: Counter) -> np.ndarray:
    """The maxima of occurrences, by hash; as many coordinates as a power of two."""
    size = 1 << (SPREAD * len(counts) - 1).bit_length()
    cells = np.zeros(size, np.uint8)
    seen = np.fromiter(counts.values(), np.int64, len(counts))
    np.maximum.at(cells, places(list(counts)) & (size - 1), np.minimum(seen, 255).astype(np.uint8))
    return cells


class Questions:
    """The queries of a round: their terms, weighed once the corpus is counted."""

    def __init__(self, texts: list[str | None]):
        found = [terms(t) for t in texts]
        self.terms = sorted(set().union(*found)) if found else []
        self.number = {t: k for k, t in enumerate(self.terms)}
        self.places = places(self.terms)
        self.own = [np.array([self.number[t] for t in f], np.int64) for f in found]
        self.times = [np.array(list(f.values()), np.int64) for f in found]

    def weigh(self, documents: int, length: int, held: np.ndarray) -> None:
        """From the corpus: documents with a term, their terms, and documents of each term."""
        self.documents, self.length = documents, length
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1)))
                            for d in held], np.int64)
        self.weights = [weights[own] * times for own, times in zip(self.own, self.times)]
        # by term, for documents that hold few of them
        order = np.concatenate([np.zeros(0, np.int64), *self.own])
        asking = np.repeat(np.arange(len(self.own)), [len(o) for o in self.own])
        by = np.argsort(order, kind="stable")
        self.asking, self.weight = asking[by], np.concatenate(
            [np.zeros(0, np.int64), *self.weights])[by]
        self.until = np.searchsorted(order[by], np.arange(len(self.terms) + 1))

    def damping(self, n: int) -> int:
        """12 times a document's m."""
        return 12 * (75 + 25 * n * self.documents // self.length)

    def scores(self, counts: Counter, n: int) -> np.ndarray:
        """The exact score of a document for every query."""
        out, damping = np.zeros(len(self.own), np.int64), self.damping(n)
        for term in counts.keys() & self.number.keys():
            k, tf = self.number[term], counts[term]
            where = slice(self.until[k], self.until[k + 1])
            np.add.at(out, self.asking[where],
                      self.weight[where] * (1000000000 * tf // (1000 * tf + damping)))
        return out

    def bounds(self, cells: np.ndarray, lengths: list[int]) -> np.ndarray:
        """Upper bounds (query, document) from sketches of one size."""
        seen = cells[:, self.places & (cells.shape[1] - 1)].T
        tf = np.arange(256, dtype=np.int64)
        damping = np.array([self.damping(n) for n in lengths], np.int64)
        impact = (1000000000 * tf // (1000 * tf + damping[:, None])).astype(np.float64)
        impact[:, 255] = 1000000                # however many there are
        looked = impact[np.arange(len(lengths)), seen]
        sums = [w.astype(np.float64) @ looked[own] if len(own) else np.zeros(len(lengths))
                for own, w in zip(self.own, self.weights)]
        return np.ceil(np.stack(sums) * (1 + 1e-9)).astype(np.int64)


def _indexer(questions):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = questions.value
        documents = length = 0
        held = np.zeros(len(asked.terms), np.int64)
        for batch in batches:
            sizes, cells = [], []
            for text in batch.column("text"):
                counts = terms(text.as_py())
                n = counts.total()
                sizes.append(n)
                cells.append(sketch(counts).tobytes() if n else None)
                documents, length = documents + (n > 0), length + n
                for term in counts.keys() & asked.number.keys():
                    held[asked.number[term]] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("text"),
                 pa.array(sizes, pa.int64()), pa.array(cells, pa.binary()),
                 pa.nulls(len(sizes), pa.list_(pa.int64()))],
                ["row", "doc_id", "text", "n", "sketch", "held"])
        last = batch.schema if documents else None
        if last is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, last.field("row").type), pa.nulls(1, last.field("doc_id").type),
                 pa.nulls(1, last.field("text").type), pa.array([length], pa.int64()),
                 pa.nulls(1, pa.binary()), pa.array([[documents, *held.tolist()]])],
                ["row", "doc_id", "text", "n", "sketch", "held"])
    return work


def _bounded(asked: Questions, batch: pa.RecordBatch):
    """(documents of the batch, their bounds for every query), a lot of one size at a time."""
    cells, lengths = batch.column("sketch"), batch.column("n").to_pylist()
    sizes = np.array([len(c.as_py()) for c in cells])
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        lot = max(1, CELLS // max(int(size), len(asked.terms)))
        for at in range(0, len(own), lot):
            some = own[at:at + lot]
            table = np.frombuffer(b"".join(cells[int(k)].as_py() for k in some), np.uint8)
            yield some, asked.bounds(table.reshape(len(some), size), [lengths[k] for k in some])


def _highest(questions, seeds: int):
    """The rows of highest bounds of each query."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = questions.value
        best_bound = [np.zeros(0, np.int64)] * len(asked.own)
        best_row = list(best_bound)
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for some, bounds in _bounded(asked, batch):
                for q, own in enumerate(bounds):
                    if len(best_bound[q]) >= seeds and own.max() <= best_bound[q].min():
                        continue
                    both = np.concatenate([best_bound[q], own])
                    names = np.concatenate([best_row[q], rows[some]])
                    keep = np.argsort(-both, kind="stable")[:seeds]
                    best_bound[q], best_row[q] = both[keep], names[keep]
        sizes = [len(b) for b in best_bound]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()),
                 pa.array(np.concatenate(best_row)), pa.array(np.concatenate(best_bound))],
                ["query", "row", "bound"])
    return work


def _scorer(questions, thresholds, top: int, bounded: bool):
    """The ``top`` best documents of each query, by exact scores.

    With bounds, only documents whose bounds reach a threshold are scored, highest first.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = questions.value
        least = np.array(thresholds.value if bounded else [1] * len(asked.own), np.int64)
        best: list[list] = [[] for _ in asked.own]
        kind = None
        for batch in batches:
            names, texts, sizes = (batch.column(c) for c in ("doc_id", "text", "n"))
            kind = names.type
            for some, bounds in (_bounded(asked, batch) if bounded else
                                 [(np.arange(len(names)), None)]):
                order = np.argsort(-bounds.max(0), kind="stable") if bounded else range(len(some))
                for k in order:
                    # queries whose threshold the bound still reaches
                    open_ = (np.flatnonzero(bounds[:, k] >= least) if bounded
                             else np.arange(len(least)))
                    if not len(open_):
                        continue
                    at = int(some[k])
                    scores = asked.scores(terms(texts[at].as_py()), sizes[at].as_py())
                    for q in open_[scores[open_] >= least[open_]]:
                        name = names[at].as_py()
                        one = (int(scores[q]), name is not None,
                               -name if name is not None else 0, name)
                        if len(best[q]) < top:
                            heapq.heappush(best[q], one)
                        else:
                            heapq.heappushpop(best[q], one)
                        if len(best[q]) == top:
                            least[q] = max(least[q], best[q][0][0])
        found = [(q, x[0], x[3]) for q, own in enumerate(best) for x in own]
        if found:
            q, score, name = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int32()), pa.array(score, pa.int64()), pa.array(name, kind)],
                ["query", "score", "doc_id"])
    return work


def _rounds(queries: DataFrame) -> Iterator[list[tuple]]:
    """The queries (item_id, text), so many at a time as have ``QUERY_BYTES`` of text."""
    some, held = [], 0
    for row in queries.select("item_id", "text").toLocalIterator():
        size = len((row["text"] or "").encode())
        if some and held + size > QUERY_BYTES:
            yield some
            some, held = [], 0
        some.append((row["item_id"], row["text"]))
        held += size + 64
    if some:
        yield some


def _round(docs: DataFrame, asked: Questions, top: int, kind: str) -> DataFrame:
    """(query, rank, doc_id, score) of the queries of a round."""
    spark = docs.sparkSession
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    index = written(map_arrow(
        numbered, _indexer(spark.sparkContext.broadcast(asked)),
        f"row long, doc_id {kind}, text string, n long, sketch binary, held array<long>"), "index")
    totals = index.where("held is not null")
    length = totals.agg(F.sum("n")).first()[0] or 0
    held = np.zeros(len(asked.terms) + 1, np.int64)
    for at, n in (totals.select(F.posexplode("held").alias("at", "n")).groupBy("at")
                  .agg(F.sum("n").alias("n")).collect()):
        held[at] = n
    asked.weigh(int(held[0]), max(int(length), 1), held[1:])
    shared = spark.sparkContext.broadcast(asked)
    sketches = index.where("sketch is not null")

    seeds = map_arrow(sketches.select("row", "n", "sketch"), _highest(shared, SEEDS),
                      "query int, row long, bound long")
    highest = Window.partitionBy("query").orderBy(F.desc("bound"), "row")
    rows = (seeds.withColumn("at", F.row_number().over(highest)).where(F.col("at") <= SEEDS)
            .select("row").distinct())
    first = map_arrow(sketches.join(F.broadcast(rows), "row", "left_semi")
                      .select("doc_id", "text", "n"), _scorer(shared, None, top, False),
                      f"query int, score long, doc_id {kind}")
    order = Window.partitionBy("query").orderBy(
        F.desc("score"), F.col("doc_id").asc_nulls_last())
    least = [1] * len(asked.own)
    for r in (first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == top)
              .select("query", "score").collect()):
        least[r["query"]] = max(1, r["score"])
    found = map_arrow(sketches.select("doc_id", "text", "n", "sketch"),
                      _scorer(shared, spark.sparkContext.broadcast(least), top, True),
                      f"query int, score long, doc_id {kind}")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each row of ``queries``.

    ``docs`` has ``doc_id`` (a whole number) and ``text``, ``queries`` has ``item_id`` and
    ``text``; other columns are ignored. Only documents of a score above 0 are ranked, equal
    scores by ascending ``doc_id``, those without one last. Null texts have no terms; queries
    without terms find nothing. Rows that repeat are documents, and queries, of their own.
    No documents or no queries, no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark, out = docs.sparkSession, None
    for asked in _rounds(queries):
        names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(asked)],
                                      f"query int, item_id "
                                      f"{queries.schema['item_id'].dataType.simpleString()}")
        part = (_round(docs, Questions([t for _, t in asked]), top, kind)
                .join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = queries.select("item_id").limit(0).select(
            "item_id", F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("doc_id"),
            F.lit(0).cast("long").alias("score"))
    return out
