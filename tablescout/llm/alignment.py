"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizers cut the same bytes. Merging their token ends in order gives the overlaps: each
step ends a stretch of bytes that lies in one token of either side, and an end that both sides
share closes a group. The merge of a long document is divided by binary searches on diagonals
(so many ends taken from both sides together): the pieces between them need the same work and
know nothing of each other. Spark deals them out, each emits its overlaps, and the groups that
cross a piece's boundary are stitched from what the pieces hold of them. A document of up to
``PIECE`` ends is one piece, merged where it was encoded, together with others.

How many documents hold a pair of ids is counted from the distinct pairs of lots of documents,
which go back to their lots with the counts: neither tokens nor links are shuffled, except those
of documents of several pieces.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scale import settle
from .text import map_arrow, written

TOKENIZERS = "/opt/tokenizers"
PIECE = 1 << 16         # token ends of both sides in a piece of a long document
LOT = 2 << 20           # characters of the documents that are merged and counted together
KEPT = 1 << 20          # tokens of words remembered by a worker

# Between such characters a space starts a token on either side, whatever stands around it.
_BREAK = re.compile("(?<=[!-~¡-ɏ]) (?=[!-~¡-ɏ])")


def _byte_level() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, one row each, and how many."""
    text = np.arange(n).astype("S")
    rows = text.view(np.uint8).reshape(n, -1)
    return rows, (rows != 0).sum(1)


class Tokenizers:
    """Both tokenizers and, as arrays, what their ids stand for.

    Words between safe spaces are encoded once and remembered: a token never crosses such a
    space, which is looked up in B's vocabulary and follows from A's splitting.
    """

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers
        self.a = tokenizers.Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        known, byte = self.a.get_vocab(), _byte_level()
        self.bytes_a = [b""] * (max(known.values()) + 1)
        for piece, number in known.items():
            self.bytes_a[number] = bytes(byte[c] for c in piece if c in byte)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k)
                        else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.breaks = not any("▁" in p.lstrip("▁") for p in pieces)
        self.digits = _digits(max(len(self.bytes_a), len(self.bytes_b)))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.good = np.zeros(0, bool)
        self.tokens = [np.zeros(0, np.int32)] * 2
        self.ends = [np.zeros(1, np.int64)] * 2

    def _learn(self, words: list[str]) -> None:
        both = ([x.ids for x in self.a.encode_batch_fast([" " + w for w in words],
                                                         add_special_tokens=False)],
                self.b.encode(words, num_threads=1))
        good = [self.joined(a, b, w) for w, a, b in zip(words, *both)]
        self.good = np.concatenate([self.good, good])
        for side, lists in enumerate(both):
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((t for x in lists for t in x), np.int32, int(sizes.sum()))
            self.ends[side] = np.concatenate([self.ends[side],
                                              self.ends[side][-1] + np.cumsum(sizes)])
            self.tokens[side] = np.concatenate([self.tokens[side], flat])

    def joined(self, a, b, text: str) -> bool:
        """Whether the tokens of both sides give the bytes of a space and the text."""
        want = (" " + text).encode()
        return (b"".join(map(self.bytes_a.__getitem__, a)) == want
                and b"".join(map(self.bytes_b.__getitem__, b)) == want)

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of both sides, one text after the other, and their number per text and side.

        Texts that are null or empty, or that a side doesn't give back, have none.
        """
        if max(map(len, self.tokens)) > KEPT:
            self._forget()
        cut = [[] if not t else _BREAK.split(t) if self.breaks else [t] for t in texts]
        new = list(dict.fromkeys(w for ws in cut for w in ws if w not in self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self._learn(new)
        n_words = np.fromiter(map(len, cut), np.int64, len(cut))
        words = np.fromiter((self.known[w] for ws in cut for w in ws), np.int64,
                            int(n_words.sum()))
        starts = np.concatenate([[0], np.cumsum(n_words)])
        ids, sizes = [], np.zeros((2, len(texts)), np.int64)
        for side in (0, 1):
            first = self.ends[side][words]
            count = self.ends[side][words + 1] - first
            until = np.concatenate([[0], np.cumsum(count)])
            ids.append(self.tokens[side][np.repeat(first - until[:-1], count)
                                         + np.arange(until[-1])])
            sizes[side] = np.diff(until[starts])
        bad = np.concatenate([[0], np.cumsum(~self.good[words])])
        for k in np.flatnonzero(np.diff(bad[starts])):
            at = sizes[:, :k].sum(1)
            if not self.joined(*(ids[s][at[s]:at[s] + sizes[s, k]] for s in (0, 1)), texts[k]):
                ids = [np.delete(ids[s], slice(at[s], at[s] + sizes[s, k])) for s in (0, 1)]
                sizes[:, k] = 0
        return ids, sizes


@functools.lru_cache(maxsize=1)
def tokenizers(folder: str) -> Tokenizers:
    return Tokenizers(folder)


def divide(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of ``size`` ends start on either side, and where the last one stops.

    On diagonal d, d ends lie before the cut; a binary search finds how many of them are A's.
    Ends that both sides share stay together.
    """
    n, m = len(ends_a), len(ends_b)
    d = np.append(np.arange(0, n + m, size), n + m)
    low, high = np.maximum(d - m, 0), np.minimum(d, n)
    while (low < high).any():
        open_ = low < high
        mid = (low + high) // 2
        earlier = np.zeros(len(d), bool)
        earlier[open_] = ends_a[mid[open_]] <= ends_b[(d - 1 - mid)[open_]]
        low, high = np.where(open_ & earlier, mid + 1, low), np.where(open_ & ~earlier, mid, high)
    i, j = low, d - low
    tied = (i > 0) & (j < m)
    tied[tied] = ends_a[i[tied] - 1] == ends_b[j[tied]]
    return i, j + tied


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray, start: int = 0) -> tuple[np.ndarray, ...]:
    """The merge of both ends after byte ``start``: (A's token, B's token, byte, shared)
    of each step."""
    last = max(ends_a[-1] if len(ends_a) else start, ends_b[-1] if len(ends_b) else start)
    side = np.zeros(last - start + 1, np.uint8)
    side[ends_a - start] = 1
    side[ends_b - start] |= 2
    at = np.flatnonzero(side)
    side = side[at]
    in_a, in_b = side & 1, side >> 1
    return (np.cumsum(in_a, dtype=np.int64) - in_a, np.cumsum(in_b, dtype=np.int64) - in_b,
            at + start, side == 3)


def _spelled(ids: np.ndarray, separators: np.ndarray, digits) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of decimal ids, each followed by its separator, and where each one ends."""
    rows, sizes = digits
    sizes = sizes[ids]
    text = np.empty((len(ids), rows.shape[1] + 1), np.uint8)
    text[:, :-1] = rows[ids]
    text[np.arange(len(ids)), sizes] = separators
    return text[np.arange(text.shape[1]) <= sizes[:, None]], np.cumsum(sizes + 1)


def _marks(group: np.ndarray, end: str) -> np.ndarray:
    """A comma after each token, ``end`` after the last one of its group."""
    out = np.full(len(group), ord(","), np.uint8)
    out[np.append(group[1:] != group[:-1], True)[:len(group)]] = ord(end)
    return out


def _grouped(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, digits):
    """Bytes ``a,a|b;...`` of whole groups, where each token ends, and the places of B's."""
    n = int(of_b[-1]) + 1 if len(of_b) else 0
    until_a = np.cumsum(np.bincount(of_a, minlength=n))
    until_b = np.concatenate([[0], np.cumsum(np.bincount(of_b, minlength=n))])
    place_a = np.arange(len(a)) + until_b[of_a]
    place_b = np.arange(len(b)) + until_a[of_b]
    ids = np.empty(len(a) + len(b), np.int32)
    marks = np.empty(len(ids), np.uint8)
    ids[place_a], ids[place_b] = a, b
    marks[place_a], marks[place_b] = _marks(of_a, "|"), _marks(of_b, ";")
    return (*_spelled(ids, marks, digits), place_b)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[first], np.diff(np.append(first, len(keys)))


def _lists(values: np.ndarray, sizes=None) -> pa.ListArray:
    sizes = [len(values)] if sizes is None else sizes
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


FACTS = ("n_a", "n_b", "n_groups", "n_links")
_ENCODED = ("lot long, docs array<struct<doc_id: {kind}, n_a: long, n_b: long, n_groups: long, "
            "n_links: long, groups_sha256: string, n_pairs: int>>, pairs array<long>, "
            "holders array<int>, which array<int>, times array<int>, "
            "row long, doc_id {kind}, piece int, a array<int>, b array<int>, own_a int, "
            "own_b int, at_a long, at_b long, start long")


def _empty(schema: pa.Schema, n: int, given: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [given[f.name].cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in schema],
        schema=schema)


def _encoder(folder: str, piece: int, lot: int, schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(folder)
        wide = len(both.bytes_b)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = np.cumsum([len(t or "") for t in texts])
            at = 0
            while at < len(texts):
                before = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, before + lot, "right")))
                names = batch.column("doc_id").slice(at, end - at)
                ids, counts = both.encode(texts[at:end])
                at = end
                # Long documents leave, as pieces
                stay = counts.sum(0) <= piece
                until = np.concatenate([[[0], [0]], np.cumsum(counts, 1)], 1)
                for k in np.flatnonzero(~stay):
                    own = [ids[s][until[s, k]:until[s, k + 1]] for s in (0, 1)]
                    yield from _pieces(own, names[int(k)], number, piece, both, schema)
                    number += 1
                ids = [ids[s][np.repeat(stay, counts[s])] for s in (0, 1)]
                names, counts = names.filter(pa.array(stay)), counts[:, stay]
                if len(names):
                    yield _lot(ids, counts, names, number, wide, both, schema)
                    number += 1
    return work


def _pieces(ids, name, number: int, size: int, both: Tokenizers, schema: pa.Schema):
    ends = [np.cumsum(both.length_a[ids[0]]), np.cumsum(both.length_b[ids[1]])]
    i, j = divide(*ends, size)
    for k in range(len(i) - 1):
        low, high = (i[k], j[k]), (i[k + 1], j[k + 1])
        at = [int(ends[s][low[s] - 1]) if low[s] else 0 for s in (0, 1)]
        # the token that the last stretch of the other side may reach into comes along
        a, b = (ids[s][low[s]:high[s] + 1] for s in (0, 1))
        yield _empty(schema, 1, {
            "row": pa.array([number]), "doc_id": pa.array([name.as_py()], name.type),
            "piece": pa.array([k]), "a": _lists(a), "b": _lists(b),
            "own_a": pa.array([int(high[0] - low[0])]), "own_b": pa.array([int(high[1] - low[1])]),
            "at_a": pa.array([at[0]]), "at_b": pa.array([at[1]]),
            "start": pa.array([max(at)])})


def _lot(ids, counts, names, number: int, wide: int, both: Tokenizers, schema: pa.Schema):
    a, b = ids
    own_a, own_b, at, shared = overlaps(np.cumsum(both.length_a[a]), np.cumsum(both.length_b[b]))
    group = np.cumsum(shared) - shared
    of_a, of_b = group[np.flatnonzero(np.diff(own_a, append=len(a)))], group[
        np.flatnonzero(np.diff(own_b, append=len(b)))]
    spelled, ends, places = _grouped(a, b, of_a, of_b, both.digits)
    until = np.concatenate([[0], np.cumsum(counts[1])])
    stops = np.concatenate([[0], ends[places[until[1:] - 1]]]) if len(places) else np.zeros(
        len(until), np.int64)
    text = spelled.tobytes()
    n_a, n_b = counts
    some = n_b > 0
    # texts without tokens: their stop is that of the text before
    stops[1:] = np.maximum.accumulate(np.where(some, stops[1:], 0))
    digests = [hashlib.sha256(text[x:y - 1]).hexdigest() if y > x else ""
               for x, y in zip(stops, stops[1:])]
    doc = np.repeat(np.arange(len(names)), n_b)[own_b]
    n_links = np.bincount(doc, minlength=len(names))
    n_groups = np.bincount(doc[shared], minlength=len(names))
    keys = doc * (len(both.bytes_a) * wide) + a[own_a].astype(np.int64) * wide + b[own_b]
    entries, times = _distinct(keys)
    owner, pair = np.divmod(entries, len(both.bytes_a) * wide)
    pairs, which = np.unique(pair, return_inverse=True)
    docs = pa.StructArray.from_arrays(
        [names, *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)),
         pa.array(digests), pa.array(np.bincount(owner, minlength=len(names)), pa.int32())],
        fields=list(schema.field("docs").type.value_type))
    return _empty(schema, 1, {
        "lot": pa.array([number]),
        "docs": pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), docs),
        "pairs": _lists(pairs), "holders": _lists(np.bincount(which, minlength=len(pairs))),
        "which": _lists(which), "times": _lists(times)})


def _merger(folder: str, schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(folder)
        wide = len(both.bytes_b)
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row] for c in batch.schema.names}
                a, b = (one[c].values.to_numpy() for c in ("a", "b"))
                size_a, size_b = one["own_a"].as_py(), one["own_b"].as_py()
                ends_a = one["at_a"].as_py() + np.cumsum(both.length_a[a[:size_a]])
                ends_b = one["at_b"].as_py() + np.cumsum(both.length_b[b[:size_b]])
                own_a, own_b, _, shared = overlaps(ends_a, ends_b, one["start"].as_py())
                pairs, times = _distinct(a[own_a].astype(np.int64) * wide + b[own_b])
                texts = []
                for ids, own in ((a[:size_a], own_a), (b[:size_b], own_b)):
                    step = np.flatnonzero(np.diff(own, append=len(ids)))
                    marks = np.where(shared[step], ord(";"), ord(",")).astype(np.uint8)
                    texts.append(_spelled(ids, marks, both.digits)[0].tobytes().decode())
                yield _empty(schema, 1, {
                    "row": batch.column("row").slice(row, 1),
                    "doc_id": batch.column("doc_id").slice(row, 1),
                    "piece": batch.column("piece").slice(row, 1),
                    "n_a": pa.array([size_a]), "n_b": pa.array([size_b]),
                    "n_groups": pa.array([int(shared.sum())]), "n_links": pa.array([len(own_a)]),
                    "a_text": pa.array([texts[0]]), "b_text": pa.array([texts[1]]),
                    "pairs": _lists(pairs), "times": _lists(times)})
    return work


def _counted(schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                docs = batch.column("docs")[row].values
                known = batch.column("known")[row].values
                n, best = known.field("n").to_numpy(), known.field("best").to_numpy(
                    zero_copy_only=False)
                which = batch.column("which")[row].values.to_numpy()
                times = batch.column("times")[row].values.to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(docs)), docs.field("n_pairs").to_numpy())
                sums = np.zeros((2, len(docs)), np.int64)
                np.add.at(sums[0], doc, times * best[which])
                np.add.at(sums[1], doc, times * n[which])
                given = {f.name: docs.field(f.name) for f in schema if f.name not in (
                    "n_best", "count_sum")}
                yield _empty(schema, len(docs), given | {
                    "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])})
    return work


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(schema))


def align(docs: DataFrame, folder: str = TOKENIZERS, piece: int = PIECE, lot: int = LOT,
          ) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    ``docs`` has ``doc_id`` (of any simple type) and ``text``; other columns are ignored. A
    (``byte_bpe_50k.json``) encodes a space and the text, B (``piece_bpe_32k.model``) the text;
    special tokens are plain text. Groups are the stretches between byte offsets at which tokens
    of both end, links the overlapping tokens. The count of a pair of ids is the number of rows
    that link it; ``count_sum`` sums it over links, ``n_best`` counts links whose count is the
    highest of their A id. ``groups_sha256`` is that of ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts that a side doesn't give back byte for byte, have no tokens:
    zeros and ''. Every row is a document of its own, also one that repeats another or has no
    doc_id. No rows, no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = _ENCODED.format(kind=kind)
    encoded = written(map_arrow(docs.select("doc_id", "text"),
                                _encoder(folder, piece, lot, _arrow(docs, ddl)), ddl), "encoded")
    lots = encoded.where("lot is not null").select("lot", "docs", "pairs", "holders", "which",
                                                   "times")
    ddl = (f"row long, doc_id {kind}, piece int, n_a long, n_b long, n_groups long, n_links long, "
           "a_text string, b_text string, pairs array<long>, times array<int>")
    parts = encoded.where("row is not null").select(
        "row", "doc_id", "piece", "a", "b", "own_a", "own_b", "at_a", "at_b", "start")
    parts = written(map_arrow(parts.repartition("row", "piece"), _merger(
        folder, _arrow(docs, ddl)), ddl), "merged-pieces")
    of_long = settle(parts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
                     .groupBy("row", F.col("p.pairs").alias("pair"))
                     .agg(F.sum("p.times").alias("times")))

    of_lots = lots.select("lot", F.posexplode(F.arrays_zip("pairs", "holders")).alias("at", "p"))
    wide = len(tokenizers(folder).bytes_b)
    counts = (of_lots.select(F.col("p.pairs").alias("pair"), F.col("p.holders").alias("n"))
              .unionByName(of_long.select("pair", F.lit(1).alias("n")))
              .groupBy("pair").agg(F.sum("n").alias("n")))
    same_a = Window.partitionBy(F.expr(f"pair div {wide}"))
    counts = settle(counts.select("pair", "n", (F.col("n") == F.max("n").over(same_a))
                                  .alias("best")))

    known = (of_lots.select("lot", "at", F.col("p.pairs").alias("pair"))
             .join(counts.hint("merge"), "pair").groupBy("lot")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n", "best"))),
                              lambda x: F.struct(x["n"].alias("n"), x["best"].alias("best")))
                  .alias("known")))
    # a lot without any token has no pair
    none = F.array().cast("array<struct<n:bigint,best:boolean>>")
    ddl = (f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
           "count_sum long, groups_sha256 string")
    short = map_arrow(
        lots.select("lot", "docs", "which", "times").join(known.hint("merge"), "lot", "left")
        .select("docs", "which", "times", F.coalesce("known", none).alias("known")),
        _counted(_arrow(docs, ddl)), ddl)

    sums = of_long.join(counts.hint("merge"), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    pieces = F.array_sort(F.collect_list(F.struct("piece", "a_text", "b_text")))
    whole = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in FACTS],
        pieces.alias("pieces"))

    def side(name: str):
        text = F.array_join(F.transform("pieces", lambda p: p[name]), "")
        return F.split(F.substring(text, F.lit(1), F.length(text) - 1), ";")

    spelled = F.array_join(F.zip_with(side("a_text"), side("b_text"),
                                      lambda a, b: F.concat(a, F.lit("|"), b)), ";")
    long = whole.join(sums, "row").select(
        "doc_id", *FACTS, "n_best", "count_sum", F.sha2(spelled, 256).alias("groups_sha256"))
    return short.unionByName(long)
