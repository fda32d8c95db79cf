"""Language-model scores from a probabilistic suffix tree.

The tree models the bytes of a text's tokens, each token closed by a space and the last by
an end mark. Its contexts are up to ``DEPTH`` bytes long. Tasks count their own runs of
``DEPTH`` + 1 bytes, Spark adds the counts up, and shorter contexts are sums of longer ones.
A context stays if its next-symbol distribution diverges from that of the context one byte
shorter by ``DIVERGENCE`` nats over all its occurrences, or if a longer one of it does. That is
a fixed amount of evidence, so the tree grows with the corpus. Distributions are smoothed towards
the shorter context's. A text is scored with the longest context of the tree at each byte.

The tree is a table that is never in one place: contexts are dealt by their nearest two bytes
(their head). Texts are read once for every ``ROUND_PAIRS`` (context, next byte) of the tree,
which then go to all workers, and each round scores the bytes that follow its heads.

Beside it stands a base model, a unigram of whole tokens with one added to each count: a
token of count c among N, V of them distinct, has probability (c + 1) / (N + V + 1). Its
vocabulary grows with the corpus, so it is never in one place: chunks of texts are counted
by word, words are dealt into buckets, and each bucket's counts meet the chunks' entries.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import new_folder
from .text import chunks, lookup, lowered, map_arrow, prefix_hashes, stretch_hashes, words, written

DEPTH = 6                   # at most 7: a context and the next byte are one 64-bit number
DIVERGENCE = 20.0
PRIOR = 2.0                 # weight of the shorter context's distribution
SPACE, END = 0x20, 0x0A     # no token holds them
MOST_GRAMS = 2_000_000      # different runs of bytes that a task counts before it passes them on
LUMP = 500_000              # runs of bytes that are pruned together, but for what ends a head
ROUND_PAIRS = 2_000_000     # (context, next byte) that are sent to all workers at once
CHUNK_BYTES = 8 << 20       # texts whose words are counted together
SALT_BYTES = 16 << 20       # text whose entries of one bucket meet its counts in one task
ENTRIES = 400_000           # (chunk, word) entries in a bucket of words


def _stream(data: np.ndarray, offsets: np.ndarray):
    """Symbols of the texts, one after another, and where each text begins."""
    data = lowered(data)
    starts, ends, number = words(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(number, minlength=n)
    sizes = np.bincount(number, ends - starts + 1, minlength=n).astype(np.int64)
    sizes[counts == 0] = 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(begin[-1], SPACE, np.uint8)
    out[begin[1:] - 1] = END
    lengths = ends - starts
    inside = np.cumsum(lengths + 1) - lengths - 1
    first = inside[np.searchsorted(number, number)] if len(number) else inside
    at = begin[number] + inside - first
    total = int(lengths.sum())
    step = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(at, lengths) + step] = data[np.repeat(starts, lengths) + step]
    return out, begin, counts


def _grams(out: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Context (nearest byte first) and next symbol of every place, as one number."""
    place = np.arange(len(out)) - np.repeat(begin[:-1], np.diff(begin))
    gram = np.zeros(len(out), np.uint64)
    for k in range(1, DEPTH + 1):
        back = np.full(len(out), END, np.uint8)
        back[k:] = out[:-k] if k < len(out) else out[:0]
        back[place < k] = END
        gram = (gram << np.uint64(8)) | back
    return (gram << np.uint64(8)) | out


def _counted(batches):
    """(gram, n) of a task's texts."""
    kept, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting: list = []

    def fold():
        nonlocal kept, counts, waiting
        every = np.concatenate([kept, *(w[0] for w in waiting)])
        weight = np.concatenate([counts, *(w[1] for w in waiting)])
        kept, back = np.unique(every, return_inverse=True)
        counts = np.bincount(back, weight, minlength=len(kept)).astype(np.int64)
        waiting = []

    def passed():
        for at in range(0, len(kept), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept[at:at + 100_000].view(np.int64)), pa.array(counts[at:at + 100_000])],
                names=["gram", "n"])

    for batch in batches:
        for _, _, data, offsets in chunks(batch.column("text")):
            waiting.append(np.unique(_grams(*_stream(data, offsets)[:2]), return_counts=True))
            if len(waiting) >= 8:
                fold()
                if len(kept) > MOST_GRAMS:
                    yield from passed()
                    kept, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    fold()
    yield from passed()


def _shorter(keys: np.ndarray) -> np.ndarray:
    """(context, next byte) without the farthest byte of the context."""
    return ((keys >> 16) << 8) | (keys & 255)


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and their sums."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _contexts(keys: np.ndarray, n: np.ndarray):
    """Different contexts of sorted keys, where each begins, its sum, and the number of each key's."""
    own = keys >> 8
    new = np.diff(own, prepend=-1) != 0
    first = np.flatnonzero(new)
    return own[first], first, np.add.reduceat(n, first) if len(first) else n, np.cumsum(new) - 1


def _gains(keys, n, above, above_n) -> np.ndarray:
    """By how many nats each context's next bytes diverge from those of the context above."""
    _, first, sums, own = _contexts(keys, n)
    _, _, above_sums, above_own = _contexts(above, above_n)
    at = np.searchsorted(above, _shorter(keys))
    return np.add.reduceat(n * np.log(n * above_sums[above_own[at]].astype(float)
                                      / (sums[own] * above_n[at].astype(float))), first)


def _pruned(keys: np.ndarray, n: np.ndarray, divergence: float) -> pa.RecordBatch:
    """What stays of whole heads: pairs of three bytes or more, and all of two.

    Of two bytes, ``kept`` tells which stay as a longer context does; the test of their own
    needs the contexts of one byte, which all heads share.
    """
    levels = {DEPTH: (keys, n)}
    for d in range(DEPTH - 1, 1, -1):
        levels[d] = _added(_shorter(levels[d + 1][0]), levels[d + 1][1])
    found, asked = [], np.zeros(0, np.int64)
    for d in range(DEPTH, 1, -1):
        keys, n = levels[d]
        contexts, _, _, own = _contexts(keys, n)
        stays = np.isin(contexts, asked)
        if d > 2:
            stays |= _gains(keys, n, *levels[d - 1]) >= divergence
        asked = np.unique(contexts[stays] >> 8)
        rows = stays[own] if d > 2 else np.ones(len(keys), bool)
        found.append(((keys[rows] | (d << 56)), keys[rows] >> (8 * (d - 1)), n[rows], stays[own][rows]))
    key, head, n, kept = (np.concatenate(c) for c in zip(*found))
    return pa.RecordBatch.from_arrays(
        [pa.array(head.astype(np.int32)), pa.array(key), pa.array(n), pa.array(kept)],
        names=["head", "key", "n", "kept"])


def _prunes(divergence: float):
    """Grams in order, all of a head in one task, to the pairs that stay; equal ones are added."""
    def prune(batches):
        waiting, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append((batch.column("gram").to_numpy(), batch.column("n").to_numpy()))
            held += batch.num_rows
            if held < LUMP:
                continue
            keys, n = (np.concatenate(c) for c in zip(*waiting))
            end = int(np.searchsorted(keys, (keys[-1] >> 8 * (DEPTH - 1)) << 8 * (DEPTH - 1)))
            if end:
                yield _pruned(*_added(keys[:end], n[:end]), divergence)
            waiting, held = [(keys[end:], n[end:])], len(keys) - end if end else 0
        if waiting:
            yield _pruned(*_added(*(np.concatenate(c) for c in zip(*waiting))), divergence)
    return prune


class _Shard:
    """Log10 probabilities (``told``) of the pairs of the heads from ``low`` on and below ``high``.

    ``back`` is what a byte not seen after a context adds to its value after the shorter one.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, low: int, high: int):
        self.low, self.high = low, high
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        depth, keys = keys >> 56, keys & ((1 << 56) - 1)
        cuts = np.searchsorted(depth, np.arange(DEPTH + 2))
        self.keys, self.told, self.contexts, self.back = [], [], [], []
        share = np.zeros(0)
        for d in range(DEPTH + 1):
            own, times = keys[cuts[d]:cuts[d + 1]], n[cuts[d]:cuts[d + 1]]
            contexts, _, sums, number = _contexts(own, times)
            above = (share[np.searchsorted(self.keys[-1], _shorter(own))] if d
                     else np.full(len(own), 1 / 256))
            share = (times + PRIOR * above) / (sums[number] + PRIOR)
            self.keys.append(own)
            self.told.append(np.log10(share).astype(np.float32))
            self.contexts.append(contexts)
            self.back.append(np.log10(PRIOR / (sums + PRIOR)).astype(np.float32))

    def values(self, grams: np.ndarray) -> np.ndarray:
        """Log10 probability of the next byte of each gram; the grams are in order."""
        out, left = np.zeros(len(grams)), np.arange(len(grams))
        for d in range(DEPTH, -1, -1):
            if not len(self.keys[d]):
                continue
            some = grams[left]
            key = ((some >> 8 * (DEPTH - d + 1)) << 8) | (some & 255)
            at = np.minimum(np.searchsorted(self.keys[d], key), len(self.keys[d]) - 1)
            hit = self.keys[d][at] == key
            out[left[hit]] += self.told[d][at[hit]]
            left, context = left[~hit], key[~hit] >> 8
            at = np.minimum(np.searchsorted(self.contexts[d], context), len(self.contexts[d]) - 1)
            has = self.contexts[d][at] == context
            out[left[has]] += self.back[d][at[has]]
        out[left] -= np.log10(256)
        return out


def _automaton(table: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """``step``, ``log`` and ``start`` of (depth, context, next, n) of the retained contexts."""
    retained = set(zip(table["depth"].tolist(), table["context"].tolist()))
    retained.add((0, 0))
    states, todo = set(), list(retained)
    while todo:             # closed under dropping the nearest and the farthest byte
        d, c = todo.pop()
        if (d, c) not in states:
            states.add((d, c))
            if d:
                todo += [(d - 1, c >> 8), (d - 1, c & ((1 << 8 * (d - 1)) - 1))]
    order = sorted(states)
    number = {s: i for i, s in enumerate(order)}
    share = np.full((len(order), 256), 1 / 256)
    rows = {k: (g["next"].to_numpy(), g["n"].to_numpy()) for k, g in table.groupby(
        ["depth", "context"])}
    for i, (d, c) in enumerate(order):
        if d:
            share[i] = share[number[d - 1, c >> 8]]
        if (d, c) in rows:
            following, n = rows[d, c]
            share[i] *= PRIOR
            share[i, following] += n
            share[i] /= n.sum() + PRIOR
    step = np.zeros((len(order), 256), np.int32)
    by_depth = [np.array([c for e, c in order if e == d], np.int64) for d in range(DEPTH + 1)]
    base = np.cumsum([0] + [len(x) for x in by_depth])
    symbols = np.arange(256, dtype=np.int64)
    for d in range(DEPTH + 1):
        if not len(by_depth[d]):
            continue
        code = (symbols[None] << (8 * d)) | by_depth[d][:, None]
        depth, found = d + 1, np.zeros(code.shape, bool)
        target = np.zeros(code.shape, np.int32)
        while depth > 0:
            if depth <= DEPTH and len(by_depth[depth]):
                at = np.minimum(np.searchsorted(by_depth[depth], code), len(by_depth[depth]) - 1)
                hit = (by_depth[depth][at] == code) & ~found
                target[hit] = (base[depth] + at)[hit]
                found |= hit
            code >>= 8
            depth -= 1
        step[base[d]:base[d + 1]] = target
    start = 0
    for _ in range(DEPTH):
        start = int(step[start, END])
    return step, np.log10(share).astype(np.float32), start


@dataclass(frozen=True)
class SuffixTree:
    """A tree as tables: ``key`` is (depth, context, next byte), ``n`` how often it stands.

    ``top`` has the pairs of contexts below three bytes, ``deep (head, key, n)`` the others,
    ``pairs`` the number of those by head.
    """

    top: tuple[np.ndarray, np.ndarray]
    deep: DataFrame | None
    pairs: np.ndarray

    def shards(self) -> Iterator[_Shard]:
        """The tree in parts of about ``ROUND_PAIRS`` pairs; every head is in one."""
        keys, n = self.top
        depth, head = keys >> 56, (keys >> 8) & 0xFFFF
        low = 0
        while low < 1 << 16:
            sums = np.cumsum(self.pairs[low:])
            high = low + max(1, int(np.searchsorted(sums, ROUND_PAIRS, "right")))
            own = (depth < 2) | ((head >= low) & (head < high))
            more = (np.zeros(0, np.int64),) * 2
            if self.pairs[low:high].any():
                found = self.deep.where((F.col("head") >= low) & (F.col("head") < high)).select(
                    "key", "n").toArrow()
                more = found["key"].to_numpy(), found["n"].to_numpy()
            yield _Shard(np.concatenate([keys[own], more[0]]), np.concatenate([n[own], more[1]]),
                         low, high)
            low = high

    @functools.cached_property
    def automaton(self) -> tuple[np.ndarray, np.ndarray, int]:
        """The same tree as an automaton; for small trees, as it is one array."""
        keys, n = self.top
        if self.deep is not None:
            found = self.deep.select("key", "n").toArrow()
            keys = np.concatenate([keys, found["key"].to_numpy()])
            n = np.concatenate([n, found["n"].to_numpy()])
        return _automaton(pd.DataFrame({
            "depth": keys >> 56, "context": (keys & ((1 << 56) - 1)) >> 8, "next": keys & 255,
            "n": n}))

    @property
    def step(self) -> np.ndarray:
        """``step[state, symbol]`` of the automaton."""
        return self.automaton[0]

    @property
    def log(self) -> np.ndarray:
        """``log[state, symbol]`` (log10) of the automaton."""
        return self.automaton[1]

    @property
    def start(self) -> int:
        return self.automaton[2]


def fit(train: DataFrame, divergence: float = DIVERGENCE) -> SuffixTree:
    """The tree of the texts of ``train (text)``; null texts count as empty."""
    texts = train.select(F.coalesce("text", F.lit("")).alias("text"))
    grams = map_arrow(texts, _counted, "gram long, n long").withColumn(
        "head", F.shiftrightunsigned("gram", 8 * (DEPTH - 1)))
    ordered = grams.repartition("head").sortWithinPartitions("gram").select("gram", "n")
    tree = written(map_arrow(ordered, _prunes(divergence),
                             "head int, key long, n long, kept boolean"), "tree")
    two = F.shiftrightunsigned("key", 56) == 2
    pairs = np.zeros(1 << 16, np.int64)
    for head, n in tree.where(~two).groupBy("head").count().collect():
        pairs[head] = n
    short = tree.where(two).select("key", "n", "kept").toArrow()
    keys, n, kept = (short[c].to_numpy() for c in ("key", "n", "kept"))
    order = np.argsort(keys)
    keys, n, kept = keys[order] & ((1 << 56) - 1), n[order], kept[order]
    one, one_n = _added(_shorter(keys), n)
    none, none_n = _added(_shorter(one), one_n)
    if not len(keys):
        return SuffixTree((none, none_n), None, pairs)
    kept = kept | (_gains(keys, n, one, one_n) >= divergence)[_contexts(keys, n)[3]]
    stays = (_gains(one, one_n, none, none_n) >= divergence)[_contexts(one, one_n)[3]]
    stays |= np.isin(one >> 8, keys[kept] >> 16)
    return SuffixTree((np.concatenate([none, one[stays] | (1 << 56), keys[kept] | (2 << 56)]),
                       np.concatenate([none_n, one_n[stays], n[kept]])),
                      tree.where(~two).select("head", "key", "n"), pairs)


def _told(shard: _Shard, out: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """What the heads of a shard add to the log10 probability of each text."""
    grams = _grams(out, begin).view(np.int64)
    head = grams >> 8 * (DEPTH - 1)
    own = np.flatnonzero((head >= shard.low) & (head < shard.high))
    found, back = np.unique(grams[own], return_inverse=True)
    text = np.searchsorted(begin, own, "right") - 1
    return np.bincount(text, shard.values(found)[back], minlength=len(begin) - 1)


def _scores(tree: SuffixTree, out: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """log10 probability of each text."""
    return sum(_told(shard, out, begin) for shard in tree.shards())


def _scored(shard, number: int):
    """(key, round, n_tokens, part of the score) of each text."""
    def work(batches):
        for batch in batches:
            parts = [(np.zeros(0, np.int64), np.zeros(0))]
            for _, _, data, offsets in chunks(batch.column("text")):
                out, begin, counts = _stream(data, offsets)
                parts.append((counts + 1, _told(shard.value, out, begin)))
            tokens, value = (np.concatenate(c) for c in zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(np.full(len(tokens), number, np.int32)),
                 pa.array(tokens.astype(np.int64)), pa.array(value)],
                names=["key", "round", "n_tokens", "score"])
    return work


def tree_scores(texts: DataFrame, tree: SuffixTree) -> DataFrame:
    """(key, n_tokens, score) of the different keys of ``texts (key, text)``."""
    spark = texts.sparkSession
    path, schema = new_folder(spark, "tree-scores"), "key binary, round int, n_tokens long, score double"
    for number, shard in enumerate(tree.shards()):
        sent = spark.sparkContext.broadcast(shard)
        map_arrow(texts, _scored(sent, number), schema).write.mode("append").option(
            "compression", "zstd").parquet(path)
        sent.destroy()
    return written(spark.read.schema(schema).parquet(path).dropDuplicates(["key", "round"])
                   .groupBy("key").agg(F.max("n_tokens").alias("n_tokens"),
                                       F.sum("score").alias("score")), "scores")


def _entries(buckets: int):
    """Rows of a chunk: one per bucket of words, and one (bucket -1) with the texts' keys.

    A bucket has its words' hashes, their counts in training texts, and for each word the
    texts of the chunk that hold it, with the times.
    """
    def make(batches):
        made = 0
        for batch in batches:
            held = np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), bool)
            column, keys = batch.column("text"), batch.column("key").to_pylist()
            for first, last, data, offsets in chunks(column, CHUNK_BYTES):
                for a in range(first, last, 60_000):
                    b = min(a + 60_000, last)
                    own = offsets[a - first:b - first + 1]
                    name = f"{TaskContext.get().partitionId()}-{made}"
                    made += 1
                    yield _chunk(name, data[own[0]:own[-1]], own - own[0],
                                 held[a:b], keys[a:b], buckets)
    return make


def _chunk(chunk: str, data, offsets, held, keys, buckets: int) -> pa.RecordBatch:
    hashes, number = [], []
    column = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    for a, _, piece, at in chunks(column):
        piece = lowered(piece)
        starts, ends, of = words(piece, at)
        hashes.append(stretch_hashes(prefix_hashes(piece), starts, ends))
        number.append((of + a).astype(np.uint16))
    hashes, number = np.concatenate(hashes), np.concatenate(number)
    order = np.argsort(hashes, kind="stable")       # texts stay in order within a word
    hashes, number = hashes[order], number[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (number[1:] != number[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.concatenate([at, [len(hashes)]])).astype(np.uint32)
    hashes, number = hashes[at], number[at]
    word = np.ones(len(hashes), bool)
    word[1:] = hashes[1:] != hashes[:-1]
    word = np.flatnonzero(word)
    held_of = held[number] if len(number) else np.zeros(0, bool)
    taught = (np.add.reduceat(np.where(held_of, 0, times).astype(np.int64), word)
              if len(word) else np.zeros(0, np.int64))
    width = np.diff(np.concatenate([word, [len(hashes)]]))
    bucket = (hashes[word] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    rows = [(chunk, -1, b"".join(keys), held.astype(np.uint8).tobytes(), b"", b"", b"")]
    for k in range(buckets):
        own = by[cuts[k]:cuts[k + 1]]
        if not len(own):
            continue
        inside = np.repeat(word[own], width[own]) + (
            np.arange(int(width[own].sum())) - np.repeat(np.cumsum(width[own]) - width[own],
                                                         width[own]))
        rows.append((chunk, k, hashes[word[own]].tobytes(), taught[own].tobytes(),
                     width[own].astype(np.uint32).tobytes(), number[inside].tobytes(), times[inside].tobytes()))
    names = ["chunk", "bucket", "words", "taught", "width", "texts", "times"]
    types = [pa.string(), pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


_ENTRIES = ("chunk string, bucket int, words binary, taught binary, width binary, texts binary, "
            "times binary")


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's words and their training counts."""
    every = np.frombuffer(b"".join(rows["words"]), np.uint64)
    n = np.frombuffer(b"".join(rows["taught"]), np.int64)
    found, back = np.unique(every, return_inverse=True)
    counts = np.bincount(back, n, minlength=len(found)).astype(np.int64)
    known = counts > 0
    return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "words": [found[known].tobytes()],
                         "counts": [counts[known].tobytes()], "tokens": [int(counts.sum())],
                         "types": [int(known.sum())]})


def _met(tokens: int, types: int):
    """Per chunk: the base log10 probability and the known tokens of each text's words."""
    def meet(key, entries: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        known = (np.frombuffer(counts["words"].iloc[0], np.uint64) if len(counts)
                 else np.zeros(0, np.uint64))
        n = (np.frombuffer(counts["counts"].iloc[0], np.int64) if len(counts)
             else np.zeros(0, np.int64))
        rows = []
        for e in entries.itertuples(index=False):
            found = np.frombuffer(e.words, np.uint64)
            at = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
            c = (np.where(known[at] == found, n[at], 0) if len(known)
                 else np.zeros(len(found), np.int64))
            width = np.frombuffer(e.width, np.uint32)
            texts, times = np.frombuffer(e.texts, np.uint16), np.frombuffer(e.times, np.uint32)
            each = np.repeat(c, width)
            value = times * np.log10((each + 1) / (tokens + types + 1.0))
            size = int(texts.max()) + 1
            rows.append((e.chunk, np.bincount(texts, value, minlength=size).tobytes(),
                         np.bincount(texts, times * (each > 0), minlength=size).astype(
                             np.int64).tobytes()))
        return pd.DataFrame(rows, columns=["chunk", "sums", "known"])
    return meet


def _by_text(rows: pd.DataFrame) -> pd.DataFrame:
    """(key, base, known) of a chunk's texts, from the sums of its buckets."""
    keys = rows["keys"].dropna().iloc[0]
    n = len(keys) // 16
    base, known = np.zeros(n), np.zeros(n, np.int64)
    for sums, tokens in zip(rows["sums"], rows["known"]):
        if sums is not None:
            part = np.frombuffer(sums, np.float64)
            base[:len(part)] += part
            known[:len(part)] += np.frombuffer(tokens, np.int64)
    return pd.DataFrame({"key": [keys[16 * i:16 * i + 16] for i in range(n)],
                         "base": base, "known": known})


def base_scores(docs: DataFrame) -> tuple[DataFrame, int, int, int]:
    """((key, base, known), N, V, count of the end token): whole-token unigram with add-one.

    ``docs`` is (key, text, held_out); ``base`` leaves the end token out.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(size / 6 * 0.15 // ENTRIES))       # words, of which a share is distinct
    entries = written(map_arrow(docs, _entries(buckets), _ENTRIES), "entries")
    counts = written(entries.where("bucket >= 0").select("bucket", "words", "taught")
                     .groupBy("bucket").applyInPandas(
                         _summed, "bucket int, words binary, counts binary, tokens long, types long"),
                     "word-counts")
    ends = docs.where(~F.col("held_out")).count()
    tokens, types = counts.agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = (tokens or 0) + ends, (types or 0) + (1 if ends else 0)
    salts = int(size / buckets) // SALT_BYTES + 1
    salted = entries.where("bucket >= 0").drop("taught").withColumn(
        "salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)))
    copies = counts.select("bucket", "words", "counts", F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    sums = (salted.groupBy("bucket", "salt").cogroup(copies.groupBy("bucket", "salt"))
            .applyInPandas(_met(tokens, types), "chunk string, sums binary, known binary"))
    sums = written(sums, "chunk-sums")
    named = entries.where("bucket = -1").select(
        "chunk", F.lit(None).cast("binary").alias("sums"),
        F.lit(None).cast("binary").alias("known"), F.col("words").alias("keys"))
    found = (sums.withColumn("keys", F.lit(None).cast("binary")).unionByName(named)
             .groupBy("chunk").applyInPandas(_by_text, "key binary, base double, known long"))
    return written(found.dropDuplicates(["key"]), "base-scores"), tokens, types, ends


def score(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``docs`` has ``doc_id`` and ``text``; models learn from rows that are not ``held_out``. Null
    texts are empty; each text has an end token. ``base_score`` is the unigram's log10
    probability, ``score`` the tree's. Equal texts have equal scores, and count as often as
    they stand. With nothing to learn from, the tree is uniform over bytes and the unigram
    gives every token probability 1 (N and V are 0). Other columns are ignored; no rows, no rows.
    """
    rows = docs.select("doc_id", held_out.alias("held_out"),
                       F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    base, tokens, types, ends = base_scores(rows.select("key", "text", "held_out"))
    told = tree_scores(rows.select("key", "text"), fit(rows.where(~F.col("held_out"))))
    end = F.lit(float(np.log10((ends + 1) / (tokens + types + 1.0))))
    found = lookup(rows.select("doc_id", "held_out", "key"), told, ["key"], 72)
    return lookup(found, base, ["key"], 72).select(
        "doc_id", "held_out", "n_tokens",
        (F.coalesce("known", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.coalesce("base", F.lit(0.0)) + end).alias("base_score"), "score")
