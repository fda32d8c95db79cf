"""Document quality by co-training two views.

One classifier sees the text (hashed words, and how it is written), one only the metadata
(source, language, length). Both start from the labelled documents. In each round either
scores a pool of unlabelled documents, and those it is surest of become labels for the other.
Each view is then calibrated on labelled documents kept aside, and every document gets the
two calibrated chances, combined.

Only a bounded sample is fitted on: about ``LABELLED`` labelled documents and ``POOL`` others,
chosen by a hash of their ids. All documents are scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import settle
from .text import bounded, chunks, lookup, word_hashes, words

LABELLED, POOL = 4000, 8000
ROUNDS, SURE, EACH = 4, 0.95, 0.05      # a round adds at most EACH of the pool per class
WORDS, NAMES = 512, 64

_CLASS = np.zeros(256, np.int64)
for _chars, _kind in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2),
                      ("0123456789", 3), (" ", 4), ("\n", 5), (".,;:!?'\"()-", 6)):
    _CLASS[[ord(c) for c in _chars]] = _kind
_CLASS[128:] = 7
_KINDS = 8
TEXT = WORDS + _KINDS + 6
META = 2 * NAMES + 2


def text_view(column: pa.Array) -> np.ndarray:
    """Hashed word counts, shares of kinds of characters, and repetition, of each text."""
    out = np.zeros((len(column), TEXT), np.float32)
    for first, last, data, offsets in chunks(column):
        n = last - first
        sizes = np.maximum(np.diff(offsets), 1)
        starts, ends, number = words(data, offsets)
        counts = np.maximum(np.bincount(number, minlength=n), 1)
        hashes = word_hashes(data, starts, ends)
        slot = number * WORDS + (hashes >> np.uint64(55)).astype(np.int64)
        for a in range(0, n, 256):
            b = min(a + 256, n)
            own = (number >= a) & (number < b)
            some = np.bincount(slot[own] - a * WORDS, minlength=(b - a) * WORDS)
            some = np.sqrt(some.reshape(b - a, WORDS) / counts[a:b, None])
            out[first + a:first + b, :WORDS] = some
            lo, hi = offsets[a], offsets[b]
            text = np.repeat(np.arange(b - a), np.diff(offsets[a:b + 1]))
            kinds = np.bincount(text * _KINDS + _CLASS[data[lo:hi]], minlength=(b - a) * _KINDS)
            out[first + a:first + b, WORDS:WORDS + _KINDS] = (
                kinds.reshape(b - a, _KINDS) / sizes[a:b, None])
        distinct = np.zeros(n)
        if len(number):
            order = np.lexsort((hashes, number))
            h, t = hashes[order], number[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
            distinct = np.bincount(t[new], minlength=n)
        same = np.zeros(n)
        if len(number) > 1:
            again = (hashes[1:] == hashes[:-1]) & (number[1:] == number[:-1])
            same = np.bincount(number[1:][again], minlength=n)
        lengths = np.bincount(number, ends - starts, minlength=n) / counts
        out[first:last, WORDS + _KINDS:] = np.stack([
            np.log1p(counts) / 10, distinct / counts, same / counts, lengths / 10,
            np.log1p(sizes) / 12, (np.diff(offsets) == 0)], 1)
    return out


def meta_view(source: pd.Series, lang: pd.Series, size: pd.Series) -> np.ndarray:
    """Hashed source and language, and the length."""
    out = np.zeros((len(source), META), np.float32)
    rows = np.arange(len(source))
    for k, column in enumerate((source, lang)):
        slot = pd.util.hash_array(column.fillna("").astype(str).to_numpy(object)) % NAMES
        out[rows, k * NAMES + slot.astype(np.int64)] = 1
    length = np.log1p(size.fillna(0).clip(lower=0).to_numpy(float))
    out[:, -2] = length / 10
    out[:, -1] = (length / 10) ** 2
    return out


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights, bias last, of a logistic regression whose classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1))
    rate = 4 / max((x ** 2).sum(1).max(), 1)
    w = v = np.zeros(x.shape[1])
    for t in range(steps):
        p = 1 / (1 + np.exp(-x @ v))
        new = v - rate * (x.T @ (weight * (p - y)) + penalty * v)
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def _margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass(frozen=True)
class QualityModel:
    """Weights, means and scales of both views, their calibrations, and the prior log-odds."""

    scale: tuple = ()
    weights: tuple = ()
    calibration: tuple = ()
    prior: float = 0.0

    def chances(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the text, of the metadata, and combined."""
        if not self.weights:
            half = np.full(len(views[0]), 0.5)
            return half, half, half
        odds = [np.clip(a * _margin((x - m) / s, w) + b, -12, 12) for x, (m, s), w, (a, b) in zip(
            views, self.scale, self.weights, self.calibration)]
        return tuple(1 / (1 + np.exp(-o)) for o in (*odds, odds[0] + odds[1] - self.prior))


def _featured(docs: DataFrame) -> pd.DataFrame:
    def made(batches):
        for batch in batches:
            for at in range(0, len(batch), 512):
                b = batch.iloc[at:at + 512]
                t = text_view(pa.array(b["text"], pa.string())).astype(np.float16)
                m = meta_view(b["source"], b["lang"], b["n_chars"]).astype(np.float16)
                yield pd.DataFrame({"t": [r.tobytes() for r in t], "m": [r.tobytes() for r in m],
                                    "y": b["y"].to_numpy(float)})
    return docs.select("text", "source", "lang", "n_chars", "y").mapInPandas(
        made, "t binary, m binary, y double").orderBy("t", "m", "y").toPandas()


def _drawn(rate: float, salt: int):
    """Each row for itself, so that rows of one id, or of none, are not drawn together."""
    return F.rand(salt) < min(1.0, rate)


def _metadata(docs: DataFrame) -> DataFrame:
    """The columns that are looked at; those that ``docs`` lacks are null."""
    kinds = {"source": "string", "lang": "string", "n_chars": "double"}
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *[
        (F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c)
        for c, k in kinds.items()])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL,
        rounds: int = ROUNDS) -> QualityModel:
    """Co-train on ``docs`` with ``labels (doc_id, quality)``.

    Null ids and labels teach nothing; of several labels of an id the mean decides (a half is
    good). Without documents of both classes the model gives 0.5 to all.
    """
    known = settle(labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
                   .agg((F.avg("quality") >= 0.5).cast("double").alias("y")))
    n = max(lookup(docs.select("doc_id"), known, ["doc_id"], 24, "inner").count(), 1)
    rows = _metadata(docs)
    a = _featured(lookup(rows.where(_drawn(labelled / n, 3)), known, ["doc_id"], 24, "inner"))
    others = max(docs.count(), 1)
    b = _featured(lookup(rows.where(_drawn(pool / others, 4)), known, ["doc_id"], 24, "left_anti")
                  .withColumn("y", F.lit(-1.0)))
    if a.empty or a["y"].nunique() < 2:
        return QualityModel()

    def views(frame):
        return [np.frombuffer(b"".join(frame[c]), np.float16).reshape(-1, size).astype(float)
                for c, size in (("t", TEXT), ("m", META))]

    y = a["y"].to_numpy()
    seen, free = views(a), views(b)
    scale = [(x.mean(0), x.std(0) + 0.05) for x in seen]
    seen = [(x - m) / s for x, (m, s) in zip(seen, scale)]
    free = [(x - m) / s for x, (m, s) in zip(free, scale)]
    aside = np.arange(len(y)) % 5 == 0
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside = np.zeros(len(y), bool)
    kept = np.ones(len(y), bool) if not aside.any() else aside
    x, target = [v[~aside] for v in seen], [y[~aside], y[~aside]]
    weights = [_logistic(v, t) for v, t in zip(x, target)]
    taken = [np.zeros(len(free[0]), bool) for _ in free]
    share = y.mean()
    for _ in range(rounds if len(free[0]) else 0):
        # a view is as sure as it is right on the documents kept aside
        chance = []
        for v, u, w in zip(seen, free, weights):
            slope, offset = _platt(_margin(v[kept], w), y[kept])
            chance.append(1 / (1 + np.exp(-np.clip(slope * _margin(u, w) + offset, -30, 30))))
        for view in (0, 1):
            to = 1 - view
            for good, part in ((1.0, share), (0.0, 1 - share)):
                c = chance[view] if good else 1 - chance[view]
                most = int(EACH * len(c) * part) + 1
                sure = np.flatnonzero((c >= SURE) & ~taken[to])
                sure = sure[np.argsort(-c[sure], kind="stable")][:most]
                taken[to][sure] = True
                x[to] = np.vstack([x[to], free[to][sure]])
                target[to] = np.concatenate([target[to], np.full(len(sure), good)])
        weights = [_logistic(v, t) for v, t in zip(x, target)]
    calibration = []
    for v, w in zip(seen, weights):
        c = _platt(_margin(v[kept], w), y[kept])
        calibration.append(c)
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    return QualityModel(tuple(scale), tuple(weights), tuple(calibration), prior)


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a margin's log-odds, by Newton's method with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        h = p * (1 - p) + 1e-6
        g = np.array([((p - y) * margin).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        m = np.array([[(h * margin ** 2).sum() + 1e-2, (h * margin).sum()],
                      [(h * margin).sum(), h.sum() + 1e-2]])
        step = np.linalg.solve(m, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return max(a, 0.0), b


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with ``text_score``, ``meta_score`` and ``score``, all 0 to 1; replaced if there.

    ``docs`` has ``doc_id`` and ``text``, and ``source``, ``lang``, ``n_chars`` as far as it has
    them. Null or empty texts and null metadata are values like others. Each row stands for
    itself. A model without both classes gives 0.5.
    """
    added = ["text_score", "meta_score", "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("text_score double, meta_score double, score double")
    def scored(series: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]],
               ) -> Iterator[pd.DataFrame]:
        for text, source, lang, size in series:
            parts = []
            for at in range(0, len(text), 512):
                s = slice(at, at + 512)
                views = [text_view(pa.array(text[s], pa.string())).astype(float),
                         meta_view(source[s], lang[s], size[s]).astype(float)]
                parts.append(np.stack(shared.value.chances(views), 1))
            yield pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, 3)),
                               columns=added)

    kinds = {"source": "string", "lang": "string", "n_chars": "double"}
    meta = [(F.col(c) if c in docs.columns else F.lit(None)).cast(k) for c, k in kinds.items()]
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    return (bounded(docs).select(*columns, scored(F.col("text"), *meta).alias("_quality"))
            .select(*columns, "_quality.*"))
