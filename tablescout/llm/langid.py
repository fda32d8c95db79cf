"""Language identification in two levels: family first, then the language within it.

Texts become hashed counts of their letters' pairs and triples. One linear support vector
machine per family holds it against all others; within the family that wins, one machine
for each pair of its languages votes. Machines are fitted on a bounded sample: about
``SAMPLE`` labelled rows of each language, chosen by a hash of the row, so that what
reaches the driver is ``SAMPLE`` * ``DIMENSIONS`` * 4 bytes per language, whatever the
corpus. All rows are then scored where they lie.

Machines always name some language. Whether a text is of a learnt one at all is asked apart,
by the bits that a language's share of each count saves over even shares, a mean per count, so
that neither the length of a text nor the number of languages moves it. Text that is not of a
language saves less than nothing. Each language's limit comes from labelled rows kept out.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import bounded, chunks, map_arrow

SAMPLE = 600            # labelled rows of a language that are fitted on
DIMENSIONS = 2048
FOLDS = 5               # of labelled rows, each held against the shares of the others
LEAST_LETTERS = 4_000   # of labelled text that set a limit; a language of fewer rejects nothing
FEW_LETTERS = 50        # of a text, for which a limit counts half
TOGETHER = 256          # rows whose features are held at a time
UNDETERMINED = "und"

# Languages of one family are told apart by pairs; a language not listed is its own family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "indic": "hi bn ur pa gu mr ne",
    "semitic": "ar he mt am",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in itertools.chain(range(0xD800), range(0xE000, 0x323B0)):
        x = chr(c)
        if x.isalpha():
            table[c] = ord(x.lower()[0])
    return table


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x DIMENSIONS) of unit length, and the number of letters of each row."""
    out = np.zeros((len(column), DIMENSIONS), np.float32)
    letters = np.zeros(len(column), np.int64)
    for first, last, data, offsets in chunks(column):
        code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"),
                             np.uint32)
        # texts in code points: a character starts at each byte that continues none
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        at = np.minimum(at, len(code))
        low = _letters()[np.minimum(code, 0x10FFFF)]
        known = np.concatenate([[0], np.cumsum(low > 0)])
        letters[first:last] = known[at[1:]] - known[at[:-1]]
        for a, b in _spans(at):
            x = low[at[a]:at[b]].astype(np.uint64)
            number = np.repeat(np.arange(b - a), np.diff(at[a:b + 1]))
            counts = np.zeros((b - a) * DIMENSIONS)
            for size in (2, 3):
                if len(x) < size:
                    continue
                n = len(x) - size + 1
                h = np.full(n, size, np.uint64)
                some = np.zeros(n, bool)
                for k in range(size):
                    h = (h ^ x[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                    some |= x[k:k + n] > 0
                good = some & (number[:n] == number[size - 1:size - 1 + n])
                slot = number[:n][good] * DIMENSIONS + (h[good] >> np.uint64(53)).astype(np.int64)
                counts += np.bincount(slot, minlength=len(counts))
            out[first + a:first + b] = np.sqrt(counts.reshape(b - a, DIMENSIONS))
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norms, 1e-9), letters


def _spans(at: np.ndarray, most: int = 64):
    for a in range(0, len(at) - 1, most):
        yield a, min(a + most, len(at) - 1)


def _svm(x: np.ndarray, y: np.ndarray, steps: int = 200, penalty: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss.

    Accelerated gradient descent on all rows; both classes weigh the same.
    """
    biased = np.ones((len(x), x.shape[1] + 1))
    biased[:, :-1] = x
    x = biased
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w = v = np.zeros(x.shape[1])
    rate = 1 / (4 + penalty)            # rows have a squared length of 2
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (penalty * v - 2 * (x.T @ (weight * y * slack)))
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


@dataclass(frozen=True)
class LanguageModel:
    """Fitted machines: ``families`` by name, ``pairs`` by (language, language)."""

    members: Mapping[str, list[str]] = field(default_factory=dict)
    families: Mapping[str, np.ndarray] = field(default_factory=dict)
    pairs: Mapping[tuple[str, str], np.ndarray] = field(default_factory=dict)
    saved: Mapping[str, np.ndarray] = field(default_factory=dict)       # bits, by count
    limits: Mapping[str, float] = field(default_factory=dict)

    def resembling(self, x: np.ndarray, letters: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Whether each row is like a language; no if none was learnt, yes if too little was."""
        shares = x.astype(np.float64) ** 2
        like = np.array([lang in self.saved and lang not in self.limits for lang in langs], bool)
        for lang, limit in self.limits.items():
            if limit > 0:
                limit = limit * letters / (letters + FEW_LETTERS)
            like |= shares @ self.saved[lang] >= limit
        return like & (letters > 0)

    def scored(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names = sorted(self.members)
        margins = np.stack([x @ self.families[f][:-1] + self.families[f][-1] for f in names], 1)
        chance = _shares(3 * margins)
        best = chance.argmax(axis=1)
        langs = np.empty(len(x), object)
        scores = chance[np.arange(len(x)), best]
        for k, family in enumerate(names):
            own = best == k
            langs[own] = self.members[family][0]
            if not own.any() or len(self.members[family]) == 1:
                continue
            members = self.members[family]
            votes = np.zeros((own.sum(), len(members)))
            for (i, a), (j, b) in itertools.combinations(enumerate(members), 2):
                w = self.pairs[a, b]
                soft = 1 / (1 + np.exp(-4 * (x[own] @ w[:-1] + w[-1])))
                votes[:, i] += soft
                votes[:, j] += 1 - soft
            langs[own] = np.array(members, object)[votes.argmax(axis=1)]
            scores[own] *= votes.max(axis=1) / (len(members) - 1)
        return langs.tolist(), np.clip(scores, 0, 1)


def _shares(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _saved(x: np.ndarray) -> np.ndarray:
    """Bits that the rows' shares of each count save over even shares."""
    prior = 4.0     # rows
    return np.log2(((x.astype(np.float64) ** 2).sum(axis=0) * DIMENSIONS + prior)
                   / (len(x) + prior))


def _limit(x: np.ndarray) -> float:
    """Half of what all but a hundredth of the rows save under the shares of other rows."""
    fold = np.arange(len(x)) * FOLDS // len(x)      # rows are sorted, so like rows are together
    got = np.concatenate([(x[fold == k].astype(np.float64) ** 2) @ _saved(x[fold != k])
                          for k in range(FOLDS)])
    low = float(np.quantile(got, 0.01))
    return low - abs(low) / 2


def fit(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Fit on rows of ``labelled (text, lang)``; rows without either, or letters, teach nothing.

    ``sample`` bounds the rows of a language: each is taken with probability
    sample / rows of its language, decided by a hash of its text, and copies count once.
    """
    usable = labelled.where("text is not null and lang is not null").select("text", "lang")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(
        F.count("*").alias("n")).collect()}     # one row per language
    if not counts:
        return LanguageModel()
    share = F.create_map(*[x for k, n in counts.items()
                           for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    drawn = (F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)) / F.lit(1 << 30)
             < share[F.col("lang")])

    def featured(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                x, letters = _features(batch.column("text"))
                rows = [None if not n else row.astype(np.float16).tobytes()
                        for row, n in zip(x, letters)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang"), pa.array(rows, pa.binary()), pa.array(letters)],
                    names=["lang", "x", "letters"])

    got = (map_arrow(usable.where(drawn).distinct(), featured,
                     "lang string, x binary, letters long")
           .where("x is not null").orderBy("lang", "x").toPandas())
    if got.empty:
        return LanguageModel()
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(len(got), -1).astype(np.float32)
    lang, letters = got["lang"].to_numpy(), got["letters"].to_numpy()
    del got
    family = np.array([FAMILY_OF.get(v, v) for v in lang], object)
    members = {f: sorted(set(lang[family == f])) for f in set(family)}
    families = {f: _svm(x, np.where(family == f, 1, -1)) for f in members}
    pairs = {}
    for langs in members.values():
        for a, b in itertools.combinations(langs, 2):
            own = (lang == a) | (lang == b)
            pairs[a, b] = _svm(x[own], np.where(lang[own] == a, 1, -1))
    saved = {k: _saved(x[lang == k]) for k in sorted(set(lang))}
    limits = {k: _limit(x[lang == k]) for k in saved if letters[lang == k].sum() >= LEAST_LETTERS
              and (lang == k).sum() >= FOLDS}
    return LanguageModel(members, families, pairs, saved, limits)


def identify(docs: DataFrame, model: LanguageModel, resembling: str | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), which replace columns so named.

    ``resembling`` names a further column: whether the text is like a learnt language at all.

    A null or empty text, one without a letter, and every text under a model that learnt
    nothing, is ``und`` with score 0. Only ``text`` is looked at; equal texts get equal answers.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", resembling)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, like boolean")
    def judged(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            parts = [pd.DataFrame({"lang_pred": pd.Series(dtype=object),
                                   "score": pd.Series(dtype=float),
                                   "like": pd.Series(dtype=bool)})]
            for at in range(0, len(texts), TOGETHER):
                x, letters = _features(pa.array(texts.iloc[at:at + TOGETHER], pa.string()))
                none = letters == 0
                if shared.value.members:
                    langs, scores = shared.value.scored(x)
                else:
                    langs, scores = [UNDETERMINED] * len(x), np.zeros(len(x))
                parts.append(pd.DataFrame({"lang_pred": np.where(none, UNDETERMINED, langs),
                                           "score": np.where(none, 0.0, scores),
                                           "like": shared.value.resembling(x, letters, langs)}))
            yield pd.concat(parts, ignore_index=True)

    # A filter on what a deterministic function found asks it again, by other Python workers
    judged = judged.asNondeterministic()
    named = [F.col(f"`{c}`") for c in kept]
    return (bounded(docs).select(*named, judged(F.col("text")).alias("_judged"))
            .select(*named, "_judged.lang_pred", "_judged.score",
                    *([F.col("_judged.like").alias(resembling)] if resembling else [])))
