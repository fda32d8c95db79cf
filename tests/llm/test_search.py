"""Ranked search against scores of all documents."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

from tablescout.llm import search

SF = "/root/testdata/sf0.001"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def counted(text):
    return Counter(_TERM.findall((text or "").translate(_LOWER)))


def brute(docs, queries, top=20):
    found = [(name, counted(text)) for name, text in docs]
    found = [(name, c) for name, c in found if c]
    n, length = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    rows = []
    for item, text in queries:
        scored = []
        for name, c in found:
            m = 100 - 25 + 25 * c.total() * n // length
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
                        for t, times in counted(text).items() if t in c)
            if score > 0:
                scored.append((-score, name is None, name))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        rows += [(item, k + 1, name, -s) for k, (s, _, name) in enumerate(scored[:top])]
    return rows


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=repr)


def test_search(spark):
    docs, asked = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = search.search(docs, asked).collect()
    assert sorted_rows(got) == sorted_rows(brute(
        [(r["doc_id"], r["text"]) for r in docs.collect()],
        [(r["item_id"], r["text"]) for r in asked.collect()]))


def test_odd_rows(spark, monkeypatch):
    """Nulls, ties, repeats, other scripts, a very frequent term, long texts, several rounds."""
    monkeypatch.setattr(search, "QUERY_BYTES", 60)
    monkeypatch.setattr(search, "SEEDS", 2)
    monkeypatch.setattr(search, "SLICE", 50)
    docs = [(k, f"alpha beta {k % 3} Été {'gamma ' * (k % 4)}") for k in range(40)]
    docs += [(None, "alpha beta"), (None, None), (7, "alpha"), (7, "alpha"), (50, ""), (51, "..."),
             (52, "gamma " * 700), (53, "日本語 ALPHA alphA"), (54, "z" * 400 + " beta"),
             (-5, "delta")]
    asked = [(1, "alpha gamma gamma"), (2, None), (3, "?"), (1, "beta Été 2"), (None, "日本語"),
             (4, "unknown"), (5, "delta Delta alpha")]
    rows = spark.createDataFrame([(k, t, "x", 1) for k, t in docs],
                                 "doc_id long, text string, sketch string, n int").repartition(3)
    got = search.search(rows, spark.createDataFrame(
        [(k, t, 0) for k, t in asked], "item_id long, text string, query int"), top=5).collect()
    assert sorted_rows(got) == sorted_rows(brute(docs, asked, 5))


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(none, asked).collect() == []
    assert search.search(spark.createDataFrame([(1, "a")], none.schema),
                         asked.where("item_id = 2")).collect() == []


def test_bounds_hold_and_prune():
    """A sketch never gives less than a term's occurrences; few absent terms seem present."""
    rng = np.random.default_rng(5)
    docs = [Counter({b"t%d" % t: int(rng.integers(1, 400)) for t in rng.integers(0, 5000, 120)})
            for _ in range(50)]
    absent = seen = 0
    for counts in docs:
        cells = search.sketch(counts)
        words = [b"t%d" % t for t in range(5000)]
        looked = cells[search.places(words) & (len(cells) - 1)]
        for word, n in zip(words, looked):
            assert n >= min(counts[word], 255)
            absent, seen = absent + (word not in counts), seen + (word not in counts and n > 0)
    assert seen / absent <= 1 / search.SPREAD
