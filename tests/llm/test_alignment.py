"""Cross-tokenizer alignment against all pairs of tokens."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablescout.llm import alignment

SF = "/root/testdata/sf0.001"

ODD = [None, "", " ", "a", "  two  spaces ", "<|endoftext|> <s> </s> <0x41>", "▁ lower ▁ block",
       "tab\there \n new line\r\n", "naïve café 日本語のテキスト 🙂🙂 ́ end", "\x00\x01 control",
       "don't won't I'll", "one", "one", "１２３ full ﬁ ligature ① Å", "word " * 300,
       "x" * 700, "日本" * 400]


def spelled(texts):
    """(doc, ids and byte ranges of both sides), encoded whole."""
    both = alignment.Tokenizers(alignment.TOKENIZERS)
    out = []
    for text in texts:
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if (b"".join(both.bytes_a[x] for x in a) != want
                or b"".join(both.bytes_b[x] for x in b) != want):
            a, b = [], []
        ends = [np.cumsum([len(table[x]) for x in ids]).tolist()
                for ids, table in ((a, both.bytes_a), (b, both.bytes_b))]
        out.append((a, b, *ends))
    return out


def brute(texts):
    docs, links = spelled(texts), []
    for a, b, ends_a, ends_b in docs:
        spans_a, spans_b = (list(zip([0, *e], e)) for e in (ends_a, ends_b))
        links.append([(a[i], b[j]) for i, (s, e) in enumerate(spans_a)
                      for j, (t, f) in enumerate(spans_b) if s < f and t < e])
    holders = Counter(p for own in links for p in set(own))
    best = defaultdict(int)
    for (a, _), n in holders.items():
        best[a] = max(best[a], n)
    rows = []
    for (a, b, ends_a, ends_b), own in zip(docs, links):
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(t) for t, e in zip(ids, ends) if low < e <= cut)
                                   for ids, ends in ((a, ends_a), (b, ends_b))))
            low = cut
        rows.append((len(a), len(b), len(cuts), len(own),
                     sum(holders[p] == best[p[0]] for p in own), sum(holders[p] for p in own),
                     hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("piece,lot", [(1 << 16, 1 << 20), (37, 900)])
def test_alignment(spark, piece, lot):
    """Whole documents, and documents cut into many pieces."""
    given_ = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 900").select(
        "text").limit(60).collect()
    texts = ODD + [r["text"] for r in given_]
    rows = spark.createDataFrame(
        [(k if k % 9 else None, t, "clash", k) for k, t in enumerate(texts)],
        "doc_id long, text string, pairs string, row long").repartition(3)
    got = alignment.align(rows, piece=piece, lot=lot).collect()
    want = sorted((k if k % 9 else -1, *r) for k, r in enumerate(brute(texts)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *[r[c] for c in COLUMNS])
                  for r in got) == want


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none).collect() == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.align(only).collect())) == [
        (1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(1, 9))
def test_pieces_of_a_merge(a, b, size):
    """Pieces need equal work, keep shared ends whole and together are the merge."""
    last = 61
    a, b = (np.array(sorted(x | {last})) for x in (a, b))
    i, j = alignment.divide(a, b, size)
    whole = alignment.overlaps(a, b)
    found = []
    for k in range(len(i) - 1):
        work = i[k + 1] - i[k] + j[k + 1] - j[k]
        assert work <= size + 1 and (work >= size - 1 or k == len(i) - 2)
        start = max(a[i[k] - 1] if i[k] else 0, b[j[k] - 1] if j[k] else 0)
        x, y, at, shared = alignment.overlaps(a[i[k]:i[k + 1]], b[j[k]:j[k + 1]], start)
        found.append(np.stack([x + i[k], y + j[k], at, shared]))
    assert (np.concatenate(found, 1) == np.stack(whole)).all()
