"""The queries on a whole small table against brute force."""

import collections
import contextlib
import hashlib
import math
import os
import re
import threading
import zlib

import numpy as np
import pytest
from brute import linked, removed
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tablescout.llm import suffixes

SF = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def rows(spark, name):
    return QUERIES[name](spark, SF).toPandas()


def near_pairs(sets):
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    common = collections.Counter((a, b) for h in holders.values()
                                 for i, a in enumerate(h) for b in h[i + 1:])
    return [p for p, n in common.items()
            if 100 * n >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]


def shingle_set(text):
    w = words(text)
    return ({tuple(w)} if w else set()) if len(w) < 5 else {
        tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_language_of_held_out_documents(spark, docs):
    got = rows(spark, "op1_language_id").merge(docs, on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.98
    assert all(got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id])
    assert got.score.between(0, 1).all()


def test_near_duplicates(spark, docs):
    got = rows(spark, "op2_near_duplicates").set_index("doc_id")
    sets = {d: shingle_set(t) for d, t in zip(docs.doc_id, docs.text)}
    want = linked(sets, near_pairs(sets))
    assert {d: len(s) for d, s in sets.items()} == got.n_shingles.to_dict()
    assert want == got.component_id.to_dict()
    assert all(got.kept == (got.index == got.component_id))


def left(text, spans):
    out, at = b"", 0
    for a, b in spans:
        out, at = out + text[at:a], b
    return out + text[at:]


@pytest.mark.parametrize("most", [suffixes.MOST, 2])
def test_repeated_passages(spark, docs, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST", most)
    got = rows(spark, "op3_repeated_passages").set_index("doc_id")
    texts = [(t or "").encode() for t in docs.text]
    for d, t, spans in zip(docs.doc_id, texts, removed(texts)):
        kept = left(t, spans)
        r = got.loc[d]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(t), len(t) - len(kept), len(spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_decontamination_finds_what_holds_an_item(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    got = rows(spark, "op4_decontamination").set_index("doc_id").contaminated

    def grams(t, k=8):
        w = re.findall(r"[^\W\d_]+|\d+", t.lower())
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    asked = set().union(*map(grams, items.text))
    for d, t in zip(docs.doc_id, docs.text):
        if any(i.strip() in t for i in items.text):
            assert got[d]
        elif not grams(t) & asked:
            assert not got[d]


@pytest.mark.xfail(reason="open: 0.887 with the 200 labels of this table, 0.9997 with ten times as many")
def test_quality_of_labels_not_learnt_from(spark):
    from tablescout.llm import cotrain
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = cotrain.fit(docs, labels.where("doc_id % 2 = 0"))
    got = cotrain.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    rank, y = got.score.rank(), got.quality
    area = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert area > 0.97


def test_main_text_is_that_of_the_article(spark):
    import html
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    got = rows(spark, "op6_main_text").set_index("page_id")
    for page, source in zip(pages.page_id, pages.html):
        article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split())
                  for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got.text[page] == want and got.n_chars[page] == len(want)


def test_licences(spark, docs):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl",
               ("all", "rights", "reserved"): "reserved"}
    got = rows(spark, "op7_licenses").set_index("doc_id")
    for d, t in zip(docs.doc_id, docs.text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        places = [(i, label) for p, label in phrases.items() for i in range(len(w) - len(p) + 1)
                  if tuple(w[i:i + len(p)]) == p]
        r = got.loc[d]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        if places:
            assert (r.first_word, r.last_word) == (min(places)[0], max(places)[0])
        else:
            assert math.isnan(r.first_word) and math.isnan(r.last_word)


def test_mixture(spark, docs):
    got = rows(spark, "op8_mixture")
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in zip(docs.doc_id, docs.text)}
    assert got.set_index("doc_id")["size"].to_dict() == sizes
    by = got.groupby("source").agg(n=("size", "sum"), target=("target", "first"),
                                   taken=("taken", "sum"))
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(by.index))}
    want, free = {}, set(by.index)
    while True:
        level = (by.n.sum() - sum(want.values())) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 3 * by.n[s]}
        if not over:
            break
        want |= {s: 3 * by.n[s] for s in over}
        free -= over
    want |= {s: weights[s] * level for s in free}
    for s in by.index:
        assert by.target[s] == pytest.approx(want[s])
        assert abs(by.taken[s] - want[s]) <= 1
    assert (got.taken <= 3 * got["size"]).all()
    again = rows(spark, "op8_mixture")
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, again.to_numpy().tolist()))


def test_language_model(spark, docs):
    got = rows(spark, "op9_suffix_tree").set_index("doc_id")
    tokens = {d: [*words(t), None] for d, t in zip(docs.doc_id, docs.text)}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    count = collections.Counter(w for d, t in tokens.items() if not held[d] for w in t)
    total, kinds = sum(count.values()), len(count)
    for d, t in tokens.items():
        r = got.loc[d]
        base = sum(math.log10((count[w] + 1) / (total + 1 * (kinds + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[d], len(t), total)
        assert r.n_known == sum(count[w] > 0 for w in t)
        assert r.base_score == pytest.approx(base)
    # The unigram gives an unknown word a probability, but no spelling; the tree spells it.
    out = got[got.held_out]
    spelt = sum(len(w.encode()) * math.log10(1 / 256) for d in out.index
                for w in tokens[d] if w is not None and not count[w])
    assert out.score.sum() > out.base_score.sum() + spelt


def test_near_vectors(spark):
    """The given vectors, with near copies of a hundred of them added."""
    from pyspark.sql import functions as F

    from tablescout.llm import pq
    given = spark.read.parquet(f"{SF}/embeddings.parquet")
    moved = F.transform("embedding", lambda v, i: (
        v + (F.pmod(F.xxhash64("vec_id", i), F.lit(1000)) / 1000 - 0.5) * 0.12).cast("float"))
    near = given.where("vec_id < 100").withColumn("embedding", moved)
    every = given.unionByName(near.withColumn("vec_id", F.col("vec_id") + 10_000))
    every = every.unionByName(given.where("vec_id < 20").withColumn(
        "vec_id", F.col("vec_id") + 20_000))
    got = pq.near_vectors(every).toPandas().set_index("vec_id")
    table = every.toPandas()
    x = np.array(table.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = (x @ x.T >= 0.93) & (table.label.values[:, None] == table.label.values[None])
    np.fill_diagonal(close, False)
    ids = table.vec_id.tolist()
    assert close.sum() > 100
    want = linked(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(close))])
    assert got.component_id.to_dict() == want
    assert got.n_links.to_dict() == dict(zip(ids, close.sum(1).tolist()))


def _vectors(spark, groups, width, kind="float", seed=3):
    """Random vectors of a few labels and near copies of some; (id, label, vector)."""
    rng = np.random.default_rng(seed)
    made = []
    for label, n, near in groups:
        x = rng.normal(size=(n, width))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = x[rng.integers(0, 3, near)] + rng.normal(size=(near, width)) * 0.22 / width ** 0.5
        x = np.concatenate([x, y, x[:2], x[:2] * 2])
        made += [(label, v.astype(np.float32 if kind == "float" else float).tolist()) for v in x]
    rows = [(i, v, label) for i, (label, v) in enumerate(made)]
    return rows, spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label string")


@pytest.mark.parametrize("kind, dense", [("float", 16), ("double", 1), ("float", 1 << 30)])
def test_near_vectors_in_rounds(spark, monkeypatch, kind, dense):
    """Many parts, rounds, segments and tiles give what all pairs give, in either ranking."""
    from tablescout.llm import pq
    for name, value in {"PART_BYTES": 6000, "PART_ROWS": 20, "ROUND_BYTES": 15_000, "SEGMENT": 16,
                        "TILE": 24, "DENSE": dense}.items():
        monkeypatch.setattr(pq, name, value)
    rows, table = _vectors(spark, [("a", 150, 200), ("b", 60, 30), ("c", 3, 0)], 12, kind)
    short, other = _vectors(spark, [("a", 20, 20)], 5, kind, seed=4)
    rows += [(i + 10_000, v, label) for i, v, label in short]
    table = table.unionByName(other.withColumn("vec_id", F.col("vec_id") + 10_000))
    got = pq.near_vectors(table.repartition(5)).toPandas().set_index("vec_id")
    links = collections.Counter()
    pairs = []
    for i, v, a in rows:
        for j, w, b in rows:
            if i < j and a == b and len(v) == len(w):
                if np.dot(v, w) >= 0.93 * np.linalg.norm(v) * np.linalg.norm(w):
                    pairs.append((i, j))
                    links.update((i, j))
    assert len(pairs) > 5000
    assert got.n_links.to_dict() == {i: links[i] for i, _, _ in rows}
    assert got.component_id.to_dict() == linked([i for i, _, _ in rows], pairs)


def test_near_vectors_are_not_copied_to_the_lists_they_probe(spark, monkeypatch):
    """What is shuffled stays in proportion to the vectors, whatever the lists probed."""
    from tablescout.llm import pq
    monkeypatch.setattr(pq, "LIST_ROWS", 60)
    _, table = _vectors(spark, [("a", 3000, 0)], 64)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [str(d) for d in manager.localDirs()]

    def held():
        total = 0
        for folder in folders:
            for at, _, names in os.walk(folder):
                for name in names:
                    with contextlib.suppress(FileNotFoundError):
                        total += os.path.getsize(f"{at}/{name}")
        return total
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)      # else equal bytes lie side by side
    before, seen, done = held(), [0], threading.Event()
    watch = threading.Thread(target=lambda: [seen.append(held()) for _ in iter(
        lambda: done.wait(0.05), True)])
    watch.start()
    try:
        assert pq.near_vectors(table).where("n_links > 0").count() == 6
    finally:
        done.set()
        watch.join()
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert max(seen) - before < 6 * 3000 * 64 * 4
