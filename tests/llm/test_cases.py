"""Nulls, empty and very long texts, ties and repeated rows, empty tables, clashing columns."""

import collections
import math
import re

import pytest
from brute import linked, removed
from pyspark.sql import functions as F

import corpus_pipeline
from tablescout.llm import (cotrain, decontaminate, htmltext, langid, licenses, minhash, mixing,
                            pq, suffixes, suffixtree)

LONG = " ".join(f"word{i % 997} and the {i}" for i in range(60_000))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "key string, node string, spans string, size string, hash long, kept boolean")
TEXTS = [(1, "the cat sat on the mat and was happy with all of the things that it had there", "en"),
         (2, "der hund und die katze sind nicht mit dem mann in das haus gegangen heute", "de"),
         (3, "the cat sat on the mat and was happy with all of the things that it had there", "en"),
         (3, "the cat sat on the mat and was happy with all of the things that it had there", "en"),
         (4, None, None), (5, "", "en"), (6, " \n\t", None), (7, "12 34 !!", "de"),
         (None, "a text of a row without any id that stands alone here", None),
         (8, LONG, "en"), (9, "Ünïcödé 漢字 😀 text", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [(d, t, lang, "s" if (d or 0) % 2 else None, None if t is None else len(t),
          "k", "n", "x", "z", 5, None) for d, t, lang in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(spark, docs, empty):
    model = langid.fit(docs)
    got = {r["text"]: r for r in langid.identify(docs, model).collect()}
    assert got[None]["lang_pred"] == got[""]["lang_pred"] == got["12 34 !!"]["lang_pred"] == "und"
    assert got[None]["score"] == 0 and 0 < got[LONG]["score"] <= 1
    assert langid.identify(docs, model).columns == [*docs.columns, "lang_pred", "score"]
    nothing = langid.fit(empty)
    assert langid.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_near_duplicates(docs, empty):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["component_id"] == 1 and not by[3]["kept"] and by[1]["kept"]
    for blank in (4, 5, 6):
        assert (by[blank]["n_shingles"], by[blank]["component_id"]) == (0, blank)
        assert by[blank]["kept"]
    assert by[7]["n_shingles"] == 1
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_group_go_block_by_block(spark, monkeypatch):
    """A chain of texts each near the next, none near all: links across components count."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "SPAN", 4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(24):
        for j in range(3):
            text = [f"x{k}.{i}" if i < 2 * k else w for i, w in enumerate(base)]
            rows.append((100 * k + j, " ".join([*text, f"tail{j}"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}

    def grams(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    sets = {d: grams(t) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b])
             >= 75 * len(sets[a] | sets[b])]
    assert got == linked(sets, links)


def test_repeated_passages(spark, docs, empty):
    got = suffixes.remove_repeats(docs)
    assert got.columns == [c for c in docs.columns if c not in ("kept",)] + ["kept", "removed"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert bytes(by[4]["kept"]) == b"" and by[4]["removed"] == []
    assert bytes(by[9]["kept"]).decode() == TEXTS[-1][1]
    assert suffixes.remove_repeats(empty).count() == 0
    passage = "é" * 10 + " ".join(f"p{i}" for i in range(60))       # repeats in one text and others
    rows = [(1, "start " + passage + " middle " + passage), (2, passage[:150]),
            (3, passage + " other"), (4, "z" * 500), (5, "q" * 199)]
    found = {r["doc_id"]: r["removed"] for r in suffixes.remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dict(zip(found, removed([t.encode() for _, t in rows])))
    assert {d: [list(x) for x in s] for d, s in found.items()} == want
    assert len(want[1]) == 2 and not want[2] and not want[5]
    assert [tuple(s) for s in found[4]] == [(0, 500)]


def test_long_texts_are_screened_by_segments(spark, monkeypatch):
    unit = "".join(chr(97 + (i * i * 31 + i * 7) % 26) for i in range(5000))
    body = "".join(f"{unit[i % 4000:i % 4000 + 37]}{i}" for i in range(60_000))
    repeat = body[1_000_000:1_000_300]
    rows = [(1, body), (2, "before " + repeat + " after")]
    found = {r["doc_id"]: [tuple(s) for s in r["removed"]] for r in suffixes.remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (7, 307) == found[2][0]
    assert any(a <= 1_000_000 and b >= 1_000_300 for a, b in found[1])


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame(
        [(1, "If Anna has 12 apples and gives 5 apples to Bert, how many apples has Anna left?"),
         (2, None), (3, ""), (4, "7 8 9")], "item_id long, text string")
    again = ("Well, if Carla has 30 apples and gives 9 apples to Dora, how many apples has Carla "
             "left? ok")
    broken = "If Anna has 12 apples and gives 12 apples to Anna, how many apples has Carla left?"
    more = spark.createDataFrame(
        [(1, again), (2, broken), (3, None), (4, "nothing of it"), (4, "nothing of it"),
         (None, again)], "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    got = decontaminate.contaminated(more, items).collect()
    assert [(r["doc_id"], r["contaminated"]) for r in got if r["text"] == again] == [
        (1, True), (None, True)]
    assert not any(r["contaminated"] for r in got if r["text"] != again)
    assert decontaminate.contaminated(docs, items).count() == len(TEXTS)
    assert decontaminate.contaminated(empty, items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contaminated(
        more, items.where("false")).collect())


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (8, None)],
                                   "doc_id long, quality int")
    got = cotrain.score(docs, cotrain.fit(docs, labels)).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    plain = cotrain.fit(docs, labels.where("false"))
    assert {r["score"] for r in cotrain.score(docs.select("doc_id", "text"), plain).collect()} == {0.5}
    assert cotrain.score(empty, plain).count() == 0


def test_main_text(spark):
    page = ("<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav>"
            "<article><h1>Title &amp; more</h1><p>One  two<br>three.<p>Four &copy; five.</article>"
            "<div class=comments><p>First!</p></div><footer>end</footer>")
    rows = [(k, "u", page, "old") for k in range(40)] + [
        (50, None, None, "old"), (51, "u", "", "old"), (52, "u", "<p>x" * 20_000, "old"),
        (53, "u", "no markup at all < or >", "old"), (54, "u", "<<<a '\"", "old")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages, htmltext.fit(pages)).collect()}
    assert got[0] == "Title & more\nOne two three.\nFour © five."
    assert got[50] == got[51] == "" and len(got) == 45
    none = pages.where("false")
    assert htmltext.fit(none) is None and htmltext.extract(none, None).count() == 0


def test_decoding_keeps_nothing_below_what_it_rejects():
    import numpy as np
    page = htmltext.parse("<body><div><p>a</p><div><p>b</p></div></div></body>")
    rng = np.random.default_rng(1)
    for _ in range(50):
        kept = htmltext.decode(page, rng.normal(size=len(page.tags)) * 3)
        assert all(kept[p] or not kept[i] for i, p in enumerate(page.parents) if i)


def test_licences(spark, docs, empty):
    more = spark.createDataFrame(
        [(1, "Released under the MIT License."), (2, "CC BY, cc-by; CC BY cc"), (3, None),
         (4, "all rights " * 3 + "reserved all Rights RESERVED")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(more).collect()}
    assert got[1]["labels"] == "mit" and got[1]["score"] == 1.0 and got[1]["n_base"] == 0
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (3, 0, 4)
    assert (got[3]["n_words"], got[3]["first_word"], got[3]["labels"]) == (0, None, "")
    assert (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"]) == (2, 4, 7)
    assert licenses.scan(docs).count() == len(TEXTS) and licenses.scan(empty).count() == 0


def test_mixture(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for source in ("s", None):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(
        sum(r["size"] for r in got))
    assert mixing.mix(empty).count() == 0


def test_language_model(docs, empty):
    from pyspark.sql import functions as F
    got = suffixtree.score(docs, F.lit(False)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(TEXTS) and by[4]["n_tokens"] == by[5]["n_tokens"] == 1
    assert by[4]["score"] == by[6]["score"] < 0
    assert all(r["n_known"] == r["n_tokens"] for r in got)
    assert suffixtree.score(empty, F.lit(False)).count() == 0
    unlearnt = suffixtree.score(docs, F.lit(True)).collect()
    assert {r["n_known"] for r in unlearnt} == {0}


@pytest.mark.parametrize("entries", [400_000, 1])
def test_base_scores_of_odd_rows(spark, docs, monkeypatch, entries):
    """The unigram is (c + 1) / (N + V + 1) over words and one end, in one bucket or many."""
    monkeypatch.setattr(suffixtree, "ENTRIES", entries)
    odd = [(20, "A\u00a0b C\x0bc\x85 É é"), (21, "a\u2028B\x00 \x1c x"), (22, "a b a b c"),
           (23, "THE the The"), (None, "nobody"), (22, "a b a b c")]
    rows = [(d, t) for d, t, _ in TEXTS if t is not LONG] + odd
    held = {1, 3, 5, 22}
    got = suffixtree.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
                           F.coalesce(F.col("doc_id").isin(held), F.lit(False))).collect()

    def tokens(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]
    count = collections.Counter(w for d, t in rows if d not in held for w in tokens(t))
    total, kinds = sum(count.values()), len(count)
    want = sorted((d or 0, d in held, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), total,
                   sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in tokens(t)))
                  for d, t in rows)
    found = sorted((r["doc_id"] or 0, *r[1:6]) for r in got)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert [r[5] for r in found] == pytest.approx([r[5] for r in want])


def test_long_texts_are_scored_as_one(spark):
    """Segments side by side give the sum over a walk of the whole text."""
    import numpy as np
    text = LONG[:5000]
    tree = suffixtree.fit(spark.createDataFrame([(LONG,)], "text string"))
    data = np.frombuffer(text.encode(), np.uint8)
    out, begin, _ = suffixtree._stream(data, np.array([0, len(data)]))
    state, total = tree.start, 0.0
    for symbol in out:
        total += float(tree.log[state, symbol])
        state = tree.step[state, symbol]
    assert suffixtree._scores(tree, out, begin)[0] == pytest.approx(total)
    assert np.allclose((10.0 ** tree.log.astype(float)).sum(1), 1, atol=1e-4)


def _by_hand(train, texts, divergence):
    """Scores of a suffix tree kept in dictionaries, and its contexts."""
    depth = suffixtree.DEPTH

    def symbols(text):
        return b" ".join(w.lower() for w in text.encode().split()) + b"\n"

    def places(text):
        data = b"\n" * depth + symbols(text)
        return [(data[i - depth:i], data[i]) for i in range(depth, len(data))]
    count = collections.defaultdict(collections.Counter)
    for text in train:
        for before, symbol in places(text):
            for d in range(depth + 1):
                count[before[depth - d:]][symbol] += 1
    total = {c: sum(n.values()) for c, n in count.items()}
    kept = {b""}
    for c, n in count.items():
        if c and sum(k * math.log(k * total[c[1:]] / (total[c] * count[c[1:]][x]))
                     for x, k in n.items()) >= divergence:
            kept |= {c[i:] for i in range(len(c))}

    def chance(c, x):
        above = chance(c[1:], x) if c else 1 / 256
        return ((count[c][x] + suffixtree.PRIOR * above) / (total[c] + suffixtree.PRIOR)
                if c in kept else above)
    return [sum(math.log10(chance(b, x)) for b, x in places(t)) for t in texts], kept


@pytest.mark.parametrize("pairs, lump", [(3_000_000, 500_000), (40, 30)])
def test_the_tree_is_whole(spark, monkeypatch, pairs, lump):
    """All contexts that the divergence keeps, however long or rare, in one round or many."""
    monkeypatch.setattr(suffixtree, "ROUND_PAIRS", pairs)
    monkeypatch.setattr(suffixtree, "LUMP", lump)
    monkeypatch.setattr(suffixtree, "MOST_GRAMS", 200)
    train = [t for _, t, _ in TEXTS if t and t is not LONG] * 3 + [LONG[:4000]] * 2
    for i, first in enumerate("a e i o u the he \u00fc \u6f22 of".split()):
        train += [f"{first}statement{i} {first}stated of {first}state{9 - i} over{first}state"] * 25
    texts = [*train, "antidisestablishmentarian never seen 99", "", "word17 \u6f22\u5b57 word1"]
    want, kept = _by_hand(train, texts, suffixtree.DIVERGENCE)
    assert sum(len(c) > 4 for c in kept) > 25
    rows = [(i, t, i >= len(train)) for i, t in enumerate(texts)]
    got = suffixtree.score(spark.createDataFrame(rows, "doc_id long, text string, h boolean")
                           .repartition(3), F.col("h")).collect()
    assert [r["score"] for r in sorted(got, key=lambda r: r["doc_id"])] == pytest.approx(want, rel=1e-5)


def test_a_larger_corpus_drops_no_context(spark):
    """What forty texts teach stays, beside millions of bytes of another kind."""
    rare = "zqxjk vwqzx kjqvz xqwzk"
    rows = [(0, rare, True)] + [(1, rare, False)] * 40
    more = [(2, "0123456789 " * 30_000, False)] * 10
    few, many = (suffixtree.score(spark.createDataFrame(
        r, "doc_id long, text string, h boolean"), F.col("h")).where("held_out").first()["score"]
        for r in (rows, rows + more))
    assert few > -2 and many > -6


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1, "x"), (2, [2.0, 0.1], 1, "x"), (2, [2.0, 0.1], 1, "x"),
            (3, [1.0, 0.0], 2, "x"), (4, None, 1, "x"), (5, [0.0, 0.0], 1, "x"),
            (6, [float("nan"), 1.0], 1, "x"), (7, [None, 1.0], 1, "x"), (8, [1.0, 0.0], None, "x"),
            (9, [], 1, "x"), (10, [1.0, 0.0, 0.0], 1, "x"), (11, [float("inf"), 1.0], 1, "x"),
            (None, [5.0, 0.0], 1, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")
    got = pq.near_vectors(table).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    assert by[1] == (3, 1) and by[2] == (3, 1) and by[None] == (3, 1)
    for alone in (3, 4, 5, 6, 7, 8, 9, 10, 11):
        assert by[alone] == (0, alone)
    assert pq.near_vectors(table.where("false")).count() == 0


def test_stages_keep_the_columns_and_clean_documents(spark, tmp_path):
    import duckdb
    duckdb.sql("copy (select 1::bigint item_id, 'one two three four five six seven eight nine ten' "
               f"as text) to '{tmp_path}/benchmark.parquet'")
    en = "the quick brown fox of the north jumps over a lazy dog in the garden number {} today"
    rows = [(i, en.format(f"w{i} x{i} y{i} z{i} v{i} u{i}"), "en", "a", 1) for i in range(30)] + [
        (100, "1234 5678", "en", "a", 1), (101, None, "en", "b", 1),
        (102, "so one two three four five six seven eight nine ten yes", None, "b", 1),
        (103, en.format("w1 x1 y1 z1 v1 u1"), None, "b", 1)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [{r["doc_id"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append({r["doc_id"] for r in docs.collect()})
    assert kept[0] - kept[1] == {100, 101}
    assert kept[1] - kept[2] == {103}
    assert kept[2] == kept[3] and kept[3] - kept[4] == {102}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 30


def test_one_row_of_each_group_stays_among_equal_and_missing_ids(spark, tmp_path):
    """Repeated rows and copies without ids leave one row, whose text the next stage keeps."""
    def text(k):
        return " ".join(f"{k}w{i * i}" for i in range(80))
    rows = [(1, text("a"), "s"), (1, text("a"), "s"), (None, text("b"), "s"),
            (None, text("b"), "s"), (None, text("c"), "s"), (7, text("c") + " more", "s"),
            (5, text("d"), "s"), (5, text("e"), "s"), (6, text("e"), "s"), (8, None, "s"),
            (8, None, "s"), (None, text("f"), "s"), (9, text("g"), "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.one_of_each(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    kept = sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect())))
    assert kept == sorted(map(str, [
        (1, text("a")), (None, text("b")), (7, text("c") + " more"), (5, text("d")),
        (5, text("e")), (8, None), (8, None), (None, text("f")), (9, text("g"))]))
    left = spark.createDataFrame(got.collect(), got.schema)
    cut = corpus_pipeline.without_repeats(spark, left, str(tmp_path)).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in cut))) == kept


def test_text_of_no_learnt_language_goes(spark, tmp_path):
    other = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
             "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
             "Все люди рождаются свободными и равными в своем достоинстве и правах",
             "xqzv kjwpf zzqxk vbnmq wrtpl kkjhg qwxzv plmkn bvcxz jkqwz xvzqj hgfdk"]
    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "text", "lang")
    more = spark.createDataFrame([(-k - 1, t, None) for k, t in enumerate(other)], own.schema)
    for learnt in (own, own.where("lang = 'en'")):      # four languages, and one
        got = {r["doc_id"] for r in corpus_pipeline.language(
            spark, learnt.unionByName(more), str(tmp_path)).collect()}
        assert not {d for d in got if d < 0}
        every = {r["doc_id"] for r in learnt.where("text rlike '[A-Za-z]{2}'").collect()}
        assert len(every - got) <= 0.01 * len(every)


def test_short_items_and_those_of_numbers_are_found_in_long_texts(spark):
    asked = ["Who wrote the novel War and Peace?", "What is 12 * 7 + 45 / 9 - 3?",
             "3 5 8 13 21 34 55 89 144", "How many legs does a spider have?"]
    items = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    filler = " ".join(f"word{i} of it" for i in range(50))
    texts = [f"{filler} {a} {filler}" for a in asked] + [
        f"{filler}. Who wrote the novel Crime and Punishment? {filler}",
        f"{filler} What is 12 * 7 + 45 / 9 - 4? {filler}", f"{filler} 3 5 8 13 21 34 55 90 144",
        f"{filler} How many legs does a beetle have? {filler}", "What is it", "War and Peace"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["item_id"] for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: None, 6: None, 7: None, 8: None, 9: None}


def test_questions_asked_again_with_first_names_and_equal_values(spark):
    asked = ["Anna buys 3 pens. Anna gives 2 away. Anna keeps the rest.",
             "A train drives 12 miles north and then walks back 5 km to the lake. How far is it?",
             "Bert picks 12 apples from the tree and then eats 5 pears at home."]
    items = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    texts = ["Carla buys 7 pens. Carla gives 4 away. Carla keeps the rest.",
             'He said:\n"Carla buys 7 pens. Carla gives 4 away. Carla keeps the rest."',
             "Carla buys 7 pens. Dora gives 4 away. Emil keeps the rest.",
             "a train drives 9 km north and then walks back 9 km to the lake.",
             "Dora picks 7 apples from the tree and then eats 7 pears at home.",
             "Dora picks 7 apples from the shop."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["item_id"] for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {0: 0, 1: 0, 2: None, 3: 1, 4: 2, 5: None}


def test_windows_are_made_only_where_they_begin_like_one_of_an_item(spark):
    asked = ["He walked 5 km to the old mill and sold 12 sacks of flour to Anna.", "Who is it?"]
    items = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    filler = " ".join(f"so word{'abcdefghij'[i % 10]} was" for i in range(700))
    texts = [f"{filler}. She walked 9 miles to the old mill and sold 3 sacks of flour to Dora. {filler}",
             "km to the old mill and sold 3 sacks.", "7 km to the old mill and sold 4 sacks",
             f"{filler} km to the old mill {filler}", "so who is it", "who is", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = decontaminate._wanted(decontaminate._parsed(items, "item_id"), 8, 5)
    made = decontaminate._places(docs.select(F.col("doc_id").alias("_key"), "text"),
                                 decontaminate._prefixes(wanted), [(3, True), (3, False), (8, False)])
    assert {r["_key"] for r in made.where("hash is not null").collect()} == {0, 1, 2, 3, 4}
    assert made.count() <= 300          # of over 4,000 places, with five windows each
    got = {r["doc_id"]: (r["item_id"], r["n_windows"])
           for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {0: (0, 9), 1: (0, 1), 2: (0, 3), 3: (None, 0), 4: (1, 1), 5: (None, 0),
                   6: (None, 0)}


def test_a_whole_notice_counts_after_a_partial_one(spark):
    notice = licenses.TEMPLATES["mit"][2].split()
    changed = [*notice[:15], "other", *notice[16:]]
    gap = [f"w{i}" for i in range(300)]
    rows = [(1, [*notice[:15], *gap, *changed]), (2, [*notice[12:], "x", *changed]),
            (3, [*changed[:15], *gap, *changed[16:]]), (4, [*gap, *changed])]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    share = 28 / 29
    spans = {d: [tuple(s) for s in r["spans"]] for d, r in got.items()}
    assert spans == {1: [("mit", 315, 343, share)], 2: [("mit", 18, 46, share)], 3: [],
                     4: [("mit", 300, 328, share)]}
    assert {d for d, r in got.items() if r["labels"] == "mit"} == {1, 2, 4}


def test_open_heads_buttons_and_selects_hide_no_text():
    for source in ("<html><head><title>t</title><style>b</style><p>One</p><p>Two</p>",
                   "<head><meta charset=x><title>t</title>One<p>Two",
                   "<head><title>t</title></head><body><p>One</p><p>Two</p></body>",
                   "<body><div><button></div><p>One<p>Two<button>b</button>",
                   "<p>One<select><p>Two", "<p>One<select><option>a<option>b</select><p>Two"):
        assert [t for _, t in htmltext.parse(source).runs] == ["One", "Two"], source


def test_stages_pass_on_columns_of_any_name(spark, tmp_path):
    """Names that operators use, nulls, repeated rows and empty tables, through every stage."""
    import duckdb
    duckdb.sql("copy (select 1::bigint item_id, 'one two three four five six seven eight nine ten' "
               f"as text) to '{tmp_path}/benchmark.parquet'")
    names = ["score", "lang_pred", "_like", "_row", "kept", "removed", "item_id", "contaminated",
             "n_items", "n_windows", "_key", "_text_key", "_spans", "_column_1", "like", "a.b"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(
        f"`{n}` string" for n in names)
    text = "the quick brown fox of the north jumps over a lazy dog in the garden number w{} x{} y{}"
    rows = [(i, text.format(i, i * i, i + 7), "en", None if i % 2 else "s",
             *[f"{n}{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame([*rows, rows[3], (99, None, None, None, *[None] * len(names))],
                                 schema)
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [f.name for f in none.schema], name
        docs = spark.createDataFrame(docs.collect(), none.schema)
        for r in docs.collect():
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names], name
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    assert {r["doc_id"] for r in docs.collect()} == set(range(12))
    assert corpus_pipeline.mixture(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.mixture(spark, none, str(tmp_path)).count() == 0


def test_paths_of_links_join_in_a_few_rounds(spark):
    from tablescout.llm.graph import components
    ids = [(k * 7919) % 1009 for k in range(120)]
    links = [*zip(ids[:80], ids[1:80]), *zip(ids[81:], ids[80:]), *[(ids[0], k) for k in ids[5:9]]]
    got = {r["node"]: r["root"] for r in components(
        spark.createDataFrame(links, "u long, v long")).collect()}
    want = linked(ids, links)
    assert {n: min(m for m in got if got[m] == got[n]) for n in got} == want


def test_rows_without_id_are_drawn_each_for_itself(spark):
    rows = spark.range(20_000).selectExpr("cast(null as long) as doc_id")
    assert 1_500 < rows.where(cotrain._drawn(0.1, 3)).count() < 2_500


def test_the_mix_does_not_depend_on_the_files(spark):
    rows = [(None if i % 3 else 5, f"word{i % 50} " * (i % 7 + 1), "a" if i % 4 else "b")
            for i in range(200)]
    taken = [sorted(map(str, mixing.mix(spark.createDataFrame(
        part, "doc_id long, text string, source string").withColumn("doc_id", F.col("doc_id"))
        .repartition(n)).select("doc_id", "size", "source", "taken").collect()))
        for part, n in ((rows, 1), (rows[::-1], 5))]
    assert taken[0] == taken[1]


def test_unclosed_elements_cost_no_more_than_closed_ones():
    import time
    for begin, more in (("", "<b>x</i>"), ("<b>" * 20_000, "<div>x</div>"),
                        ("<li><ul>" + "<div>" * 20_000, "<li>x</li>"),
                        ("<p><section>" + "<i>" * 20_000, "<p>x</p>")):
        began = time.time()
        page = htmltext.parse(begin + more * 20_000)
        assert sum(t.count("x") for _, t in page.runs) == 20_000
        assert time.time() - began < 8


def test_licence_phrases_of_one_word_are_refused(spark):
    with pytest.raises(ValueError, match="two words"):
        licenses.Scanner({"copyleft": "gpl"}, {})


@pytest.fixture
def many_tasks(spark):
    """Shuffles of many tasks that Spark doesn't join into fewer."""
    conf = {"spark.sql.shuffle.partitions": "40",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_small_tables_of_many_tasks_are_few_files(spark, many_tasks, monkeypatch):
    from tablescout.llm import graph, text
    rows = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("x"))
    assert rows.rdd.getNumPartitions() == 40
    kept = text.settle(rows)
    assert kept.rdd.getNumPartitions() == 1
    assert sorted(kept.collect()) == sorted(rows.collect())
    assert text.settle(rows.where("k < 0")).count() == 0
    assert text.fewer(rows, 100, 30).rdd.getNumPartitions() == 4
    assert text.fewer(rows, 10**9).rdd.getNumPartitions() == 40
    found = graph.components(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "u long, v long"))
    assert found.rdd.getNumPartitions() == 1 and found.count() == 5


def test_copies_and_repeats_leave_few_files(spark, many_tasks, tmp_path, monkeypatch):
    from tablescout.functions import scale
    monkeypatch.setattr(scale, "new_folder", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr("tablescout.llm.text.new_folder", scale.new_folder)
    same = "a passage of words that two texts share and that is long enough to be found, " * 4
    docs = spark.createDataFrame(
        [(k, f"{k} {same} {k * k}" if k % 2 else " ".join(f"w{k}x{i}" for i in range(40)))
         for k in range(60)], "doc_id long, text string").coalesce(2)
    assert minhash.near_duplicates(docs).count() == 60
    got = suffixes.remove_repeats(docs).where("size(removed) > 0")
    assert got.count() == 30
    for name in ("nodes", "shingle-sets", "marks", "distinct-contexts", "repeats"):
        files = list((tmp_path / name).glob("part-*"))
        assert 1 <= len(files) <= 2, name


def test_language_judges_each_text_once(spark, docs, capsys):
    kept = corpus_pipeline.language(spark, docs.select("doc_id", "text", "lang"), "")
    kept.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython ") == 1


def test_a_fit_of_a_machine_holds_its_rows_once():
    import tracemalloc

    import numpy as np
    rng = np.random.default_rng(1)
    x, y = rng.random((500, 1024), np.float32), np.where(rng.random(500) < 0.3, 1, -1)
    tracemalloc.start()
    langid._svm(x, y, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.3 * x.size * 8
