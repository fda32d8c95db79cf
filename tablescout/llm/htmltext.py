"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Every block element of a page is a node with features: its tag, the words of its class, id
and role, depth, size, density of text and links in its subtree, and how it stands among its
siblings. Gradient-boosted trees give each node the chance of being main text. The best
labelling in which nothing under a rejected node is kept is found by one pass up the tree
and one down, so an article keeps its paragraphs and loses the advert among them.

The trees learn from the pages themselves: elements that name their part (``nav``, ``article``,
or an attribute word like ``comments``) are labelled by it, on about ``SAMPLE`` pages chosen by
a hash of their address. Each is learnt from several times: as it is, with named elements
turned into plain ones with such attribute words, and with its own text repeated as comments,
notices, sidebars and forms, so that no single habit of markup decides.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import bounded

SAMPLE = 300        # pages that are learnt from
TOGETHER = 1 << 20
TREES, TREE_DEPTH, RATE, BINS = 60, 4, 0.2, 32

# Elements by their part in a page.
BLOCKS = set("html body div p section article main header footer nav aside form fieldset ul ol li "
             "dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 blockquote pre "
             "figure figcaption address hr details summary dialog menu center".split())
UNSEEN = set("head script style noscript template iframe svg math object canvas audio video "
             "select option textarea button title datalist".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
IN_HEAD = set("head title base basefont bgsound link meta script style noscript template".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = set("nav header footer aside form menu dialog fieldset".split())
MAIN_TAGS = set("article main".split())
CLOSES_P = BLOCKS - {"html", "body"}
BOILER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising advertorial adsense adslot sponsor "
    "sponsored sponsors promo promos promotion promoted nav navbar navigation navi menu menus "
    "menubar topbar toolbar breadcrumb breadcrumbs header masthead banner footer foot sidebar "
    "side aside rail widget widgets related recommended recommendations share sharing social "
    "comment comments commentlist reply replies respond disqus discussion reader readers cookie "
    "cookies consent gdpr notice notices notification alert warning popup modal overlay "
    "newsletter subscribe subscription signup login register search searchbox form pagination "
    "pager copyright legal disclaimer imprint skip hidden toast paywall teaser teasers tags "
    "feedback rating ratings".split())
MAIN_WORDS = set("article content main post entry story body text prose maincontent "
                 "articlebody".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
                    r"|<[!?][^>]*>", re.S)
_NAMING = re.compile(r"\b(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|"
                     r"[^\s>]+))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TAGS = sorted(BLOCKS)
_TAG = {t: i for i, t in enumerate(_TAGS)}


class Page:
    """Block nodes in page order, and the runs of text right below them.

    A node is (tag, parent, attribute words, hidden); ``ends`` is the node after its subtree.
    """

    def __init__(self) -> None:
        self.tags, self.parents, self.words, self.hidden = ["html"], [-1], [frozenset()], [False]
        self.ends: list[int] = [0]
        self.runs: list[tuple[int, str]] = []       # node, text
        self.linked: list[tuple[int, int]] = []     # node, characters of a link


def parse(source: str) -> Page:
    """The nodes of a page; broken markup closes what it implies, unclosed ends at the end."""
    page = Page()
    stack: list[tuple[str, int]] = [("html", 0)]    # open elements and the block they are in
    parts: list[str] = []
    skipped = 0                                     # open elements that show nothing
    links = 0
    places: dict[str, list[int]] = defaultdict(list)    # where elements of a tag are in stack
    blocks: list[int] = []                              # where open blocks are in stack
    marks: dict[str, list[tuple[int, bool]]] = {}   # begin and end tags of an element: place, end

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                page.runs.append((stack[-1][1], text))
            parts.clear()

    def push(tag: str, node: int) -> None:
        places[tag].append(len(stack))
        if tag in BLOCKS:
            blocks.append(len(stack))
        stack.append((tag, node))

    def nearest(tags) -> int:
        """Where the innermost open element of these tags is; 0 if none is open."""
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def pop(to: int) -> None:
        nonlocal skipped, links
        while len(stack) > to:
            tag, node = stack.pop()
            if stack:
                places[tag].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            if tag in UNSEEN:
                skipped -= 1
            elif tag == "a":
                links -= 1
            elif tag in BLOCKS:
                page.ends[node] = len(page.tags)

    def end_head() -> None:
        """As browsers do before anything that a head cannot hold."""
        if stack[-1][0] == "head":
            pop(len(stack) - 1)

    def ended(tag: str, at: int) -> bool:
        """Whether the element that begins before ``at`` has an end tag before the next begins."""
        if tag not in marks:
            marks[tag] = [(m.start(), bool(m[1])) for m in re.finditer(rf"<(/?){tag}\b", source, re.I)]
        k = bisect.bisect_left(marks[tag], (at, False))
        return k < len(marks[tag]) and marks[tag][k][1]

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            end_head()
        if not skipped and piece:
            parts.append(piece)
            if links:
                page.linked.append((stack[-1][1], len(piece.strip())))

    at, size = 0, len(source)
    while at < size:
        found = _TOKEN.search(source, at)
        if found is None:
            text(source[at:])
            break
        text(source[at:found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            i = nearest([tag])
            if i:
                if any(stack[k][0] in BLOCKS for k in range(i, len(stack))):
                    flush()
                pop(i)
            continue
        if tag not in IN_HEAD and tag != "html":
            end_head()
        if tag in ("button", "select") and not ended(tag, at):
            continue
        if tag == "option" and not nearest(("select", "datalist")):
            continue
        if tag in ("html", "br", "wbr") or tag in VOID:
            if tag == "br":
                text(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in UNSEEN:
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = close.end() if close else size
                if tag == "textarea" or not close:
                    continue
                continue
            if found[3].rstrip().endswith("/"):
                continue
            push(tag, stack[-1][1])
            skipped += 1
            continue
        if tag in BLOCKS:
            if tag == "body":
                close_to = min((places[t][0] for t in UNSEEN if places[t]), default=None)
                if close_to is not None:
                    pop(close_to)
            flush()
            if tag in CLOSES_P and blocks and stack[blocks[-1]][0] == "p":
                pop(blocks[-1])
            same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
                    "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
            limit = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",),
                     "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}.get(tag, ())
            if same:
                while nearest(same) > nearest(limit):
                    pop(nearest(same))
                    if tag != "tr":
                        break
            words, hidden = _named(found[3])
            page.tags.append(tag)
            page.parents.append(stack[-1][1])
            page.words.append(words)
            page.hidden.append(hidden)
            page.ends.append(0)
            push(tag, len(page.tags) - 1)
        else:
            push(tag, stack[-1][1])
            links += tag == "a"
    flush()
    pop(0)
    return page


def _named(attributes: str) -> tuple[frozenset[str], bool]:
    words, hidden = set(), False
    if attributes and not attributes.isspace():
        for name, value in _NAMING.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role"):
                words.update(w.lower() for w in _WORDS.findall(value))
                words.update(w.lower() for w in re.split(r"[\s_-]+", value) if w)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or (
                    name == "style" and re.search(r"display\s*:\s*none", value)):
                hidden = True
    return frozenset(words), hidden


NAMES = (["depth", "own", "below", "nodes", "density", "linked", "links", "stops", "commas",
          "boiler_words", "main_words", "hidden", "boiler_above", "main_above", "place",
          "siblings", "rank", "sibling_text", "same_tag", "parent_density", "heading", "boiler_tag",
          "main_tag", "in_list", "in_main"] + ["tag_" + t for t in
                                               ("p", "div", "section", "li", "td", "pre")])


def features(page: Page) -> np.ndarray:
    n = len(page.tags)
    parent = np.array(page.parents)
    ends = np.array(page.ends)
    own, stops, commas, linked, links = (np.zeros(n) for _ in range(5))
    for node, text in page.runs:
        own[node] += len(text)
        stops[node] += text.count(".") + text.count("!") + text.count("?")
        commas[node] += text.count(",")
    for node, size in page.linked:
        linked[node] += size
        links[node] += 1

    def below(x):
        sums = np.concatenate([[0], np.cumsum(x)])
        return sums[ends] - sums[np.arange(n)]

    depth, boiler_above, main_above, in_list, in_main = (np.zeros(n) for _ in range(5))
    boiler = np.array([bool(w & BOILER_WORDS) for w in page.words], float)
    main = np.array([bool(w & MAIN_WORDS) for w in page.words], float) * (1 - boiler)
    boiler_tag = np.array([t in BOILER_TAGS for t in page.tags], float)
    main_tag = np.array([t in MAIN_TAGS for t in page.tags], float)
    hidden = np.array(page.hidden, float)
    is_list = np.array([t in ("ul", "ol", "menu", "dl") for t in page.tags])
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        boiler_above[i] = max(boiler_above[p], boiler[p], hidden[p],
                              boiler_tag[p] if not in_main[p] or page.tags[p] != "header" else 0)
        main_above[i] = max(main_above[p], main[p], main_tag[p])
        in_main[i] = max(in_main[p], main_tag[p], main[p])
        in_list[i] = max(in_list[p], is_list[p])
    boiler_tag = np.where((in_main > 0) & np.array([t == "header" for t in page.tags]), 0,
                          boiler_tag)
    total, nodes = below(own), (ends - np.arange(n)).astype(float)
    density = total / nodes
    all_linked = below(linked)
    group = parent + 1
    tag = np.array([_TAG[t] for t in page.tags])
    counts = np.bincount(group)
    siblings = counts[group].astype(float)
    order = np.argsort(group, kind="stable")
    rank = np.empty(n)
    rank[order] = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    rank /= siblings
    text = np.log1p(np.bincount(group, total) / np.maximum(counts, 1))[group]
    _, alike, times = np.unique(group * len(_TAGS) + tag, return_inverse=True, return_counts=True)
    same = times[alike] / siblings
    heading = np.array([t[0] == "h" and t[1:].isdigit() for t in page.tags], float)
    columns = [depth, np.log1p(own), np.log1p(total), np.log1p(nodes), np.log1p(density),
               all_linked / np.maximum(total, 1), np.log1p(below(links)),
               below(stops) / np.maximum(total, 1) * 100, below(commas) / np.maximum(total, 1) * 100,
               boiler, main, hidden, boiler_above, main_above,
               (np.cumsum(own) - own) / max(own.sum(), 1), np.log1p(siblings), rank, text, same,
               np.log1p(density[np.maximum(parent, 0)]), heading, boiler_tag, main_tag, in_list,
               in_main]
    columns += [np.array([t == x for t in page.tags], float)
                for x in ("p", "div", "section", "li", "td", "pre")]
    return np.stack(columns, 1).astype(np.float32)


def weak_labels(page: Page) -> np.ndarray:
    """1 main text, 0 not, -1 unknown, by elements that name their part."""
    n = len(page.tags)
    out = np.full(n, -1)
    has_main = any(t in MAIN_TAGS for t in page.tags) or any(
        w & MAIN_WORDS and not w & BOILER_WORDS for w in page.words)
    inside = [False] * n
    rejected = [False] * n
    for i in range(n):
        p = page.parents[i]
        names_main = page.tags[i] in MAIN_TAGS or bool(
            page.words[i] & MAIN_WORDS and not page.words[i] & BOILER_WORDS)
        inside[i] = names_main or (i > 0 and inside[p])
        bad_tag = page.tags[i] in BOILER_TAGS and not (page.tags[i] == "header" and inside[i])
        rejected[i] = (i > 0 and rejected[p]) or bad_tag or page.hidden[i] or bool(
            page.words[i] & BOILER_WORDS)
        if rejected[i]:
            out[i] = 0
        elif inside[i] or page.tags[i] in ("html", "body"):
            out[i] = 1
        elif not has_main:
            out[i] = 1
    return out


_PLAIN = {"nav": "menu", "header": "header", "footer": "footer", "aside": "sidebar",
          "article": "content", "main": "main"}
_ADDED = ("comments", "cookie notice", "sidebar", "related", "newsletter", "aside", "form",
          "promo banner", "login")


def variants(page: Page, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of the page as it is, in plain elements, and with parts added."""
    labels = weak_labels(page)
    yield features(page), labels
    plain = Page()
    plain.__dict__.update(page.__dict__)
    plain.tags = ["div" if t in _PLAIN else t for t in page.tags]
    keep = seed % 3 != 0        # a third loses the names of its main part as well
    plain.words = [w | {_PLAIN[t]} if t in _PLAIN and (keep or t not in MAIN_TAGS) else w
                   for t, w in zip(page.tags, page.words)]
    yield features(plain), labels
    runs = [text for node, text in page.runs if labels[node] == 1][-4:]
    for base in (page, plain):
        more = Page()
        for name in ("tags", "parents", "words", "hidden", "ends", "runs", "linked"):
            setattr(more, name, list(getattr(base, name)))
        own = labels.tolist()
        for k in range(3):
            word = _ADDED[(seed + 3 * k) % len(_ADDED)]
            top = len(more.tags)
            tag = word if word in ("aside", "form") else "div"
            for j in range(1 + len(runs)):
                more.tags.append("p" if j else tag)
                more.parents.append(top if j else 0)
                more.words.append(frozenset() if j or tag == word else frozenset(word.split()))
                more.hidden.append(False)
                more.ends.append(top + 1 + (j or len(runs)))
                own.append(0)
                if j:
                    more.runs.append((top + j, runs[j - 1]))
        more.ends[0] = len(more.tags)
        yield features(more), np.array(own)


@dataclass(frozen=True)
class Boosted:
    """Trees of fixed depth: ``feature`` and ``cut`` of inner nodes, ``value`` of leaves."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(TREE_DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Logistic gradient boosting on binned features."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    inner = 2 ** TREE_DEPTH - 1
    features_, cuts, values = [], [], []
    margin = np.full(len(x), base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(x), np.int64)
        for level in range(TREE_DEPTH):
            for node in range(2 ** level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(at == node)
                if len(own) < 20:
                    continue
                total_g, total_h = g[own].sum(), h[own].sum()
                best = 1e-6
                for k in range(x.shape[1]):
                    if not len(edges[k]):
                        continue
                    left_g = np.cumsum(np.bincount(binned[own, k], g[own], len(edges[k]) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[own, k], h[own], len(edges[k]) + 1))[:-1]
                    gain = (left_g ** 2 / (left_h + 1) + (total_g - left_g) ** 2
                            / (total_h - left_h + 1) - total_g ** 2 / (total_h + 1))
                    j = int(gain.argmax())
                    if gain[j] > best:
                        best, f[node], c[node] = gain[j], k, edges[k][j]
            at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > c[at])
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        margin += value[leaf]
        features_.append(f)
        cuts.append(c)
        values.append(value)
    return Boosted(base, np.array(features_), np.array(cuts), np.array(values))


def decode(page: Page, margin: np.ndarray) -> np.ndarray:
    """The likeliest labels of which no kept node is below a rejected one."""
    n = len(page.tags)
    keep = -np.logaddexp(0, -margin)
    drop = -np.logaddexp(0, margin)
    drop_all = np.array(drop)
    best = np.array(keep)
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        drop_all[p] += drop_all[i]
        best[p] += max(best[i], drop_all[i])
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[page.parents[i]] and best[i] >= drop_all[i]
    return kept


def fit(pages: DataFrame, sample: int = SAMPLE) -> Boosted | None:
    """Trees from about ``sample`` pages; None if the pages hold nothing to learn from."""
    total = pages.count()
    share = F.pmod(F.xxhash64("url", "html"), F.lit(1 << 30)) < int(
        min(1.0, sample / max(total, 1)) * (1 << 30))

    def made(batches):
        for batch in batches:
            for source in batch["html"]:
                page = parse(source)
                for x, y in variants(page, len(source)):
                    known = y >= 0
                    yield pd.DataFrame({"x": [x[known].tobytes()],
                                        "y": [y[known].astype(np.int8).tobytes()]})

    got = (pages.where("html is not null").where(share).select("url", "html").distinct()
           .mapInPandas(made, "x binary, y binary").orderBy("x", "y").toPandas())
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, len(NAMES))
    y = np.frombuffer(b"".join(got["y"]), np.int8)
    return boost(x, y.astype(float)) if len(y) and 0 < y.mean() < 1 else None


def extract(pages: DataFrame, model: Boosted | None) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html`` (a column ``text`` is replaced).

    Character references are decoded, white space within a block becomes one space, blocks
    that are left empty go, and the others are joined in page order by line feeds. Null and
    empty pages, and pages without main text, have an empty text. Without a model every
    block counts. Whole pages are read, of any size; each row stands for itself.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def main_text(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in series:
            yield pd.Series(texts_of(sources, shared.value), dtype=object)

    columns = [F.col(f"`{c}`") for c in pages.columns if c != "text"]
    return bounded(pages).select(*columns, main_text(F.col("html")).alias("text"))


def texts_of(sources, model: Boosted | None) -> list[str]:
    """The main text of each page; the trees see ``TOGETHER`` bytes of pages or more at once."""
    out: list[str] = []
    waiting: list[Page] = []
    size = 0

    def finish() -> None:
        nonlocal size
        if model is None:
            kept = [np.ones(len(p.tags), bool) for p in waiting]
        else:
            each = [features(p) for p in waiting]
            margins = np.split(model.margin(np.concatenate(each)),
                               np.cumsum([len(x) for x in each])[:-1])
            kept = [decode(p, m) for p, m in zip(waiting, margins)]
        out.extend("\n".join(text for node, text in p.runs if k[node])
                   for p, k in zip(waiting, kept))
        waiting.clear()
        size = 0

    for source in sources:
        waiting.append(parse(source or ""))
        size += len(source or "")
        if size >= TOGETHER:
            finish()
    if waiting:
        finish()
    return out
