"""Benchmark decontamination by canonical templates, in DataFrame operations only.

A text is a sequence of tokens: numbers, and words. Its template has a typed placeholder
for every number, for a unit after a number, and for every name, and the lower-case word
otherwise. There are two templates: one takes capitalised words inside a sentence for names,
the other those at the start of a text, sentence, line or quote too. Windows of ``WIDTH``
template tokens, or of a whole item of fewer, are joined by hash. A window of the document
that matches one of the item fixes, slot by slot, which value of the document stands for
which of the item; a question asked again with other numbers and names keeps one value for
each of the item's, though two of those may become equal. Only the windows of one alignment
(same item, template and shift) in which every value of the item has one value count.

Windows of fewer than ``LITERAL`` words would match by their placeholders alone. They, and
whole items of fewer than ``WIDTH`` tokens, are also joined by the hash of their tokens: such a
window counts where it stands verbatim.

Texts are screened first: only where the first ``PREFIX`` tokens are those of a window of an item
is the whole window made and looked up.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fewer, lookup, settle, written

WIDTH = 8           # template tokens of a window
LITERAL = 5         # of which so many are words, not placeholders
FILE_TEXTS = 200    # matching texts in one file
PREFIX = 3          # tokens of a window that are looked up before it

# Units of measure and money that may follow a number
UNITS = ("mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet "
         "mg g kg lb lbs oz ton tons gram grams kilogram kilograms pound pounds ml l liter "
         "liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour "
         "hours day days week weeks month months year years usd eur gbp dollar dollars euro "
         "euros cent cents percent degree degrees kmh mph hz w kw").split()

NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
FIRST = "\u0002"        # marks a capitalised word that may only be so as it comes first
_CAPITALISED = r"(?<!\p{L})(\p{Lu}\p{Ll}+)"
# Such a word after a word or a comma, not the end of a sentence
_INSIDE = r"(?<=[\p{L}\p{N},;] )" + FIRST
_TOKENS = "[" + NAME + FIRST + r"]?\p{L}+|\d+(?:[.,:/]\d+)*"
INNER, ALL, VERBATIM = 0, 1, 2      # the two templates, and no template


def tokens(text: Column) -> Column:
    """Lower-case tokens; a name, and a capitalised word that comes first, carry marks in front."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(text.contains(NAME) | text.contains(FIRST), F.translate(
        text, NAME + FIRST, "  ")).otherwise(text)
    marked = F.regexp_replace(F.regexp_replace(text, _CAPITALISED, FIRST + "$1"), _INSIDE, NAME)
    return F.regexp_extract_all(F.lower(marked), F.lit(_TOKENS), F.lit(0))


def plain(items: Column) -> Column:
    """Tokens without marks."""
    return F.transform(items, lambda x: F.when(x < UNIT, F.substr(x, F.lit(2))).otherwise(x))


def _typed(x: Column, before: Column, names: int) -> Column:
    """A token, or its placeholder; ``before`` is the token before it, null if it is the first."""
    units = F.array(*[F.lit(u) for u in UNITS])
    counted = (before >= "0") & (before < ":") & F.array_contains(units, x)
    word = F.lit(NAME) if names == ALL else F.substr(x, F.lit(2))
    return (F.when(x >= ":", F.when(counted, F.lit(UNIT)).otherwise(x))
            .when(x < NUMBER, F.lit(NAME)).when(x < UNIT, word).when(x < ":", F.lit(NUMBER)))


def template(items: Column, names: int) -> Column:
    """Tokens with placeholders in the place of names, numbers, and units after numbers."""
    return F.transform(items, lambda x, i: _typed(x, F.get(items, i - 1), names))


def _parsed(rows: DataFrame, *kept: str) -> DataFrame:
    """(kept..., _tokens, _inner, _all): plain tokens and both templates. Each is exploded from
    an array of one, so that Spark works it out once and doesn't repeat its expression wherever
    it is used."""
    return (rows.select(*kept, F.explode(F.array(tokens(F.col("text")))).alias("_marked"))
            .select(*kept, F.explode(F.array(F.struct(
                plain(F.col("_marked")).alias("_tokens"),
                template(F.col("_marked"), INNER).alias("_inner"),
                template(F.col("_marked"), ALL).alias("_all")))).alias("_p"))
            .select(*kept, "_p.*"))


def _codes(items: Column | str) -> Column:
    """Each token as a number, so that windows are hashed without copying text."""
    return F.transform(items, lambda x: F.xxhash64(x))


def _hash(codes: Column | str, start: Column, width: Column | int, kind: int) -> Column:
    """Of a window; those of both templates are told from verbatim ones."""
    return F.xxhash64(F.slice(codes, start + 1, width), F.lit(kind == VERBATIM))


def _coded(parsed: DataFrame, *kept: str) -> DataFrame:
    return (parsed.select(*kept, F.explode(F.array(F.struct(*[
        _codes(c).alias(c) for c in ("_tokens", "_inner", "_all")]))).alias("_p"))
        .select(*kept, "_p.*"))


def _hashes(column: str, width: int, kind: int) -> Column:
    """The hashes of all windows of a column of codes, in order."""
    last = F.size(column) - width
    return F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(
        F.array().cast("array<int>")), lambda i: _hash(column, i, width, kind))


def _of_shape(width: int, verbatim: bool) -> list[Column]:
    if verbatim:
        return [_hashes("_tokens", width, VERBATIM)]
    return [_hashes("_inner", width, INNER), _hashes("_all", width, ALL)]


def _first(items: list[Column], verbatim: Column | bool) -> Column:
    return F.xxhash64(*items, F.lit(verbatim))


def _prefixes(wanted: DataFrame) -> DataFrame:
    """(first): the distinct hashes of the first tokens of the windows of the items."""
    return wanted.select(_first([F.get("_slots", F.lit(i)) for i in range(PREFIX)],
                                F.col("kind") == VERBATIM).alias("first")).distinct()


def _places(texts: DataFrame, prefixes: DataFrame, shapes: list[tuple[int, bool]]) -> DataFrame:
    """(_key, hash): the windows of ``shapes`` (width, verbatim) whose first tokens are wanted.

    The screen copies no tokens and makes no windows: it reads ``PREFIX`` tokens from each place.
    """
    marked, start = F.col("_marked"), F.col("start")
    read = [F.get(marked, start + i - 1) for i in range(PREFIX + 1)]
    typed = {}
    for i, (before, x) in enumerate(zip(read, read[1:])):
        typed[INNER, i] = _typed(x, before, INNER)
        typed[ALL, i] = F.when((x >= FIRST) & (x < UNIT), F.lit(NAME)).otherwise(typed[INNER, i])
        typed[VERBATIM, i] = F.when(x < UNIT, F.substr(x, F.lit(2))).otherwise(x)
    firsts = [_first([F.col(f"_{k}_{i}") for i in range(n)], verbatim)
              for n, verbatim in sorted({(min(PREFIX, w), v) for w, v in shapes})
              for k in ([VERBATIM] if verbatim else [INNER, ALL])]
    every = F.array(*firsts) if firsts else F.array().cast("array<bigint>")
    places = (texts.select("_key", F.explode(F.array(tokens(F.col("text")))).alias("_marked"))
              .select("_key", "_marked", F.posexplode("_marked").alias("start", "_token"))
              .select("_key", "_marked", "start", *[
                  x.alias(f"_{k}_{i}") for (k, i), x in typed.items()])
              .select("_key", "_marked", "start", F.explode(every).alias("first")))
    near = lookup(places, prefixes, ["first"], 24, "left_semi")

    # The token before the window tells whether its first one is a unit
    widest = max((w for w, _ in shapes), default=1)
    ahead = F.least(start, F.lit(1))
    part = F.slice(marked, start + 1 - ahead, widest + ahead)
    near = near.select("_key", ahead.alias("_ahead"), F.explode(F.array(part)).alias("_part"))
    near = near.select("_key", *[_codes(F.slice(
        x, F.col("_ahead") + 1, widest)).alias(c) for c, x in (
            ("_tokens", plain(F.col("_part"))), ("_inner", template(F.col("_part"), INNER)),
            ("_all", template(F.col("_part"), ALL)))])
    hashes = [F.when(F.size(c) >= w, _hash(c, F.lit(0), w, k)) for w, verbatim in shapes
              for c, k in ([("_tokens", VERBATIM)] if verbatim else [("_inner", INNER), ("_all", ALL)])]
    return near.select("_key", F.explode(
        F.array(*hashes) if hashes else F.array().cast("array<bigint>")).alias("hash"))


def _windows(coded: DataFrame, shapes: list[tuple[int, bool]], *kept: str) -> DataFrame:
    """(kept..., start, width, hash) of every window of ``shapes``."""
    lists = [F.struct(F.lit(shape[0]).alias("width"), c.alias("hashes"))
             for shape in shapes for c in _of_shape(*shape)]
    every = F.array(*lists) if lists else F.array().cast("array<struct<width:int,hashes:array<bigint>>>")
    return (coded.select(*kept, F.explode(every).alias("_w"))
            .select(*kept, "_w.width", F.posexplode("_w.hashes").alias("start", "hash")).distinct())


def _wanted(asked: DataFrame, width: int, literal: int) -> DataFrame:
    """(item_id, kind, at, width, hash, _slots, theirs): the windows of the items."""
    own = F.least(F.lit(width), F.size("_tokens"))
    at = (asked.where(F.size("_tokens") > 0)
          .select("*", own.alias("width"),
                  F.explode(F.sequence(F.lit(0), F.size("_tokens") - own)).alias("at")))

    def cut(column):
        return F.slice(column, F.col("at") + 1, F.col("width"))

    def words(column):
        return F.size(F.filter(cut(column), lambda x: x > UNIT))

    least = min(literal, width)
    kinds = [(INNER, "_inner", words("_inner") >= least), (ALL, "_all", words("_all") >= least),
             (VERBATIM, "_tokens", (words("_all") < least) | (F.col("width") < width))]
    return functools.reduce(DataFrame.unionByName, [at.where(which).select(
        "item_id", F.lit(kind).alias("kind"), "at", "width",
        _hash(_codes(column), F.col("at"), F.col("width"), kind).alias("hash"),
        cut(column).alias("_slots"), cut("_tokens").alias("theirs"))
        for kind, column, which in kinds])


def text_key(text: Column) -> Column:
    """What rows of one text share."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, literal: int = LITERAL,
            ) -> DataFrame:
    """(_key, item_id, start): windows of the distinct texts that match an item consistently."""
    wanted = settle(_wanted(_parsed(benchmark, "item_id"), width, literal))
    hashes = settle(wanted.select("hash").distinct())
    shapes = sorted((r["width"], r["verbatim"]) for r in wanted.select(
        "width", (F.col("kind") == VERBATIM).alias("verbatim")).distinct().collect())

    texts = docs.select(text_key(F.col("text")).alias("_key"), "text")
    found = settle(lookup(_places(texts, settle(_prefixes(wanted)), shapes), hashes, ["hash"], 24,
                          "left_semi").select("_key").distinct())

    # The values in the slots, from the few texts that match
    again = _parsed(lookup(docs.select("text", text_key(F.col("text")).alias("_key")), found,
                           ["_key"], 80, "left_semi").dropDuplicates(["_key"]), "_key")
    again = written(fewer(again, found.count(), FILE_TEXTS), "matching-texts")
    hit = lookup(_windows(_coded(again, "_key"), shapes, "_key"), hashes, ["hash"], 24, "left_semi")
    hit = (hit.join(again.select("_key", "_tokens"), "_key")
           .select("_key", "start", "width", "hash",
                   F.slice("_tokens", F.col("start") + 1, F.col("width")).alias("ours")))
    aligned = settle(hit.join(wanted, ["hash", "width"]).select(
        "_key", "item_id", "kind", "start", (F.col("start") - F.col("at")).alias("shift"),
        F.filter(F.arrays_zip("_slots", "ours", "theirs"),
                 lambda p: p["_slots"] <= UNIT).alias("_pairs")))

    place = ["_key", "item_id", "kind", "shift"]
    broken = (aligned.select(*place, F.explode("_pairs").alias("_pair"))
              .select(*place, "_pair.*").distinct()
              .groupBy(*place, "_slots").agg(
                  F.count("*").alias("_n"), F.count_distinct("theirs").alias("_theirs"))
              .where("_n > _theirs").select(*place).distinct())
    return aligned.join(broken, place, "left_anti").select("_key", "item_id", "start")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH,
                 literal: int = LITERAL) -> DataFrame:
    """``docs`` with ``contaminated``, ``n_windows``, ``n_items`` and ``item_id``.

    ``docs`` has a ``text``, ``benchmark`` has ``item_id`` and ``text``; other columns stay as
    they are, except those named as above, which are replaced. ``n_windows`` counts the windows
    of the text that match an item consistently, ``n_items`` such items, ``item_id`` is the
    smallest (null if none). Null and empty texts match nothing. An item of fewer tokens than
    ``width`` is one window. Windows of fewer than ``literal`` words match only verbatim, whatever
    the case and what stands between the tokens. Repeated rows and equal texts share the answer. An empty benchmark matches nothing; no rows, no rows.
    """
    added = ["contaminated", "n_windows", "n_items", "item_id"]
    judged = settle(matches(docs.select("text"), benchmark, width, literal).groupBy("_key").agg(
        F.count_distinct("start").alias("n_windows"),
        F.count_distinct("item_id").alias("n_items"), F.min("item_id").alias("item_id")))
    rows = docs.drop(*added).withColumn("_key", text_key(F.col("text")))
    return (lookup(rows, judged, ["_key"], 100)
            .select(*[F.col(f"`{c}`") for c in docs.columns if c not in added],
                    F.col("n_windows").isNotNull().alias("contaminated"),
                    F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
                    F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id"))
