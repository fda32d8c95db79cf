"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose spans: those of the base rules, and looser forms (obfuscated addresses, numbers
that fail a rule, national phone numbers, account and insurance numbers, names after a title or
a known given name). Labelers vote for, against or not at all: regular expressions (form), check
digits, gazetteers (top-level domains, calling codes, countries, given names, card prefixes),
cue words before the span and what touches it. Expectation-maximisation over the counts of vote
patterns estimates each labeler's reliability per kind, without any label. The spans' chances
train the final span classifier, a logistic regression on votes and shape. Base spans stay
whatever it says; other spans are added where it is sure and nothing overlaps. A match that a
base rule drops, or whose check digits fail, teaches what is no personal data and is not added.

Positions come without a Python worker: matches are put between marks, the text is split there,
and lengths are summed along each distinct text that holds any.
"""

from __future__ import annotations

import functools
import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scale import attach, settle
from .text import written

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "name")     # in the order of spans
BASE = KINDS[:4]
SURE = 0.9              # chance from which a span is added
CONTEXT = 40            # characters of context on either side
ROUNDS = 60             # of expectation-maximisation, at most

# The patterns of the base rules. Possessive where nothing can be given back, and
# from the first character of a run, so that a long run is read once.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Looser forms
AT = r"(?: ?\(at\) ?| ?\[at\] ?| at )"
DOT = r"(?: ?\(dot\) ?| ?\[dot\] ?| dot )"
LOOSE_EMAIL = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+" + AT +
               r"[A-Za-z0-9-]{1,64}+(?:(?:" + DOT + r"|\.)[A-Za-z0-9-]{1,64}+){1,8}")
IPV6 = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
LOCAL_PHONE = (r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ .-]?[0-9]{3,4}[ .-][0-9]{3,5}"
               r"(?![0-9A-Za-z]|[.-][0-9])")
IBAN = (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
        r"(?![A-Za-z0-9])")
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Madame Monsieur Señor Señora".split()
GIVEN_NAMES = ("James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William "
               "Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Peter Paul "
               "Maria José Juan Carlos Pierre Marie Hans Klaus Jürgen Sophie Laura Emma").split()
NAME = (r"(?<![\p{L}\p{N}])(?:(?:" + "|".join(TITLES) + r")\.? |(?:" + "|".join(GIVEN_NAMES)
        + r") )\p{Lu}\p{Ll}{1,30}+(?: \p{Lu}\p{Ll}{1,30}+)?")
LOOSE = {"email": LOOSE_EMAIL, "ip": IPV6, "iban": IBAN, "ssn": SSN, "phone": LOCAL_PHONE,
         "name": NAME}

# Gazetteers and cue words
DOMAINS = "com org net edu gov mil int info biz io co de fr es it nl uk us ca eu ch at be".split()
COUNTRIES = "DE FR ES IT NL GB CH AT BE IE PT LU FI SE DK NO PL CZ".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 61 81 86 91"
CUES = {"email": "email e-mail mail contact write address", "ip": "ip host server address from",
        "card": "card visa mastercard credit debit payment pay",
        "phone": "phone tel telephone call mobile cell fax contact telefon",
        "iban": "iban account bank konto", "ssn": "ssn social security insurance",
        "name": "name contact patient customer dear signed author"}
AGAINST = ("version ver v isbn order invoice section figure fig page ref build release token "
           "serial part model item no number id key hash")
TEST_ADDRESSES = r"^(?:0|127|255)\."

MARK, OTHER = "\u0001", "\u0002"
LABELERS = ("form", "checked", "listed", "cued", "apart")


def _cut(text: Column, pattern: str) -> Column:
    """The text split before and after each match: matches stand at odd places."""
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), f"({pattern})", f"{MARK}$1{MARK}")
    return F.split(marked, MARK)


def _groups() -> list[tuple[str, Column, str]]:
    """(name, test whether a text may hold a match, pattern)."""
    text = F.col("text")
    loose = "|".join(f"(?:{p})" for p in LOOSE.values())
    hint = (r"[0-9][ .)-]{1,2}[0-9]|[A-Z]{2}[0-9]{2}|[(\[](?:at|dot)[)\]]| at \S+(?:\.| dot )|"
            r":[0-9A-Fa-f]{1,4}:|(?<!\p{L})(?:" + "|".join(TITLES + GIVEN_NAMES) + r")\.? \p{Lu}")
    return [("email", F.contains(text, F.lit("@")), EMAIL),
            ("ip", text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), IP),
            ("card", text.rlike(r"(?:[0-9][\x20-]?){12}[0-9]"), CARD),
            ("phone", F.contains(text, F.lit("+")), PHONE),
            ("loose", text.rlike(hint), loose)]


def text_key(text: Column) -> Column:
    """128 bits that rows of one text share."""
    return F.md5(text.cast("binary"))


def matches(docs: DataFrame) -> DataFrame:
    """(_key, group, start, end, found, before, after): matches of each distinct ``text``.

    ``docs`` has ``_key`` and ``text``. Offsets are in characters, ``end`` is exclusive.
    """
    kinds = [F.struct(F.lit(name).alias("group"), F.when(
        test, _cut(F.col("text"), pattern)).alias("parts")) for name, test, pattern in _groups()]
    # each split is worked out once: the generator stands between it and its uses
    cut = (docs.select("_key", F.explode(F.array(*kinds)).alias("_g"))
           .select("_key", "_g.group", "_g.parts").where(F.size("parts") > 1))
    one = F.transform(F.sequence(F.lit(1), F.size("parts") - 1, F.lit(2)), lambda i: F.struct(
        i.alias("at"), F.length(F.get("parts", i - 1)).alias("gap"),
        F.get("parts", i).alias("found"),
        F.right(F.get("parts", i - 1), F.lit(CONTEXT)).alias("before"),
        F.left(F.get("parts", i + 1), F.lit(CONTEXT)).alias("after")))
    # copies of a text become one before anything is ordered
    rows = (cut.select("_key", "group", F.explode(one).alias("_m")).select("_key", "group", "_m.*")
            .groupBy("_key", "group", "at").agg(
                *[F.first(c).alias(c) for c in ("gap", "found", "before", "after")]))
    along = Window.partitionBy("_key", "group").orderBy("at")
    size = F.length("found")
    return rows.select(
        "_key", "group", (F.sum(F.col("gap") + size).over(along) - size).alias("start"),
        F.sum(F.col("gap") + size).over(along).alias("end"), "found", "before", "after")


def _digits(column: Column) -> Column:
    return F.regexp_replace(column, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit is the Luhn check digit of the others."""
    def weight(d, i):
        twice = d * (F.pmod(i, F.lit(2)) + 1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    total = F.aggregate(F.transform(F.filter(values, lambda d: d.isNotNull()), weight),
                        F.lit(0), lambda n, x: n + x)
    return F.pmod(total, F.lit(10)) == 0


def mod97(iban: Column) -> Column:
    """Whether an account number has remainder 1."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    steps = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(
        c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(steps, F.lit(0), lambda n, v: F.when(
        v > 9, F.pmod(n * 100 + v, F.lit(97))).otherwise(F.pmod(n * 10 + v, F.lit(97))))
    return rest == 1


def _parts_fit(found: Column) -> Column:
    """All four parts of an address at most 255; leading zeros don't count."""
    return F.forall(F.split(found, r"\."), lambda p: F.length(
        F.regexp_replace(p, "^0+(?=.)", "")).between(1, 3) & (p.try_cast("int") <= 255))


def typed(found: DataFrame) -> DataFrame:
    """``matches`` with ``kind`` and ``base``: whether a base rule holds."""
    text, group = F.col("found"), F.col("group")
    digits = F.length(_digits(text))
    loose = functools.reduce(
        lambda otherwise, kind: F.when(text.rlike(f"^(?:{_alone(LOOSE[kind])})$"), F.lit(kind))
        .otherwise(otherwise), reversed(LOOSE), F.lit(None).cast("string"))
    return found.withColumn("kind", F.when(group == "loose", loose).otherwise(group)).withColumn(
        "base", F.when(group == "email", True)
        .when(group == "ip", _parts_fit(text))
        .when(group == "card", digits.between(13, 19) & luhn(_digits(text)))
        .when(group == "phone", digits.between(9, 15)).otherwise(False)).where(
            F.col("kind").isNotNull() & ((group != "card") | digits.between(13, 19)))


def _alone(pattern: str) -> str:
    """A pattern without what it asks of its neighbours, which a match doesn't hold."""
    at = pattern.find(")", 0) + 1 if pattern.startswith("(?<!") else 0
    return pattern[at:]


def votes(spans: DataFrame) -> DataFrame:
    """``typed`` spans with a column for each labeler: 1, 0 or null, which is no vote."""
    text, kind = F.col("found"), F.col("kind")
    digits = _digits(text)
    plain = F.regexp_replace(text, " ", "")
    last = F.lower(F.regexp_extract(text, r"([A-Za-z0-9-]+)$", 1))

    def of_kind(**cases: Column) -> Column:
        chosen = F.lit(None).cast("boolean")
        for name, case in cases.items():
            chosen = F.when(kind == name, case).otherwise(chosen)
        return chosen.cast("int")

    def only(true: Column) -> Column:
        return F.when(true, True)

    # the word nearest to the span on its left decides
    near = F.lower(F.regexp_extract("before", r"([\p{L}-]+)[^\p{L}]{0,4}$", 1))
    cue = functools.reduce(lambda otherwise, name: F.when(
        (kind == name) & near.isin(CUES[name].split()), True).otherwise(otherwise), KINDS,
        F.when(near.isin(AGAINST.split()), False))
    area = F.substring(digits, 1, 3)
    return spans.select(
        "*",
        of_kind(email=last.rlike("^[a-z]{2,}$"), card=digits.rlike("^[0-9]{13,19}$"),
                ip=F.when(F.contains(text, F.lit(":")), True).otherwise(_parts_fit(text)),
                phone=F.length(digits).between(9, 15), iban=F.length(plain).between(15, 34),
                ssn=~(area.isin("000", "666") | area.startswith("9")),
                name=text.rlike(r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$")).alias("form"),
        of_kind(card=luhn(digits), iban=mod97(plain)).alias("checked"),
        of_kind(email=last.isin(DOMAINS), ip=F.when(text.rlike(TEST_ADDRESSES), False),
                card=F.substring(digits, 1, 1).isin("3", "4", "5", "6"),
                phone=only(text.startswith("+") & functools.reduce(
                    lambda a, b: a | b, [digits.startswith(c) for c in CALLING.split()])),
                iban=F.substring(plain, 1, 2).isin(COUNTRIES),
                name=only(text.rlike(r"(?<!\p{L})(?:" + "|".join(GIVEN_NAMES) + r")(?!\p{L})")))
        .alias("listed"),
        cue.cast("int").alias("cued"),
        F.when(F.col("before").rlike(r"[\p{L}\p{N}_/=#-]$")
               | F.col("after").rlike(r"^[\p{L}\p{N}_/=-]"), 0)
        .when(F.col("before").rlike(r"(?:^|[\s(\[<:\"'|,;])$")
              & F.col("after").rlike(r"^(?:$|[\s)\]>:\"'|,;.!?])"), 1).alias("apart"))


def reliabilities(patterns: list[tuple[tuple, int]]) -> tuple[float, list, list]:
    """Share of true spans, and each labeler's chance to vote 1 on true and on false ones.

    ``patterns`` has the votes (1, 0 or None) and how many spans have them. Labelers are taken
    to be independent given the truth. Expectation-maximisation starts from the shares of votes;
    a few votes of an ordinary labeler are added to each one's.
    """
    n = len(patterns[0][0])
    chance = [(1 + sum(v == 1 for v in votes)) / (2 + sum(v is not None for v in votes))
              for votes, _ in patterns]
    for _ in range(ROUNDS):
        total = sum(count for _, count in patterns)
        share = (1 + sum(p * c for p, (_, c) in zip(chance, patterns))) / (2 + total)
        hit, false = [], []
        for j in range(n):
            voted = [(p, c, v[j]) for p, (v, c) in zip(chance, patterns) if v[j] is not None]
            hit.append((4 + sum(p * c for p, c, v in voted if v))
                       / (5 + sum(p * c for p, c, _ in voted)))
            false.append((1 + sum((1 - p) * c for p, c, v in voted if v))
                         / (5 + sum((1 - p) * c for p, c, _ in voted)))
        moved = [posterior(votes, share, hit, false) for votes, _ in patterns]
        apart = max(abs(a - b) for a, b in zip(moved, chance))
        chance = moved
        if apart < 1e-9:
            break
    return share, hit, false


def posterior(votes: tuple, share: float, hit: list, false: list) -> float:
    """The chance that a span with these votes is true."""
    odds = math.log(share / (1 - share))
    for v, h, f in zip(votes, hit, false):
        if v is not None:
            odds += math.log(h / f) if v else math.log((1 - h) / (1 - f))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def _chance(models: dict[str, tuple[float, list, list]]) -> Column:
    """``posterior`` as a column."""
    def odds(share, hit, false):
        total = F.lit(math.log(share / (1 - share)))
        for name, h, f in zip(LABELERS, hit, false):
            total = total + F.when(F.col(name) == 1, math.log(h / f)).when(
                F.col(name) == 0, math.log((1 - h) / (1 - f))).otherwise(0.0)
        return total

    chosen = F.lit(0.0)
    for kind, model in models.items():
        chosen = F.when(F.col("kind") == kind, odds(*model)).otherwise(chosen)
    return 1 / (1 + F.exp(-chosen))


def _features() -> Column:
    size = F.length("found")
    flags = ([F.col("kind") == k for k in KINDS]
             + [F.col(v) == value for v in LABELERS for value in (1, 0)])
    shape = [F.length(_digits(F.col("found"))) / size,
             F.least(size / 40.0, F.lit(1.0)),
             F.least(F.length(F.regexp_replace("found", r"[\p{L}\p{N}]", "")) / 10.0, F.lit(1.0))]
    return F.array(*[F.coalesce(f.cast("double"), F.lit(0.0)) for f in flags + shape])


def judged(docs: DataFrame) -> DataFrame:
    """(_key, kind, start, end, base, able, chance): the spans proposed in distinct texts.

    ``chance`` is the final classifier's; ``able`` are those that may be added.
    """
    spans = settle(votes(typed(matches(docs))))
    counted = spans.groupBy("kind", *LABELERS).count().collect()     # at most 7 * 3 ** 5 rows
    models = {}
    for kind in sorted({r["kind"] for r in counted}):
        own = sorted(((tuple(r[v] for v in LABELERS), r["count"]) for r in counted
                      if r["kind"] == kind), key=repr)
        models[kind] = reliabilities(own)
    able = (F.col("group") == "loose") & (F.coalesce("checked", F.lit(1)) == 1)
    spans = spans.withColumn("able", able).withColumn("_x", _features())
    known = ["_key", "kind", "start", "end", "base", "able"]
    if not models:
        return spans.select(*known, F.lit(0.0).alias("chance"))
    # spans of equal features and chance teach as one, with their number as weight
    taught = settle(spans.groupBy("_x", _chance(models).alias("p")).count())
    both = taught.select(array_to_vector("_x").alias("features"), "p", "count", F.explode(
        F.array(F.lit(1.0), F.lit(0.0))).alias("label")).withColumn(
            "weight", F.col("count") * F.when(F.col("label") == 1, F.col("p")).otherwise(
                1 - F.col("p"))).where("weight > 0")
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=40,
                               standardization=False).fit(both)
    found = model.transform(spans.withColumn("features", array_to_vector("_x")))
    return found.select(*known, vector_to_array("probability")[1].alias("chance"))


def kept(spans: DataFrame, sure: float = SURE) -> DataFrame:
    """Base spans, and others of a chance of ``sure`` that overlap neither those nor each other."""
    able = spans.where(F.col("base") | (F.col("able") & (F.col("chance") >= sure)))
    order = [F.col("start"), F.col("base").desc(), F.col("end").desc(), F.col("kind")]
    back = [c.desc() if k != 1 else c.asc() for k, c in enumerate(
        [F.col("start"), F.col("base"), F.col("end"), F.col("kind")])]
    rows = Window.unboundedPreceding, -1
    ahead = Window.partitionBy("_key").orderBy(*back).rowsBetween(*rows)
    behind = Window.partitionBy("_key").orderBy(*order).rowsBetween(*rows)
    following = F.min(F.when(F.col("base"), F.col("start"))).over(ahead)
    before = F.max("end").over(behind)
    return (able.select("*", following.alias("_next"), before.alias("_last"))
            .where(F.col("base") | ((F.coalesce("_next", F.col("end")) >= F.col("end"))
                                    & (F.coalesce("_last", F.col("start")) <= F.col("start"))))
            .drop("_next", "_last"))


def find(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, ``base`` and ``spans`` (strings).

    ``docs`` has a ``text``; other columns stay, except those named as above, which are
    replaced. A span reads ``kind:start:end``, in characters, the end exclusive; spans stand by
    kind (``KINDS``), then start. ``base`` and the counts are those of the base rules, ``spans``
    also has what the classifier adds. Null and empty texts have none: zeros and ''. Rows of
    equal texts share the answer; no rows, no rows.
    """
    added = [*[f"n_{k}" for k in BASE], "base", "spans"]
    others = [c for c in docs.columns if c not in added]
    may = functools.reduce(lambda a, b: a | b, [test for _, test, _ in _groups()])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"),
                       F.when(may, text_key(F.col("text"))).alias("_key"))
    some = docs.select("text").where(may).withColumn("_key", text_key(F.col("text")))
    spans = written(kept(judged(some), sure), "spans")

    place = functools.reduce(lambda otherwise, k: F.when(F.col("kind") == KINDS[k], k)
                             .otherwise(otherwise), range(len(KINDS)), F.lit(len(KINDS)))
    one = F.struct(place.alias("place"), "start", "end", "kind")

    def spelled(column: str) -> Column:
        return F.array_join(F.transform(F.array_sort(column), lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    per = (spans.groupBy("_key").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE],
        F.collect_list(F.when(F.col("base"), one)).alias("_base"),
        F.collect_set(one).alias("_spans"))
        .select("_key", *added[:4], spelled("_base").alias("base"),
                spelled("_spans").alias("spans")))
    times = rows.where("_key is not null").groupBy("_key").agg(F.count("*").alias("_times"))
    per = settle(per.join(times, "_key"))
    return attach(rows, per, ["_key"], "_times").select(
        *[F.col("_row")[c].alias(c) for c in others],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in added[:4]],
        *[F.coalesce(c, F.lit("")).alias(c) for c in added[4:]])
