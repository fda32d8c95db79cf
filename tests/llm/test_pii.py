"""Personal data: base spans against plain regular expressions, added spans on planted cases."""

from __future__ import annotations

import hashlib
import random
import re

from tablescout.llm import pii, queries

SF = "/root/testdata/sf0.001"
RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, rule in RULES.items()
            for m in re.finditer(rule, text or "") if valid(kind, m.group())]


def counts(spans):
    return [sum(s.startswith(k + ":") for s in spans) for k in RULES]


def test_base_of_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in
             spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_personal_data"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts(want)
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",") if r["spans"] else [])


ODD = [None, "", " ", "a@b.c%d@e.f g@h", "x@y.z@u.v.", "1.2.3.4.5.6.7.8", "300.1.1.1 001.02.3.0255",
       "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", "++49 30 1234567",
       "é🙂 a.b+c@d-e.co.uk, +33 1 23 45 67 89\n10.0.0.1", "\u0001x@y.zz\u00014111111111111111",
       "9" * 3000 + " " + "1-" * 2000 + "2", "a" * 30000, "b." * 9000 + "@" + "c." * 9000 + "d",
       "1.2." * 5000, "p@q.r " * 700, "+1" * 2000, "000.0.0.0 99999999999999999999.1.1.1"]


def test_odd_texts(spark):
    """Nulls, other scripts, marks, very long runs; repeated rows; columns of clashing names."""
    given = [(k, t, "x", 7) for k, t in enumerate(ODD)] * 2 + [(None, "x@y.zz", "x", 7)]
    rows = pii.find(spark.createDataFrame(
        given, "doc_id long, text string, _key string, n_ip int").repartition(3)).collect()
    assert len(rows) == len(given)
    for r in rows:
        want = base(r["text"])
        assert r["base"] == ",".join(want) and r["_key"] == "x"
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts(want)
        assert set(want) <= set(r["spans"].split(",") if r["spans"] else [])


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(none).collect() == []
    only = pii.find(spark.createDataFrame([(1, "nothing here"), (2, None)], none.schema)).collect()
    assert [(r["n_email"], r["base"], r["spans"]) for r in only] == [(0, "", "")] * 2


def test_added_spans(spark):
    """Planted spans that no base rule finds are added, look-alikes are not."""
    rng = random.Random(3)

    def iban():
        account = "".join(rng.choice("0123456789") for _ in range(18))
        check = 98 - int(account + "131400") % 97
        return f"DE{check:02d}{account}"

    planted = {"iban": lambda: f"my account {iban()}, please",
               "ssn": lambda: f"his ssn {rng.randint(100, 600)}-{rng.randint(10, 99)}-"
                              f"{rng.randint(1000, 9999)} is",
               "phone": lambda: f"call ({rng.randint(200, 900)}) {rng.randint(200, 900)}-"
                                f"{rng.randint(1000, 9999)} now",
               "name": lambda: f"patient {rng.choice(['Mary', 'John', 'Peter'])} "
                               f"{rng.choice(['Smith', 'Weber', 'Garcia'])} came",
               "email": lambda: f"write to me{rng.randint(1, 99)} (at) mail (dot) com today"}
    alike = [lambda: f"version {rng.randint(1, 9)}.{rng.randint(300, 900)}.1.{rng.randint(1, 9)}",
             lambda: f"order {''.join(rng.choice('0123456789') for _ in range(15))}7",
             lambda: f"part X{rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
             lambda: f"model no {rng.randint(900, 999)}-{rng.randint(10, 99)}-"
                     f"{rng.randint(1000, 9999)}_b",
             lambda: "the end of a plain sentence at the river. It was late"]
    texts = [(kind, "some words " + make()) for kind, make in planted.items() for _ in range(30)]
    texts += [(None, "some words " + rng.choice(alike)()) for _ in range(300)]
    rows = pii.find(spark.createDataFrame(texts, "kind string, text string")).collect()
    missed = [r["text"] for r in rows if r["kind"] and f"{r['kind']}:" not in r["spans"]]
    wrong = [(r["text"], r["spans"]) for r in rows if not r["kind"] and r["spans"] != r["base"]]
    assert len(missed) <= 8, missed[:9]
    assert len(wrong) <= 3, wrong[:9]


def test_reliabilities_are_learnt():
    """Labelers of known reliability, no labels: their rates come back."""
    rng = random.Random(1)
    hit, false = [0.95, 0.8, 0.7, 0.9], [0.05, 0.1, 0.3, 0.4]
    seen = {}
    for _ in range(20000):
        true = rng.random() < 0.3
        votes = tuple(int(rng.random() < (h if true else f)) if rng.random() < 0.8 else None
                      for h, f in zip(hit, false))
        seen[votes] = seen.get(votes, 0) + 1
    share, h, f = pii.reliabilities(list(seen.items()))
    assert abs(share - 0.3) < 0.04
    assert max(abs(a - b) for a, b in zip(h + f, hit + false)) < 0.06


def test_no_python_workers(spark):
    """All on the JVM's side: no plan of the operator evaluates Python."""
    import subprocess
    found = subprocess.run(["grep", "-nE", "udf|mapInArrow|mapInPandas|applyInPandas|toPandas|\\.rdd",
                            pii.__file__], capture_output=True, text=True).stdout
    assert not found
