"""Personal data, base spans held against Python's patterns, the trees against planted data."""

import random
import re
from hashlib import sha256

import pytest

from tipwatch.llm import personal
from tipwatch.llm.secrets import digest

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def meets(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_of(text):
    out = [(m.start(), m.end(), k) for k, p in PLAIN.items() for m in p.finditer(text) if meets(k, m[0])]
    out = sorted(out, key=lambda s: (s[0], personal.BASE.index(s[2])))
    return ",".join(f"{k}:{a}:{b}" for a, b, k in out), out


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(8)
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    word = lambda: "".join(draw.choice("abcdeéß") for _ in range(draw.randrange(2, 8)))

    def card():
        n = number(draw.choice([12, 15, 16, 19]))
        n = next(n[:-1] + d for d in "0123456789" if luhn(n[:-1] + d)) if draw.random() < 0.6 else n
        return draw.choice([n, "-".join(n[i : i + 4] for i in range(0, len(n), 4)), " ".join(n[i : i + 4] for i in range(0, len(n), 4))])

    make = [
        lambda: f"+1 ({number(3)}) {number(3)}-{number(4)}",
        lambda: "+" + draw.choice(["49 ", "33-", "4"]) + number(draw.choice([4, 7, 9, 12, 14])),
        card,
        card,
        lambda: ".".join(str(draw.choice([0, 1, 99, 255, 256, 999, "007"])) for _ in range(draw.choice([3, 4, 4, 4, 5, 8]))),
        lambda: word().replace("é", "e").replace("ß", "s") + "." + number(2) + "@" + "b-c" + draw.choice([".de", ".co.uk", "", ".", "..x", "_x@y.z", ".d%e@f.g"]),
        lambda: f"call ({number(3)}) {number(3)}-{number(4)}",
        lambda: "DE" + number(2) + " " + " ".join(number(4) for _ in range(4)),
        lambda: "jane [at] example [dot] org",
        lambda: "v" + number(1) + "." + number(2),
        lambda: " ".join(word() for _ in range(draw.randrange(1, 60))),
    ]
    texts = [draw.choice([" ", "\n", ", ", ""]).join(draw.choice(make)() for _ in range(draw.randrange(1, 9))) for _ in range(400)]
    return [*texts, None, "", "1" * 60000, "1 " * 30000, "a" * 60000, "a.b" * 20000 + "@", "+1" + " " * 60000, "1." * 30000, "x@" + "y." * 30000, "😀a@b.c d@e.f"]


@pytest.fixture(scope="module")
def found(spark, make, texts):
    docs = make(texts).withColumnRenamed("lang", "spans").withColumnRenamed("source", "score").repartition(5)
    return {r.doc_id: r for r in digest(personal.scan(docs), personal.BASE, personal.ADDED).collect()}


def test_base_spans(texts, found):
    for i, text in enumerate(texts, 1):
        joined, base = base_of(text or "")
        row = found[i]
        assert row.base_sha256 == sha256(joined.encode()).hexdigest(), text
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == b[2] for b in base) for k in personal.BASE]
        assert [s for s in row.spans.split(",") if s.split(":")[0] in personal.BASE] == [s for s in joined.split(",") if s]


def test_added_spans_keep_apart(texts, found):
    added = 0
    for i, text in enumerate(texts, 1):
        _, base = base_of(text or "")
        more = [s.split(":") for s in found[i].spans.split(",") if s and s.split(":")[0] in personal.ADDED]
        more = sorted((int(a), int(b)) for _, a, b in more)
        assert all(b <= c for (_, b), (c, _) in zip(more, more[1:], strict=False))
        assert not any(a < y and x < b for a, b in more for x, y, _ in base)
        added += len(more)
    # numbers written as phones are found without their "+"; a text without numbers has none
    assert added > 20
    assert all(found[i].spans == "" for i, t in enumerate(texts, 1) if not t)


def test_nulls_repeats_and_empty_tables(spark, make):
    docs = make(["mail a@b.cd or +1 (234) 555-0199", "mail a@b.cd or +1 (234) 555-0199", None])
    more = docs.selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars")
    rows = digest(personal.scan(docs.unionByName(docs).unionByName(more)), personal.BASE, personal.ADDED).collect()
    assert len(rows) == 9
    assert {r.spans for r in rows} == {"email:5:11,phone:15:32", ""}
    assert personal.scan(docs.limit(0)).count() == 0


def test_all_examples_take_part(spark, monkeypatch):
    """Nine thousand addresses that meet the rule and some that do not: all are learnt from or calibrated on, a frequent
    kind weighs no more than a bounded number."""
    good = [f"1{i % 100:02}.1{i // 100:02}.12.34" for i in range(9000)]
    bad = [f"3{i % 100:02}.9{i // 100:02}.12.345" for i in range(700)]
    rows = [(0, 9, "ip", t, before, "") for t in good + bad for before in ("ip ", "ip ")]
    raw = spark.createDataFrame(rows, "start int, end int, kind string, text string, before string, after string")
    tables, taken, written, fit = {}, [], personal.written, personal.GBTClassifier.fit
    monkeypatch.setattr(personal, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    monkeypatch.setattr(personal.GBTClassifier, "fit", lambda self, df: taken.append(df) or fit(self, df))
    model, threshold = personal.fitted(raw)
    n = "n" if "n" in tables["examples"].columns else "1"
    count = lambda df: {r.label: r.n for r in df.groupBy("label").agg(personal.F.expr(f"sum({n})").alias("n")).collect()}
    assert count(tables["examples"]) == {1.0: 9000, 0.0: 700}
    learnt = count(taken[0])
    assert 9000 * 0.7 < learnt[1.0] < 9000 * 0.8 and 700 * 0.65 < learnt[0.0] < 700 * 0.85
    weight = {r.label: r.w for r in taken[0].groupBy("label").agg(personal.F.sum("weight").alias("w")).collect()}
    assert weight[1.0] == pytest.approx(personal.MOST * learnt[1.0] / 9000) and weight[0.0] == learnt[0.0]
    assert threshold == 0.5
