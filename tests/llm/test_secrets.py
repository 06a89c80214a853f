"""Secret scans, held against Python's patterns and all pairs of parts."""

import random
import re
from hashlib import sha256

from tipwatch.llm import secrets

PLAIN = {
    "assign": re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
ORDER = ["assign", "access", "hex", "ident", "secret", "endpoint"]


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            size, least = {"assign": (len(m[2]) if kind == "assign" else 0, 8), "access": (len(m[0]), 16), "hex": (len(m[0]), 32)}[kind]
            if size >= least:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], ORDER.index(s[2])))


def all_spans(text):
    base = base_spans(text)
    weak = [(m.start(), m.end(), "ident") for m in re.finditer(secrets.IDENT, text, re.A)]
    weak += [(m.start(), m.end(), "secret") for m in re.finditer(secrets.MIXED, text) if all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]"))]
    weak += [(m.start(), m.end(), "endpoint") for m in re.finditer(secrets.ENDPOINT, text, re.A)]
    out = list(base)
    for s in weak:
        near = {k for a, _, k in base + weak if abs(a - s[0]) <= secrets.SCOPE}
        ident, secret = near & {"access", "ident"}, near & {"assign", "hex", "secret"}
        complete = {"ident": secret, "secret": ident, "endpoint": ident and secret}[s[2]]
        if complete and not any(s[0] < b and a < s[1] for a, b, _ in base):
            out.append(s)
    return sorted(out, key=lambda s: (s[0], ORDER.index(s[2])))


def text_of(spans):
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def corpus():
    draw = random.Random(6)
    chars = lambda alphabet, n: "".join(draw.choice(alphabet) for _ in range(n))
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    make = [
        lambda: "AKIA" + chars(upper + digit, draw.choice([11, 12, 16, 20])),
        lambda: draw.choice(["password", "PassWd", "SECRET", "token", "api_key", "ApiKey"]) + draw.choice(["=", ": ", '" : "', " = '", "==", ":"]) + chars(lower + digit + "+/=_.-", draw.choice([3, 7, 8, 20])),
        lambda: chars("0123456789abcdef", draw.choice([8, 31, 32, 40, 64])),
        lambda: chars(upper + lower + digit + "+/", draw.choice([19, 20, 40, 250])),
        lambda: draw.choice(["user=", "username: ", "login = ", "client_id:"]) + chars(lower, 6),
        lambda: "https://" + chars(lower, 8) + ".example/" + chars(lower, 5),
        lambda: "db." + chars(lower, 6) + ".internal:5432",
        lambda: "token=secret:abcdefghij",
        lambda: " ".join(chars(lower + "éß😀", draw.randrange(1, 9)) for _ in range(draw.randrange(1, 90))),
    ]
    texts = [draw.choice(["", " ", "\n"]).join(draw.choice(make)() + draw.choice([" ", "\n", ", "]) for _ in range(draw.randrange(1, 9))) for _ in range(150)]
    texts += [None, "", "paſſword=abcdefghij toKen=abcdefghij", "a" * 70000, "AKIA" * 9000, "x" * 300 + " password=" + "Ab1" * 9000]
    texts += ["user=bobby " + "Ab1" * 20 + " " + " ".join(make[3]() for _ in range(800))]
    return texts


def test_against_plain_scan(spark, make):
    texts = corpus()
    docs = make(texts).withColumnRenamed("lang", "spans").withColumnRenamed("source", "kind").repartition(5)
    rows = {r.doc_id: r for r in secrets.digest(secrets.scan(docs), secrets.BASE, secrets.WEAK).collect()}
    added = 0
    for i, text in enumerate(texts, 1):
        base = base_spans(text or "")
        assert rows[i].base_sha256 == sha256(text_of(base).encode()).hexdigest(), text
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [sum(k == x for _, _, x in base) for k in secrets.BASE]
        assert rows[i].spans == text_of(all_spans(text or "")), text
        added += len(all_spans(text or "")) - len(base)
    assert added > 100


def test_nulls_repeats_and_empty_tables(spark, make):
    docs = make(["user=bobby token=abcdefgh12 https://host.example/x"] * 2 + [None])
    more = docs.selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars")
    rows = secrets.digest(secrets.scan(docs.unionByName(docs).unionByName(more)), secrets.BASE, secrets.WEAK).collect()
    assert len(rows) == 9
    assert {(r.spans, r.n_assign) for r in rows} == {("ident:0:10,assign:11:27,endpoint:28:50", 1), ("", 0)}
    assert secrets.scan(docs.limit(0)).count() == 0
