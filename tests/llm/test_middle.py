"""Cuts by wavelet matrices against slices of Python strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tipwatch.llm import middle

PARTS = ["a", "Z", "7", " ", "\n", "\n\n", "é", "ß", "日本", "😀", "é", "<", "<P", "P>", " ", "word ", "--"]


def mixed(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choices(PARTS, k=draw.randrange(50))) for _ in range(n)]


def plain(key, text, seed=1):
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    text, n = text or "", len(text or "")
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
    return (n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")


@pytest.mark.parametrize("bits", [1, 3, 5])
def test_ranks(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 1 << bits, n).astype(np.uint8)
        matrix, at = middle.WaveletMatrix(symbols, bits), np.arange(n + 1)
        for depth in range(bits + 1):
            for prefix in range(1 << depth):
                want = np.concatenate([[0], np.cumsum(symbols >> (bits - depth) == prefix)])
                assert (matrix.rank(prefix, depth, at) == want).all()


def test_cover():
    assert sorted(middle.cover({1, 2, 3, 4, 5, 6, 7})) == [(1, 1), (1, 2), (1, 3)]
    assert middle.cover(set(range(8))) == [(0, 0)]
    assert middle.cover({5}) == [(5, 3)]


@pytest.mark.parametrize("unit", ["char", "line"])
def test_cuts_of_texts_side_by_side(unit):
    texts = [*mixed(120), "", "", "\n", "x"]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([0, *map(len, raw)])
    bounds = middle.Boundaries(np.frombuffer(b"".join(raw), np.uint8), unit)
    pieces = [list(t) if unit == "char" else t.split("\n") for t in texts]
    if unit == "line":
        pieces = [[x + "\n" for x in p[:-1]] + ([p[-1]] if p[-1] else []) for p in pieces]
    n = bounds.units(ends[:-1], ends[1:])
    assert n.tolist() == [len(p) for p in pieces]
    for share in (0.0, 0.3, 0.9, 1.0):
        k = (n * share).astype(np.int64)
        got = bounds.cuts(ends[:-1], ends[1:], k) - ends[:-1]
        assert got.tolist() == [len("".join(p[:j]).encode()) for p, j in zip(pieces, k.tolist(), strict=True)]


def test_groups():
    ends = np.cumsum([0, 5, 5, 30, 1, 0, 0, 9, 1])
    assert list(middle.groups(ends, 10)) == [(0, 2), (2, 3), (3, 7), (7, 8)]
    assert list(middle.groups(np.array([0]), 10)) == []


def test_as_python_slices(spark):
    rows = list(enumerate(mixed(300, 2))) + [(1000, None), (1001, ""), (1002, "has <M> inside"), (None, "no key"), (7, "again"), (7, "again")]
    rows += [(2000, "日本語 long\n" * 150_000), (2001, "after")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as form", "2 as _h1", "3 as output")
    made = middle.transform(docs.repartition(3))
    back = middle.restored(F.col("output"), F.col("form"))
    got = [tuple(r) for r in made.withColumn("back", back).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()]
    want = [(k, *plain(k, t), t or "") for k, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert made.limit(0).count() == 0 and middle.transform(docs.limit(0)).count() == 0


def test_parameters(spark):
    docs = spark.createDataFrame([(i, f"one\ntwo {i}\nthree") for i in range(40)], "doc_id long, text string")
    made = middle.transform(docs, seed=9, unit="line", plain_from=100, spm_below=0).collect()
    assert {r.form for r in made} == {"psm"} and {r.n for r in made} == {3}
    for r in made:
        head = r.output[3 : r.output.index("<S>")]
        assert head.count("\n") == r.prefix_chars or r.prefix_chars == 3
    assert {r.form for r in middle.transform(docs, plain_from=0).collect()} == {"plain"}
