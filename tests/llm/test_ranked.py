"""Ranked search against a plain scorer that takes every document of every item on its own."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tipwatch.llm import ranked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=20):
    bags = [(k, Counter(terms(t))) for k, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in sorted({(i, t) for i, t in items}, key=str):
        found = []
        for k, b in bags:
            m = 75 + (25 * b.total() * n_docs) // n_terms
            gain = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in b}
            score = sum(gain.get(t, 0) for t in terms(text))
            if score > 0:
                found.append((-score, k is not None, k or 0, k))
        out += [(item, i + 1, k, -s) for i, (s, _, _, k) in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


def answers(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "K", "İx", "don't", "a-b"]
    docs = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 40)))) for i in range(300)]
    docs += [(1000 + i, "w1 w2 w3 same bag") for i in range(200)] + [(2000 + i, "same bag w3 w2 w1") for i in range(200)]  # a hot class
    docs += [(5, "w1 w2"), (5, "w1 w2"), (None, "w7 w8 w9"), (None, "w7 w8 w9"), (9001, None), (9002, ""), (9003, "?! -- \x7f")]
    items = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 12)))) for i in range(30)]
    items += [(50, "w1 W1 w1 same"), (50, "w1 W1 w1 same"), (51, None), (52, "..."), (53, "unknown words"), (None, "w7 w9"), (54, "same bag")]
    make = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    # names that the operator uses itself
    return docs, items, make(docs, "doc_id").selectExpr("*", "1 as score", "'x' as terms", "2 as _key"), make(items, "item_id").selectExpr("*", "3 as _block")


def test_as_the_plain_scorer(tables):
    docs, items, d, i = tables
    assert answers(ranked.ranked(d.repartition(7), i)) == plain(docs, items)
    assert answers(ranked.ranked(d, i, top=3)) == plain(docs, items, 3)


def test_blocks_change_nothing(tables, monkeypatch):
    docs, items, d, i = tables
    monkeypatch.setattr(ranked, "BLOCK", 300)
    assert ranked._blocks(i.selectExpr("item_id as _item_id", "coalesce(text, '') as _text").distinct())[1] > 1
    assert answers(ranked.ranked(d, i)) == plain(docs, items)


def test_few_cells_and_answers_change_nothing(tables, monkeypatch):
    docs, items, d, i = tables
    monkeypatch.setattr(ranked, "CELLS", 64)
    monkeypatch.setattr(ranked, "KEPT", 1)
    assert answers(ranked.ranked(d.repartition(3), i)) == plain(docs, items)


def test_empty_tables(tables):
    _, _, d, i = tables
    assert ranked.ranked(d.limit(0), i).count() == 0
    assert ranked.ranked(d, i.limit(0)).count() == 0


def test_a_very_long_text(spark):
    text = "alpha beta, " * 200_000 + "gamma"
    docs = spark.createDataFrame([(1, text), (2, "alpha gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "gamma delta")], "item_id long, text string")
    assert answers(ranked.ranked(docs, items)) == plain([(1, text), (2, "alpha gamma")], [(1, "gamma delta")])


@pytest.mark.parametrize("most", [1, 5, 16, 1000])
def test_slices_cut_no_term(most):
    draw = random.Random(most)
    for _ in range(50):
        data = "".join(draw.choices(["ab", "é", " ", ".", "x" * 40, "\x7f", "日"], k=draw.randrange(60))).encode()
        parts = list(ranked.slices(data, most))
        assert b"".join(parts) == data
        assert [t for p in parts for t in ranked.TERM.findall(p)] == ranked.TERM.findall(data)


def test_answers_hold_the_best():
    rng = np.random.default_rng(2)
    scores = rng.integers(0, 6, (500, 4))
    keys = rng.permutation(500)
    held = ranked.Answers(4, 10)
    for first in range(0, 500, 50):
        held.add(scores[first : first + 50], [[int(k)] for k in keys[first : first + 50]])
        held.choose()
    for item in range(4):
        want = sorted((-int(s), int(k)) for s, k in zip(scores[:, item], keys, strict=True) if s > 0)[:10]
        got = [(-int(s), held.members[r][0]) for i, s, r in zip(held.items[0], held.scores[0], held.rows[0], strict=True) if i == item]
        assert got == want
