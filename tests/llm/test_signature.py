"""The Jaccard join, held against all pairs."""

import random
import re

import pyarrow as pa
import pytest

from tipwatch.llm import shingles, signature

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_classes(rows):
    sets = [(k, plain_set(t)) for k, t in rows]
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                top[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: (len(s), least[find(i)]) for i, (k, s) in enumerate(sets)}


def corpus(seed, prose):
    draw = random.Random(seed)
    texts = [None, "", " \n\t", "one", "One", "one two", "a b c d", "a b c d e", "A b c d e", "x y z", "é É"]
    common = prose(40, 1)
    for g in range(14):
        base = prose(draw.randrange(12, 160), 100 * seed + g).split()
        for _ in range(draw.randrange(1, 12)):
            words = list(base)
            for _ in range(draw.randrange(0, 7)):
                at = draw.randrange(len(words))
                kind = draw.randrange(4)
                if kind == 0:
                    words[at] = "new%d" % draw.randrange(1000)
                elif kind == 1:
                    del words[at : at + draw.randrange(1, 4)]
                elif kind == 2:
                    words += prose(draw.randrange(1, 12), draw.randrange(10**6)).split()
                else:
                    words = words + words[: draw.randrange(1, len(words))] if len(words) > 1 else words
                words = words or ["empty"]
            texts.append(" ".join(words))
    # a passage that many short texts share, with own words about the bound
    for i in range(60):
        texts.append(prose(draw.randrange(2, 22), 5000 + i) + " " + common)
    # chains: each links with the next only
    chain = prose(60, 77).split()
    for i in range(0, 40, 4):
        texts.append(" ".join(chain[i:] + prose(i, 88).split()))
    draw.shuffle(texts)
    return texts


def test_sets_are_those_of_the_text(prose):
    texts = [*corpus(3, prose), "word " * 30000, "x" * 200000, " " * 100000]
    got = list(shingles.sets(pa.array(texts)))
    assert [len(s) for s in got] == [len(plain_set(t)) for t in texts]
    for i in range(0, len(texts) - 1):
        a, b = plain_set(texts[i]), plain_set(texts[i + 1])
        assert len(set(got[i].tolist()) & set(got[i + 1].tolist())) == len(a & b)


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_all_pairs(spark, make, prose, seed, monkeypatch):
    # small counts, so that common shingles are found in so small a table
    monkeypatch.setattr(signature, "COMMON", 3 if seed == 1 else 10**9)
    texts = corpus(seed, prose)
    docs = make(texts).withColumnRenamed("lang", "id").withColumnRenamed("source", "label").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature.classes(docs).collect()}
    want = plain_classes([(i + 1, t) for i, t in enumerate(texts)])
    assert got == want
    assert len({c for _, c in want.values()}) < 0.9 * len(want)


def test_nulls_repeats_and_empty_tables(spark, make):
    docs = make(["a b c d e f", "a b c d e f", None, "q r s t u v"])
    twice = docs.unionByName(docs.filter("doc_id = 4")).unionByName(docs.filter("doc_id = 2").selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in signature.classes(twice).collect())
    assert rows == [(0, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 2, 4), (4, 2, 4)]
    assert signature.classes(docs.limit(0)).count() == 0


def test_long_chains_of_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 5), (7, 7)], "a long, b long")
    got = {r.id: r.label for r in signature.components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 3, 3: 3, 7: 7}
