"""Substring dedup, held against a plain dictionary of all windows."""

import random
from hashlib import sha256

import numpy as np
import pytest

from tipwatch.llm import suffixes


def plain(rows, length=100):
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(data), sum(gone), runs, sha256(kept).hexdigest())
    return out


def corpus(seed, prose):
    draw = random.Random(seed)
    passages = [prose(60, i) for i in range(4)] + ["é" * 80 + prose(20, 9), "ab" * 130]
    texts = ["", None, "x" * 99, "x" * 100, "x" * 101, "x" * 100, "y" * 350, "xyz" * 90, prose(3000, 50)]
    for i in range(70):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            if draw.random() < 0.5:
                parts.append(prose(draw.randrange(1, 60), draw.randrange(10**6)))
            else:
                p = draw.choice(passages)
                a = draw.randrange(len(p) // 2)
                parts.append(p[a : a + draw.randrange(60, 400)])
        texts.append(draw.choice(["", " ", "\n"]).join(parts))
    texts += [texts[20], texts[21], texts[8][500:9000], passages[0] + passages[0] + passages[0]]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, make, prose, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(suffixes, "BLOCK", 1000)
        monkeypatch.setattr(suffixes, "CHUNK", 3000)
    texts = corpus(seed, prose)
    docs = make(texts).withColumnRenamed("lang", "kept").withColumnRenamed("source", "begin").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.substring_dedup(docs).collect()}
    want = plain([(i + 1, t) for i, t in enumerate(texts)])
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert sum(v[1] > 0 for v in want.values()) > 30


def test_small_batches_scan_alike(spark, make, prose):
    texts = corpus(3, prose)
    docs = make(texts)
    want = plain([(i + 1, t) for i, t in enumerate(texts)])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.substring_dedup(docs, keep_bytes=False).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want


def test_interval_tree_gives_all_maximal_repeats():
    draw = random.Random(4)
    for _ in range(40):
        data = bytes(draw.choice(b"ab") for _ in range(12)) * 0 + bytes(draw.choice(b"abc") for _ in range(draw.randrange(130, 700)))
        piece = data[:110]
        data += piece + b"z" + piece[5:] + piece
        arr = np.frombuffer(data, np.uint8)
        cut = sorted(draw.sample(range(1, len(data)), 3))
        begins, ends = np.array([0, *cut]), np.array([*cut, len(data)])
        # contexts are short in use; take care of the width here
        suffixes_wide = -(-len(data) // 8) + 1
        old, suffixes.WIDE = suffixes.WIDE, suffixes_wide
        try:
            got = {(n, tuple(p.tolist())) for n, p in suffixes.interval_tree(arr, begins, ends)}
        finally:
            suffixes.WIDE = old
        want = {}
        spans = list(zip(begins.tolist(), ends.tolist(), strict=True))
        strings = {}
        for a, b in spans:
            for i in range(a, b - 99):
                for n in range(100, b - i + 1):
                    strings.setdefault(data[i : i + n], []).append(i)
        end_of = {i: b for a, b in spans for i in range(a, b)}
        starts = set(begins.tolist())
        for s, places in strings.items():
            if len(places) < 2:
                continue
            right = {data[p + len(s)] if p + len(s) < end_of[p] else -1 - p for p in places}
            left = {data[p - 1] if p not in starts else -1 - p for p in places}
            if len(right) > 1 and len(left) > 1:
                want[len(s), tuple(sorted(places))] = True
        assert got == set(want)


def test_nulls_repeats_and_empty_tables(spark, make):
    long = "abcdefgh" * 5 + "0123456789" * 9
    docs = make([long, "no", long])
    more = docs.filter("doc_id = 3").selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars")
    out = {r.doc_id: r.n_removed for r in suffixes.substring_dedup(docs.unionByName(more)).collect()}
    want = plain([(1, long), (2, "no"), (3, long), (None, long)])
    assert out == {k: v[1] for k, v in want.items()} and out[3] == out[None] == len(long)
    twice = suffixes.substring_dedup(docs.unionByName(docs.filter("doc_id = 1"))).collect()
    assert sorted((r.doc_id, r.n_removed > 100) for r in twice) == [(1, False), (1, False), (2, False), (3, True)]
    assert suffixes.substring_dedup(docs.limit(0)).count() == 0
