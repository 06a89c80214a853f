"""Q-gram filtering with banded alignment, held against plain alignment of every piece with every text."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tipwatch.llm import decontaminate as d


def least_edits(piece, text):
    """Edits between the piece and the nearest stretch of the text (Sellers)."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(piece, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def spoiled(text, edits, draw):
    out = list(text)
    for _ in range(edits):
        at = draw.randrange(max(1, len(out)))
        kind = draw.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 0 else [draw.choice("xyz")]
    return "".join(out)


@pytest.fixture(scope="module")
def cases():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(draw.randrange(8, 40))) for i in range(12)] + [(90, "tiny"), (91, ""), (92, None), (93, "Exactly This Line.")]
    texts = []
    for i, (_, item) in enumerate(items):
        for edits in (0, 3, 6, 9, 14, 30):
            texts.append(prose(15) + " " + spoiled((item or "none").upper() if i % 2 else item or "none", edits, draw) + " " + prose(i))
    texts += [None, "", "short", items[0][1], items[1][1][:60], prose(400) + items[2][1] + "\n" + items[3][1], "so exactly this line. or"]
    return items, texts


def test_found_as_by_plain_alignment(cases):
    items, texts = cases
    pieces = d.Pieces(items)
    got = d.found_in(pa.array(texts), pieces)
    found = {(r, p): e for r, p, e in zip(got["row"], got["piece"], got["edits"], strict=True)}
    lowered = [bytes(d.LOWER[np.frombuffer((t or "").encode(), np.uint8)]) for t in texts]
    want = {}
    for r, text in enumerate(lowered):
        for p in range(len(pieces.texts)):
            edits = least_edits(bytes(pieces.texts[p]), text)
            if edits <= pieces.edits[p]:
                want[r, p] = edits
    assert found == want
    assert len({e for e in want.values()}) > 3 and len(want) > 40


def test_long_rows_go_in_stretches(cases, monkeypatch):
    items, texts = cases
    pieces = d.Pieces(items)
    whole = d.found_in(pa.array(texts), pieces)
    monkeypatch.setattr(d, "TOGETHER", 200)
    parts = d.found_in(pa.array(texts), pieces)
    assert all((whole[k] == parts[k]).all() for k in whole)


def test_tables(spark, make, cases):
    items, texts = cases
    docs = make(texts).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "n_edits")
    bench = spark.createDataFrame(items, "item_id long, text string")
    pieces = d.Pieces([(i, t) for i, t in items if t])
    got = d.found_in(pa.array(texts), pieces)
    want = {(int(r) + 1, pieces.items[p]) for r, p in zip(got["row"], got["piece"], strict=True)}
    rows = d.matches(docs.repartition(3), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    data = {i + 1: (t or "").encode() for i, t in enumerate(texts)}
    assert all(0 <= r.begin_byte < r.end_byte <= len(data[r.doc_id]) for r in rows)
    kept = {r.doc_id for r in d.decontaminated(docs, bench).collect()}
    assert kept == set(data) - {r for r, _ in want}


def test_blocks_and_empty_tables(spark, make, cases, monkeypatch):
    items, texts = cases
    docs, bench = make(texts), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, d.matches(docs, bench).collect()))
    small = list(d.blocks(bench, limit=300))
    assert len(small) > 4
    monkeypatch.setattr(d, "blocks", lambda *a: iter(small))
    assert sorted(map(tuple, d.matches(docs, bench).collect())) == whole
    monkeypatch.undo()
    assert d.matches(docs, bench.limit(0)).count() == 0
    assert d.matches(docs.limit(0), bench).count() == 0
    assert d.decontaminated(docs, bench.limit(0)).count() == len(texts)


@pytest.mark.parametrize("share", [0.85, 0.7, 0.5])
def test_excerpts_are_found_wherever_they_begin(share):
    """Verbatim parts of an item of PIECE bytes and more, across any even cut; clean texts hold nothing."""
    draw = random.Random(11)
    prose = lambda n: " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(2, 9))) for _ in range(n))
    items = [(i, prose(draw.randrange(16, 70))) for i in range(60)]
    texts, want = [], set()
    for i, item in items:
        n = max(d.PIECE, int(len(item) * share))
        for at in (0, (len(item) - n) // 2, len(item) - n):
            if at >= 0:
                want.add((len(texts), i))
                texts.append(prose(12) + " " + item[at : at + n] + " " + prose(12))
    texts += [prose(60) for _ in range(20)]
    pieces = d.Pieces(items)
    got = d.found_in(pa.array(texts), pieces)
    assert {(r, pieces.items[p]) for r, p in zip(got["row"].tolist(), got["piece"].tolist(), strict=True)} == want
    assert len(want) > 120
    # fixed cases of the review: a one-piece item less 13 bytes, and a part across the cut of a two-piece item
    one, two = prose(40)[:150], prose(60)[:233]
    cut = d.found_in(pa.array([prose(9) + one[13:] + prose(9), prose(9) + two[12:220] + prose(9)]), d.Pieces([(0, one), (1, two)]))
    assert set(cut["row"].tolist()) == {0, 1}


def test_bands_are_the_same_by_one_number_or_all_columns(cases, monkeypatch):
    """Bands are sorted by one number a row, and rows counted in a table of cells, where those fit."""
    items, texts = cases
    pieces = d.Pieces(items)
    draw = np.random.default_rng(3)
    columns = [draw.integers(-3, 4, 500) for _ in range(3)]
    want = sorted(set(zip(*(c.tolist() for c in columns), strict=True)))
    assert list(zip(*(c.tolist() for c in d._distinct(*columns)), strict=True)) == want
    narrow = d.found_in(pa.array(texts), pieces)
    monkeypatch.setattr(d, "WHOLE", 0)
    assert list(zip(*(c.tolist() for c in d._distinct(*columns)), strict=True)) == want
    monkeypatch.setattr(d, "CELLS", 0)
    wide = d.found_in(pa.array(texts), pieces)
    assert len(wide["row"]) and all((wide[k] == narrow[k]).all() for k in wide)
