"""Benchmark decontamination by q-gram lemma filtering.

Pieces of a benchmark item are its windows of ``PIECE`` bytes, one every ``STEP`` bytes and one at its end, so that an
excerpt of so many bytes is found wherever it begins, and its even parts of ``PIECE`` to twice as many bytes. A shorter
item is one piece. A text region within ``k`` edits of a piece of ``m`` bytes shares at least ``m - q + 1 - k q`` of the
piece's q-grams with it, on diagonals that differ by ``k`` at most. So the q-grams that a text shares with the whole
item are sorted into overlapping diagonal bands and counted over each piece there; pieces that reach their bound are
verified by banded alignment, all of a batch at once. A document is contaminated if one piece of an item is found in it.

Bytes are compared with A-Z lowered. The benchmark is the query set: it is taken in blocks of ``BLOCK`` bytes, each
broadcast in turn, and every text is read whole against it; texts never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Q, PIECE, EDITS, BLOCK = 8, 80, 0.08, 4 << 20
# Bytes from one window to the next: an excerpt of PIECE bytes lacks half of them at most, fewer than a window's edits.
STEP = 8
# Pieces of a block share a bit table of this many bits, looked up before the exact q-grams.
BITS = 22
# Bytes of text taken together, positions looked up at a time, and alignments done at a time.
TOGETHER, STRIDE, ALIGNED = 1 << 20, 1 << 16, 2048
# Rows and items are counted in a table of up to so many cells; rows of integers are sorted by one number of 63 bits up
# to so many combinations.
CELLS, WHOLE = 1 << 20, 1 << 62
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The pieces of a block of items, and the q-grams of the items. Pieces of under Q bytes hold no q-gram and are left
    out; those of an item stand together."""

    def __init__(self, items: list[tuple[object, str]]):
        self.items, wholes, starts, sizes, counts = [], [], [], [], []
        for item, text in items:
            data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            n = len(data)
            even = np.cumsum([0, *(len(x) for x in np.array_split(data, max(1, n // PIECE)))])
            last = max(0, n - PIECE)
            cuts = {(int(a), int(b - a)) for a, b in zip(even[:-1], even[1:], strict=True) if b - a >= Q}
            cuts |= {(a, PIECE) for a in [*range(0, last, STEP), last] if n >= PIECE}
            if cuts:
                self.items += [item] * len(cuts)
                wholes.append(data)
                counts.append(len(cuts))
                starts += [a for a, _ in sorted(cuts)]
                sizes += [m for _, m in sorted(cuts)]
        # pieces: place in their item, bytes, edits allowed, least q-grams shared, and the item's number
        self.starts, self.sizes = np.array(starts, np.int64), np.array(sizes, np.int64)
        self.edits = (self.sizes * EDITS).astype(np.int64)
        self.least = self.sizes - Q + 1 - self.edits * Q
        self.whole = np.repeat(np.arange(len(wholes)), counts)
        # items: first piece, bytes, and of their pieces the most edits, the least bound and the greatest size
        self.parts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)
        self.data = np.concatenate([np.empty(0, np.uint8), *wholes])
        self.ends = np.concatenate([[0], np.cumsum([len(w) for w in wholes], dtype=np.int64)]).astype(np.int64)
        fold = lambda f, x: f.reduceat(x, self.parts[:-1]) if len(x) else x
        self.widest, self.lowest, self.longest = fold(np.maximum, self.edits), fold(np.minimum, self.least), fold(np.maximum, self.sizes)
        grams = [grams_of(w) for w in wholes]
        flat = np.concatenate([np.empty(0, np.uint64), *grams])
        own = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        offset = np.concatenate([np.empty(0, np.int64), *[np.arange(len(g)) for g in grams]])
        order = np.argsort(flat, kind="stable")
        self.grams, self.begin = np.unique(flat[order], return_index=True)
        self.begin = np.append(self.begin, len(flat))
        self.own, self.offset = own[order], offset[order]
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[(self.grams * SPREAD) >> np.uint64(64 - BITS)] = True

    @property
    def texts(self) -> list[np.ndarray]:
        low = self.ends[self.whole] + self.starts
        return [self.data[a : a + m] for a, m in zip(low.tolist(), self.sizes.tolist(), strict=True)]


def grams_of(data: np.ndarray) -> np.ndarray:
    """The 8-byte code of the q-gram at every position but the last Q - 1."""
    if len(data) < Q:
        return np.empty(0, np.uint64)
    codes = np.empty(len(data) - Q + 1, "<u8")
    for k in range(min(Q, len(codes))):  # every Q-th code lies as it is in the bytes
        own = codes[k::Q]
        own[:] = np.frombuffer(data[k : k + Q * len(own)].tobytes(), "<u8")
    return codes


def _hits(data: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``data`` whose q-gram some piece has, and which it is."""
    where, which = [], []
    for a in range(0, max(0, len(data) - Q + 1), STRIDE):
        codes = grams_of(data[a : a + STRIDE + Q - 1])
        at = np.flatnonzero(pieces.bits[(codes * SPREAD) >> np.uint64(64 - BITS)])
        found = np.searchsorted(pieces.grams, codes[at])
        ok = pieces.grams[np.minimum(found, len(pieces.grams) - 1)] == codes[at]
        where.append(at[ok] + a)
        which.append(found[ok])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *where]), np.concatenate([none, *which])


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """The different rows of integer columns in order: by one number for a row where that fits, else by all columns."""
    lows = [int(c.min()) for c in columns]
    spans = [int(c.max()) - a + 1 for c, a in zip(columns, lows, strict=True)]
    if prod(spans) > WHOLE:
        keys = np.stack(columns)
        keys = keys[:, np.lexsort(keys[::-1])]
        return list(keys[:, np.concatenate([[True], np.any(keys[:, 1:] != keys[:, :-1], axis=0)])])
    key = np.zeros(len(columns[0]), np.int64)
    for c, a, span in zip(columns, lows, spans, strict=True):
        key = key * span + (c - a)
    key = np.sort(key)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    out = []
    for a, span in zip(lows[::-1], spans[::-1], strict=True):
        rest = key // span
        out.append(key - rest * span + a)
        key = rest
    return out[::-1]


def _bands(where: np.ndarray, which: np.ndarray, row: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, ...]:
    """(row, piece, first diagonal of the piece) for pieces that reach their bound within a band."""
    counts = pieces.begin[which + 1] - pieces.begin[which]
    each = np.repeat(np.arange(len(where)), counts)
    inner = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
    posting = pieces.begin[which][each] + inner
    own, row = pieces.own[posting], row[each]
    # most items share too little with the whole row already
    n = len(pieces.lowest)
    pair = row * n + own
    cells = n * (int(row.max()) + 1) if len(pair) else 0
    if cells <= CELLS:
        enough = np.bincount(pair, minlength=cells) >= np.maximum(np.tile(pieces.lowest, cells // n), 1)
        live, ok = np.flatnonzero(enough), enough[pair]
        at = (np.cumsum(enough) - 1)[pair]
    else:
        ordered = np.sort(pair)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        total, ordered = np.diff(np.append(first, len(pair))), ordered[first]
        live = ordered[total >= pieces.lowest[ordered % n]]
        at = np.searchsorted(live, pair)
        ok = live[np.minimum(at, len(live) - 1)] == pair if len(live) else np.zeros(len(pair), bool)
    own, pair, offset = own[ok], at[ok], pieces.offset[posting[ok]]
    diagonal = where[each[ok]] - offset
    none = np.empty(0, np.int64)
    if not len(own):
        return none, none, none
    step = pieces.widest[own] + 1  # a band of two steps holds any k + 1 diagonals in a row that begin in its first half
    low = np.floor_divide(diagonal, step)
    # every q-gram of the item counts once in a band
    pair, low, offset = _distinct(np.concatenate([pair, pair]), np.concatenate([low, low - 1]), np.concatenate([offset, offset]))
    group = np.cumsum(np.concatenate([[False], (pair[1:] != pair[:-1]) | (low[1:] != low[:-1])]))
    row, own = live[pair] // n, live[pair] % n
    # bands with as many q-grams as the least bound asks for, no farther apart than in the longest piece
    far = np.arange(len(group)) + np.maximum(pieces.lowest[own], 1) - 1
    inside = np.minimum(far, len(group) - 1)
    near = (far < len(group)) & (group[inside] == group) & (offset[inside] - offset <= pieces.longest[own] - Q)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    bands = np.unique(group[near])
    span = int(pieces.ends.max()) + 1
    place = group * span + offset
    out = [(none, none, none)]
    row, own, low = (x[first[bands]] for x in (row, own, low))
    parts = pieces.parts[own + 1] - pieces.parts[own]
    sums = np.cumsum(parts)
    a = 0
    while a < len(bands):  # so many bands at a time that their pieces stay few
        b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + TOGETHER, side="right")))
        band = np.repeat(np.arange(a, b), parts[a:b])
        piece = pieces.parts[own[band]] + np.arange(len(band)) - np.repeat(np.cumsum(parts[a:b]) - parts[a:b], parts[a:b])
        begin = bands[band] * span + pieces.starts[piece]
        total = np.searchsorted(place, begin + pieces.sizes[piece] - Q + 1) - np.searchsorted(place, begin)
        ok = total >= np.maximum(pieces.least[piece], 1)
        band, piece = band[ok], piece[ok]
        out.append((row[band], piece, low[band] * (pieces.widest[own[band]] + 1) + pieces.starts[piece]))
        a = b
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _align(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, row, piece, diagonal, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each piece and a stretch of its row near the band, and where that stretch ends."""
    k, m = pieces.widest[pieces.whole[piece]], pieces.sizes[piece]
    width = int(4 * k.max() + 3)  # two steps of diagonals and k more on either side
    column = np.arange(width, dtype=np.int16)
    start = diagonal - k
    low = pieces.ends[pieces.whole[piece]] + pieces.starts[piece]
    text = pieces.data[np.minimum(low[:, None] + np.arange(int(m.max())), len(pieces.data) - 1)]
    # all bytes that a piece may meet; no byte equals those outside its row
    at = start[:, None] + np.arange(int(m.max()) + width)
    outside = (at < begins[row][:, None]) | (at >= ends[row][:, None])
    near = np.where(outside, np.int16(256), data[np.clip(at, 0, len(data) - 1)])
    best, end = np.full(len(piece), 1 << 30), np.zeros(len(piece), np.int64)
    # costs grow by one a byte at most, and pieces have fewer than twice PIECE bytes
    cost = np.zeros((len(piece), width), np.int16)
    far = np.full((len(piece), 1), 1 << 14, np.int16)
    for i in range(int(m.max()) + 1):
        if i:
            differs = near[:, i - 1 : i - 1 + width] != text[:, i - 1 : i]
            skipped = np.concatenate([cost[:, 1:], far], axis=1) + 1
            cost = np.minimum(cost + differs, skipped)
            cost = np.minimum.accumulate(cost - column, axis=1) + column
        done = m == i
        if done.any():
            j = cost[done].argmin(axis=1)
            best[done], end[done] = cost[done].min(axis=1), start[done] + i + j
    return best, np.minimum(end, ends[row])


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column as they lie in memory, and the end of each row in them; nulls are empty."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[ends[0] : ends[-1]] if len(column) else whole[:0], ends - ends[0] if len(column) else np.zeros(1, np.int64)


def _stretches(ends: np.ndarray, overlap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows in groups of about TOGETHER bytes as (first row, begins, ends); a longer row comes alone, in stretches that
    overlap by what a piece with its edits can take."""
    a = 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + TOGETHER, side="right")) - 1)
        if ends[b] - ends[a] <= TOGETHER:
            yield a, ends[a:b], ends[a + 1 : b + 1]
        else:
            for begin in range(int(ends[a]), int(ends[b]), TOGETHER):
                yield a, np.array([begin]), np.array([min(begin + TOGETHER + overlap, ends[b])])
        a = b


def found_in(column: pa.Array, pieces: Pieces) -> dict[str, np.ndarray]:
    """Per piece found in a row: row, piece, edits, and end of the stretch in bytes of the text."""
    names = ("row", "piece", "edits", "end")
    out = {k: [np.empty(0, np.int64)] for k in names}
    if not len(pieces.sizes):
        return {k: v[0] for k, v in out.items()}
    raw, ends = _buffers(column)
    for top, begins, stops in _stretches(ends, int((pieces.sizes + 4 * pieces.edits + 4).max())):
        low = begins[0]
        data, begins, stops = LOWER[raw[low : stops[-1]]], begins - low, stops - low
        where, which = _hits(data, pieces)
        row = np.searchsorted(stops, where, side="right")
        inside = where + Q <= stops[np.minimum(row, len(stops) - 1)]
        row, piece, diagonal = _bands(where[inside], which[inside], row[inside], pieces)
        for a in range(0, len(row), ALIGNED):
            b = slice(a, a + ALIGNED)
            edits, end = _align(data, begins, stops, row[b], piece[b], diagonal[b], pieces)
            ok = edits <= pieces.edits[piece[b]]
            found = (row[b][ok] + top, piece[b][ok], edits[ok], end[ok] + low - ends[row[b][ok] + top])
            for k, v in zip(names, found, strict=True):
                out[k].append(v)
    row, piece, edits, end = (np.concatenate(out[k]) for k in names)
    # the same stretch may reach the bound in two bands
    order = np.lexsort((end, edits, piece, row))
    row, piece, edits, end = row[order], piece[order], edits[order], end[order]
    first = np.concatenate([[True], (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])])[: len(row)]
    return {"row": row[first], "piece": piece[first], "edits": edits[first], "end": end[first]}


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", limit: int = BLOCK) -> Iterator[Pieces]:
    """The benchmark in blocks of ``limit`` bytes of text, fetched one after another; null texts are left out."""
    held, size = [], 0
    for row in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).dropna(subset=["t"]).toLocalIterator():
        if held and size + len(row.t) > limit:
            yield Pieces(held)
            held, size = [], 0
        held.append((row.i, row.t))
        size += len(row.t)
    if held:
        yield Pieces(held)


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """A row per document and item of which a piece is found: ``key``, ``item``, pieces found, least edits, and begin
    and end in bytes of the first stretch (its begin is taken as its end less the piece's length).

    Null and empty texts hold nothing; items of under Q bytes are never found; repeated rows give repeated results and
    a null key or item stays null. An empty benchmark or table gives no rows.
    """
    spark = docs.sparkSession
    lean = docs.select(F.col(key).alias(key), F.col(text).cast(StringType()).alias("_text"))
    types = benchmark.schema[item].dataType
    schema = lean.select(key).schema.add(item, types)
    for name in ("n_pieces", "n_edits", "begin_byte", "end_byte"):
        schema = schema.add(name, "long")

    def one(pieces: Pieces) -> DataFrame:
        shared = spark.sparkContext.broadcast(pieces)

        def run(batches):
            pieces = shared.value
            for batch in batches:
                got = found_in(batch.column(1), pieces)
                out: dict[tuple, list] = {}
                for row, piece, edits, end in zip(*(got[k].tolist() for k in ("row", "piece", "edits", "end")), strict=True):
                    place = (end - int(pieces.sizes[piece]), end)
                    had = out.setdefault((row, pieces.items[piece]), [0, edits, place])
                    had[0] += 1
                    had[1:] = [min(had[1], edits), min(had[2], place)]
                rows = pa.array([r for r, _ in out], pa.int64())
                kind = kinds.field(1).type
                columns = [batch.column(0).take(rows), pa.array([i for _, i in out], kind)]
                columns += [pa.array(x, pa.int64()) for x in zip(*((n, e, max(0, a), b) for n, e, (a, b) in out.values()), strict=True)] or [pa.array([], pa.int64())] * 4
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(0), *list(kinds)[1:]]))

        return lean.mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    parts = [one(p) for p in blocks(benchmark, item, "text")]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """``docs`` without the rows in which a piece of the benchmark is found; a pass over the texts for each block."""
    spark = docs.sparkSession

    def without(docs: DataFrame, pieces: Pieces) -> DataFrame:
        shared = spark.sparkContext.broadcast(pieces)

        def run(batches):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[found_in(batch.column(batch.schema.get_field_index(text)), shared.value)["row"]] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)

    return reduce(without, blocks(benchmark, item, "text"), docs)
