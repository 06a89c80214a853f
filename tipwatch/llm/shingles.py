"""Word shingles of a batch of texts as sorted sets of 64-bit hashes, by whole-array operations.

Two shingles of a corpus share a hash by chance with probability n^2 / 2^65 for n different ones: one such pair, which
moves a similarity by less than one shingle, is to be expected at about six billion different shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
# Texts are taken together up to this many bytes; a longer one is taken alone.
TOGETHER = 1 << 16
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_GAP = np.zeros(256, bool)
IS_GAP[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(0, n - 1), BASE, np.uint64))])[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column as they lie in memory and where its rows begin and end; nulls are empty."""
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; of all its words together where it has fewer."""
    data, ends = buffers(column)
    a = 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + TOGETHER, side="right")) - 1)
        yield from _block(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], words)
        a = b


def _block(raw: np.ndarray, ends: np.ndarray, words: int) -> Iterator[np.ndarray]:
    data = LOWER[raw]
    inside = ~IS_GAP[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]
    begins[first] = inside[first]  # words do not go on into the next text
    at = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(at, ends))  # words of each text
    if len(at):
        word = np.cumsum(begins) - 1
        place = np.arange(len(data)) - at[word.clip(0)]
        power = _powers(int(place[inside].max()) + 1)
        terms = np.zeros(len(data), np.uint64)
        terms[inside] = (data[inside].astype(np.uint64) + np.uint64(1)) * power[place[inside]]
        hashes = mixed(np.add.reduceat(terms, at))
    else:
        hashes = np.empty(0, np.uint64)
    factors = _powers(words + 1)[1:]
    if len(hashes) >= words:
        n = len(hashes) - words + 1
        windows = mixed(sum(hashes[k : k + n] * factors[k] for k in range(words)))
    begin = 0
    for n in counts.tolist():
        if n >= words:
            own = np.sort(windows[begin : begin + n - words + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            yield mixed(np.array([(hashes[begin : begin + n] * factors[:n]).sum() + np.uint64(n)], np.uint64))
        else:
            yield np.empty(0, np.uint64)
        begin += n
