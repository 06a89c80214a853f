"""Fill-in-middle: texts cut in three at two drawn units, and put together again behind markers.

Bytes fall into classes of characters (bytes within a character, line feeds, other blanks, letters, digits, other ASCII
and first bytes of characters of two, three and four bytes). A wavelet matrix over the classes of some texts answers how
many bytes of a class lie before a place. The classes that begin a unit (or end it, for lines) add up to the number of
unit boundaries before any place, and bisection on that number finds both cuts of all texts at once.

Every row has a result. Null texts count as empty, and empty ones are plain; a null key is drawn as an empty one;
repeated rows and equal texts are cut by their keys alone; a text larger than a group is a group of its own. Only the key
and the text are read, so other columns may have any names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
GROUP = 1 << 20  # bytes of text per wavelet matrix
INSIDE, FEED, BLANK, LETTER, DIGIT, TWO, THREE, FOUR = range(8)
BITS = 3
# Classes whose bytes are counted, and whether such a byte begins a unit or ends it.
UNITS = {"char": ({FEED, BLANK, LETTER, DIGIT, TWO, THREE, FOUR}, True), "line": ({FEED}, False)}
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def classes() -> np.ndarray:
    """The class of each byte; other ASCII characters go with the digits."""
    kind = np.full(256, DIGIT, np.uint8)
    kind[[9, 11, 12, 13, 32]] = BLANK
    kind[10] = FEED
    kind[65:91] = kind[97:123] = LETTER
    kind[128:192], kind[192:224], kind[224:240], kind[240:] = INSIDE, TWO, THREE, FOUR
    return kind


class WaveletMatrix:
    """Levels of bits, the highest bit first; at each level symbols with a 0 go before those with a 1."""

    def __init__(self, symbols: np.ndarray, bits: int = BITS):
        self.bits, self.levels = bits, []
        for level in reversed(range(bits)):
            bit = (symbols >> level) & 1 == 1
            packed = np.zeros(len(symbols) // 64 * 8 + 8, np.uint8)
            some = np.packbits(bit, bitorder="little")
            packed[: len(some)] = some
            words = packed.view("<u8")
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((words, ranks, len(symbols) - int(ranks[-1])))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        words, ranks, _ = self.levels[level]
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return ranks[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def rank(self, prefix: int, depth: int, at: np.ndarray) -> np.ndarray:
        """How many symbols before each place begin with the ``depth`` bits of ``prefix``."""
        low, high = np.zeros(1, np.int64), at
        for level in range(depth):
            if prefix >> (depth - 1 - level) & 1:
                zeros = self.levels[level][2]
                low, high = zeros + self._ones(level, low), zeros + self._ones(level, high)
            else:
                low, high = low - self._ones(level, low), high - self._ones(level, high)
        return high - low


def cover(wanted: set[int], bits: int = BITS) -> list[tuple[int, int]]:
    """The fewest (prefix, depth) whose symbols are the wanted ones."""
    out, todo = [], [(0, 0)]
    while todo:
        prefix, depth = todo.pop()
        under = set(range(prefix << (bits - depth), (prefix + 1) << (bits - depth)))
        if under <= wanted:
            out.append((prefix, depth))
        elif under & wanted:
            todo += [(2 * prefix, depth + 1), (2 * prefix + 1, depth + 1)]
    return out


class Boundaries:
    """Counts and places of unit boundaries in texts that lie one after another in ``data``."""

    def __init__(self, data: np.ndarray, unit: str = "char"):
        wanted, self.begins = UNITS[unit]
        self.data, self.nodes = data, cover(wanted)
        self.matrix = WaveletMatrix(classes()[data])

    def count(self, at: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(prefix, depth, at) for prefix, depth in self.nodes)

    def units(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Units of the texts from ``low`` to ``high``; lines include a last one without its line feed."""
        found = self.count(high) - self.count(low)
        if self.begins:
            return found
        last = self.data[np.maximum(high - 1, 0)] if len(self.data) else np.zeros(len(high), np.uint8)
        return found + ((high > low) & (last != 10))

    def cuts(self, low: np.ndarray, high: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The place in each text after so many units, by bisection on the counts."""
        base = self.count(low)
        left, right = low.copy(), high.copy()
        while (left < right).any():
            if self.begins:  # the last place with no more beginnings before it
                mid = (left + right + 1) >> 1
                ok = self.count(mid) - base <= units
                left, right = np.where(ok, mid, left), np.where(ok, right, mid - 1)
            else:  # the first place with as many ends before it, or the end of the text
                mid = (left + right) >> 1
                ok = (self.count(mid) - base >= units) | (mid == high)
                left, right = np.where(ok, left, mid + 1), np.where(ok, mid, right)
        return left


def groups(ends: np.ndarray, most: int = GROUP) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes, or of one row; ``ends`` has where rows begin, and where the last ends."""
    first = 0
    while first < len(ends) - 1:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield first, last
        first = last


def _cut(batches: Iterator[pa.RecordBatch], unit: str, plain_from: int, spm_below: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, drawn = batch.column("_key"), [batch.column(f"_h{i}").to_numpy(zero_copy_only=False) for i in range(1, 5)]
        texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        for first, last in groups(ends):
            data = whole[ends[first] : ends[last]]
            raw, low, high = data.tobytes(), ends[first:last] - ends[first], ends[first + 1 : last + 1] - ends[first]
            h1, h2, h3, h4 = (h[first:last] for h in drawn)
            bounds = Boundaries(data, unit)
            n = bounds.units(low, high)
            one, two = h1 % (n + 1), h2 % (n + 1)
            near, far = np.minimum(one, two), np.maximum(one, two)
            a, b = bounds.cuts(low, high, near), bounds.cuts(low, high, far)
            p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
            forms, outputs = [], []
            for i in range(last - first):
                text = raw[low[i] : high[i]]
                if not text or h3[i] % 100 >= plain_from or p in text or s in text or m in text:
                    forms.append("plain")
                    outputs.append(text)
                    continue
                head, body, tail = raw[low[i] : a[i]], raw[a[i] : b[i]], raw[b[i] : high[i]]
                spm = h4[i] % 100 < spm_below
                forms.append("spm" if spm else "psm")
                outputs.append(b"".join((s, tail, p, head, m, body) if spm else (p, head, s, tail, m, body)))
            plain = np.array([f == "plain" for f in forms])
            yield pa.RecordBatch.from_arrays(
                [
                    keys.slice(first, last - first),
                    pa.array(n, pa.int64()),
                    pa.array(forms, pa.string()),
                    pa.array(near, pa.int64(), mask=plain),
                    pa.array(far - near, pa.int64(), mask=plain),
                    pa.array(outputs, pa.binary()).cast(pa.string(), safe=False),
                ],
                names=["_key", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def transform(docs: DataFrame, seed: int = 1, unit: str = "char", plain_from: int = 90, spm_below: int = 20, key: str = "doc_id") -> DataFrame:
    """Key, n units, form (plain, psm or spm), units of prefix and middle, and the whole output text.

    The draws are the groups of eight hexadecimal digits of the hash of ``seed``:key.
    """
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(name, 8 * i - 7, 8), 16, 10).cast("long").alias(f"_h{i}") for i in range(1, 5)]
    rows = docs.select(F.col(key).alias("_key"), F.col("text").cast("string").alias("text"), *drawn)
    kind = dict(rows.dtypes)["_key"]
    out = rows.mapInArrow(lambda batches: _cut(batches, unit, plain_from, spm_below), f"_key {kind}, {SCHEMA}")
    return out.withColumnRenamed("_key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of: no part holds a marker, and none arises where a part meets a marker."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
