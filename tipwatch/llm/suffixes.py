"""Exact substring dedup by common-prefix interval trees over enhanced suffix arrays.

Every byte goes that lies in a string of ``LENGTH`` bytes which also begins earlier (in a smaller document, or earlier
in the same one). Equal strings must meet in one task without sending all positions there:

* Each window of LENGTH bytes has an anchor, the K-gram of least hash in it (the first of equals). Equal windows have
  equal anchors at equal places, so windows are grouped by their anchor's hash, some 37 neighbours at a time: a group's
  windows of one place make up a context of LENGTH to LENGTH + 72 bytes.
* Contexts that are equal throughout are one leaf: all but the first are covered. Anchors that occur once, which is
  most of a corpus, end here.
* Anchors with different contexts send one context of each kind. A task builds the suffix array of their bytes with its
  longest common prefixes and scans it with a stack: the intervals of depth LENGTH and more whose occurrences differ in
  the byte before them are the maximal repeats, each with all its occurrences; all but the first one are covered.

Contexts are told apart by 64-bit hashes within the group of a 64-bit hash; the suffix arrays compare bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .shingles import buffers, mixed
from .signature import TABLE_BITS, _bit_table, _is_set

LENGTH, K = 100, 28
SPAN = LENGTH - K + 1  # K-grams in a window
# Bytes hashed at a time (places in a block take PLACE bits of the key that is minimised), and bytes per suffix array.
BLOCK, PLACE, CHUNK = 1 << 16, 20, 1 << 20
# 8-byte words that hold the longest suffix of a context.
WIDE = (LENGTH + SPAN + 7) // 8
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _codes(data: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(data, 8).copy().view("<u8").ravel()


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the K-gram at each place."""
    codes, n = _codes(data), len(data) - K + 1
    parts = (codes[at : at + n] * f for at, f in zip((0, 8, 16, K - 8), FACTORS, strict=True))
    return mixed(sum(parts))


def _windows(grams: np.ndarray) -> np.ndarray:
    """Hash of the window of LENGTH bytes at each place, from those of the K-grams that cover it."""
    n = len(grams) - LENGTH + K
    return mixed(sum(grams[at : at + n] * f for at, f in zip((0, K, 2 * K, LENGTH - K), FACTORS, strict=True)))


def _anchors(grams: np.ndarray) -> np.ndarray:
    """Place of the anchor of each window."""
    low = (grams >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= SPAN:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (SPAN - size)], low[SPAN - size :])
    return (low & np.uint64((1 << PLACE) - 1)).astype(np.int64)


def contexts(column: pa.Array) -> Iterator[dict[str, np.ndarray]]:
    """For blocks of the texts: anchor, context (hashes), row, begin and end (bytes of the text) of every context, and
    the block's bytes with the place of the context in them. Windows end with their text; long texts come in blocks
    that overlap by what a window needs, so every window is in one context."""
    data, ends = buffers(column)
    a = 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + BLOCK, side="right")) - 1)
        for begin in range(int(ends[a]), max(int(ends[a]) + 1, int(ends[b])), BLOCK):
            end = min(int(ends[b]), begin + BLOCK + LENGTH - 1)
            if end - begin >= LENGTH:
                yield from _block(data[begin:end], ends, begin, a, b)
        a = b


def _block(data: np.ndarray, ends: np.ndarray, begin: int, a: int, b: int) -> Iterator[dict[str, np.ndarray]]:
    grams = _grams(data)
    windows, anchors = _windows(grams), _anchors(grams)
    place = np.arange(len(windows))
    row = np.searchsorted(ends[a : b + 1], place + begin, side="right") - 1 + a
    ok = place + begin + LENGTH <= ends[row + 1]
    place, row, anchor = place[ok], row[ok], anchors[ok]
    if not len(place):
        return
    change = np.ones(len(place), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(place)) - 1
    low, high, row, anchor = place[first], place[last], row[first], anchor[first]
    same = mixed(windows[low] * FACTORS[0] + windows[high] * FACTORS[1] + ((high - low) * 128 + anchor - low).astype(np.uint64))
    yield {
        "anchor": grams[anchor].view(np.int64),
        "context": same.view(np.int64),
        "row": row,
        "begin": low + begin - ends[row],
        "end": high + LENGTH + begin - ends[row],
        "data": data,
        "low": low,
        "high": high + LENGTH,
    }


def _token(anchor: np.ndarray, place: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a context has its bit in the fixed table of those that are asked for."""
    return mixed(anchor.view(np.uint64) ^ mixed(key.view(np.uint64) + place.astype(np.uint64))) >> np.uint64(64 - TABLE_BITS)


class _Scan:
    """Sorted contexts of a partition, anchor by anchor and kind by kind, in batches: what is covered at once, and which
    context of a kind stands for it. Only the last row is kept from batch to batch."""

    def __init__(self):
        self.anchor = self.context = self.first = None  # of the kind at hand; first: its (key is null, key, begin)
        self.lone: dict | None = None  # the first context of the anchor at hand while it is the only kind

    def feed(self, t: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        n = len(t["anchor"])
        kind = np.ones(n, bool)
        kind[1:] = (t["anchor"][1:] != t["anchor"][:-1]) | (t["context"][1:] != t["context"][:-1])
        goes_on = t["anchor"][0] == self.anchor and t["context"][0] == self.context
        kind[0] = not goes_on
        # the first of each row's kind, by its own place in the batch or from the batch before
        at = np.maximum.accumulate(np.where(kind, np.arange(n), -1))
        head = {k: t[k][np.maximum(at, 0)] for k in ("null", "key", "begin")}
        if goes_on:
            before = at < 0
            for k, v in zip(("null", "key", "begin"), self.first, strict=True):
                head[k] = np.where(before, v, head[k])
        later = (t["null"] != head["null"]) | (t["key"] != head["key"]) | (t["begin"] != head["begin"])
        yield {"covered": True, **{k: t[k][later] for k in ("null", "key", "begin", "end")}}
        # kinds that begin here, with one held over if its anchor goes on
        heads = {k: t[k][kind] for k in ("anchor", "null", "key", "begin", "end")}
        confirmed = False
        if self.anchor is not None and t["anchor"][0] == self.anchor:
            if self.lone is not None:
                heads = {k: np.concatenate([self.lone[k], heads[k]]) for k in heads}
            else:
                confirmed = True
        if len(heads["anchor"]):
            new = np.ones(len(heads["anchor"]), bool)
            new[1:] = heads["anchor"][1:] != heads["anchor"][:-1]
            if confirmed and heads["anchor"][0] == self.anchor:
                new[0] = False
            group = np.cumsum(new) - 1
            sizes = np.bincount(group[group >= 0], minlength=int(new.sum()))
            several = np.ones(len(new), bool)
            several[group >= 0] = sizes[group[group >= 0]] > 1
            yield {"covered": False, **{k: heads[k][several] for k in heads}}
            if not several[-1]:
                self.lone = {k: heads[k][-1:] for k in heads}
            else:
                self.lone = None
        self.anchor, self.context = t["anchor"][-1], t["context"][-1]
        self.first = tuple(head[k][-1] for k in ("null", "key", "begin"))


def interval_tree(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    """Maximal repeats of ``least`` bytes and more in the contexts data[begin:end]: length, and all occurrences as
    sorted places in ``data``.

    Only suffixes whose first bytes occur again can be leaves of such an interval, so the others are left out before
    sorting. An interval is left out as not maximal if all its occurrences follow the same byte within their contexts.
    """
    counts = np.maximum(ends - begins - least + 1, 0)
    place = np.repeat(begins, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(place):
        return
    padded = np.concatenate([data, np.zeros(8 * WIDE + 8, np.uint8)])
    hashes = _windows(_grams(padded))[place]
    ordered = np.sort(hashes)
    double = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(double):
        return
    at = np.searchsorted(double, hashes)
    again = double[np.minimum(at, len(double) - 1)] == hashes
    place, left = place[again], (np.repeat(ends, counts)[again] - place[again])
    leads = np.repeat(begins, counts)[again] == place
    # suffix array: whole suffixes as big-endian words, nothing beyond the context
    width = 8 * int(-(-left.max() // 8))
    taken = padded[place[:, None] + np.arange(width)]
    taken[np.arange(width) >= left[:, None]] = 0
    words = taken.view(">u8").astype(np.uint64)
    order = np.lexsort((place, *words.T[::-1]))
    words, place, left, leads = words[order], place[order], left[order], leads[order]
    # longest common prefix of each with the one before it
    differ = words[1:] ^ words[:-1]
    word = (differ != 0).argmax(axis=1)
    value = differ[np.arange(len(differ)), word]
    top = np.frexp((value >> np.uint64(11)).astype(float))[1] + 11
    top = np.where(value >> np.uint64(11) == 0, np.frexp(value.astype(float))[1], top)  # exact for small values too
    common = np.where(value == 0, width, 8 * word + (64 - top) // 8)
    common = np.concatenate([[0], np.minimum(common, np.minimum(left[1:], left[:-1])), [0]])
    before = np.where(leads, -1 - np.arange(len(place)), data[place - 1])
    turns = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate(common.tolist()):
        low = i - 1
        while stack and stack[-1][0] > depth:
            length, low = stack.pop()
            if turns[i - 1] > turns[low]:
                yield length, np.sort(place[low:i])
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, low))


def covered_by(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``data`` that maximal repeats cover but for their first occurrence; contexts come in text order."""
    reach = np.zeros(len(data) + 1, np.int64)
    for length, places in interval_tree(data, begins, ends):
        np.maximum.at(reach, places[1:], length)
    at = np.flatnonzero(reach)
    return at, at + reach[at]


def _coverage(asked: DataFrame) -> DataFrame:
    """(key, begin, end) covered, from contexts (anchor, null, key, begin, bytes) of anchors with several kinds."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            a = 0
            anchor = batch.column(0).to_numpy()
            while a < len(anchor):
                size = sum(h.column(4).nbytes for h in held)
                # close the chunk at the next anchor once it is large enough
                if size >= CHUNK:
                    last = held[-1].column(0)[-1].as_py()
                    other = np.flatnonzero(anchor[a:] != last)
                    cut = a + int(other[0]) if len(other) else len(anchor)
                    if cut > a:
                        held.append(batch.slice(a, cut - a))
                    a = cut
                    if len(other):
                        yield done(held)
                        held = []
                else:
                    take = min(len(anchor) - a, 4096)
                    held.append(batch.slice(a, take))
                    a += take
        if held:
            yield done(held)

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        data, ends = buffers(pa.concat_arrays(t.column("bytes").chunks).cast(pa.large_binary()).view(pa.large_string()))
        begins, stops = ends[:-1], ends[1:]
        low, high = covered_by(data, begins, stops)
        own = np.searchsorted(stops, low, side="right")
        # stretches of a context that meet become one
        join = np.ones(len(low), bool)
        if len(low):
            top = np.maximum.accumulate(high + own * 0)
            join[1:] = (own[1:] != own[:-1]) | (low[1:] > top[:-1])
        first = np.flatnonzero(join)
        out = np.maximum.reduceat(high, first) if len(first) else high
        own, low = own[first], low[first]
        place = t.column("begin").to_numpy()
        shift = place[own] - begins[own]
        columns = [t.column("null").to_numpy(zero_copy_only=False)[own], t.column("key").to_numpy()[own], low + shift, out + shift]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["null", "key", "begin", "end"])

    dealt = asked.repartition("anchor").sortWithinPartitions("anchor", "null", "key", "begin")
    return dealt.mapInArrow(run, "null boolean, key long, begin long, end long")


def covered(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(_null, _key, begin, end) in bytes of the stretches to remove; they may overlap. Keys are whole numbers; a null
    key counts as the last one, rows that share a key as one document."""
    lean = docs.select(F.col(key).isNull().alias("null"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("key"), F.col(text).cast("string").alias("_text"))
    spark = docs.sparkSession
    names = ["anchor", "context", "null", "key", "begin", "end"]

    def first_pass(batches):
        for batch in batches:
            null, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for t in contexts(batch.column(2)):
                columns = [t["anchor"], t["context"], null[t["row"]], keys[t["row"]], t["begin"].astype(np.int32), t["end"].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    schema = "anchor long, context long, null boolean, key long, begin int, end int"
    dealt = lean.mapInArrow(first_pass, schema).repartition("anchor").sortWithinPartitions("anchor", "context", "null", "key", "begin")

    def scan(batches):
        state = _Scan()
        for batch in batches:
            if not batch.num_rows:
                continue
            t = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)}
            for out in state.feed(t):
                n = len(out["key"])
                head = [pa.array(np.full(n, out["covered"])), pa.nulls(n, pa.int64()) if out["covered"] else pa.array(out["anchor"])]
                yield pa.RecordBatch.from_arrays([*head, *[pa.array(out[k]) for k in ("null", "key", "begin", "end")]], names=["covered", "anchor", *names[2:]])

    found = written(dealt.mapInArrow(scan, "covered boolean, anchor long, null boolean, key long, begin int, end int"), "contexts")
    # of anchors with several kinds, one context of each kind is read again with its bytes
    spots = found.filter("not covered").select("anchor", "begin", "key")

    def places(batches):
        for batch in batches:
            a, b, k = (batch.column(i).to_numpy() for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(_token(a, b.astype(np.int64), k).astype(np.int64))], names=["bit"])

    shared = spark.sparkContext.broadcast(_bit_table(spots.mapInArrow(places, "bit long")))

    def second_pass(batches):
        table = shared.value
        for batch in batches:
            null, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for t in contexts(batch.column(2)):
                own = keys[t["row"]]
                ok = _is_set(table, _token(t["anchor"], t["begin"], own))
                low, high = t["low"][ok], t["high"][ok]
                ends = np.concatenate([[0], np.cumsum(high - low)])
                at = np.repeat(low - ends[:-1], high - low) + np.arange(ends[-1])
                body = pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(t["data"][at].tobytes())])
                columns = [pa.array(t["anchor"][ok]), pa.array(null[t["row"]][ok]), pa.array(own[ok]), pa.array(t["begin"][ok]), body]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "null", "key", "begin", "bytes"])

    asked = lean.mapInArrow(second_pass, "anchor long, null boolean, key long, begin long, bytes binary")
    at_once = found.filter("covered").select("null", "key", F.col("begin").cast("long"), F.col("end").cast("long"))
    return at_once.union(_coverage(asked)).select(F.col("null").alias("_null"), F.col("key").alias("_key"), "begin", "end")


def substring_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_bytes: bool = True) -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, ``kept`` (binary: what is left need not be
    text) of every row. Null and empty texts, and those under LENGTH bytes, lose nothing."""
    spans = covered(docs, text, key).groupBy("_null", "_key").agg(F.collect_list("begin").alias("_b"), F.collect_list("end").alias("_e"))
    lean = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"))
    same = (F.col("_null") == F.col(key).isNull()) & (F.col("_key") == F.coalesce(F.col(key).cast("long"), F.lit(0)))
    both = lean.join(spans, same, "left").select(key, "_text", "_b", "_e")

    def run(batches):
        for batch in batches:
            data, ends = buffers(batch.column(1))
            rows = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for i in range(batch.num_rows):
                own = data[ends[i] : ends[i + 1]]
                n, removed, spans = len(own), 0, 0
                if batch.column(2)[i].is_valid and n:
                    low = np.minimum(batch.column(2)[i].values.to_numpy(), n)
                    high = np.minimum(batch.column(3)[i].values.to_numpy(), n)
                    level = np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1)
                    gone = np.cumsum(level)[:n] > 0
                    removed = int(gone.sum())
                    spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                    own = own[~gone]
                for k, v in (("n_bytes", n), ("n_removed", removed), ("n_spans", spans), ("kept_sha256", sha256(own.tobytes()).hexdigest())):
                    rows[k].append(v)
                if keep_bytes:
                    rows["kept"].append(own.tobytes())
            kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
            columns = {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items() if keep_bytes or k != "kept"}
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns.values()], names=[key, *columns])

    schema = lean.select(key).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    return both.mapInArrow(run, schema.add("kept", "binary") if keep_bytes else schema)
