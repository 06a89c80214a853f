"""Token ids as raw binary shards with a minimal perfect hash index for keyed access.

A folder holds for each range of keys

* ``NNNNN.ids``: the ids of its documents one after another, little-endian, two bytes each where the vocabulary allows,
  else four;
* ``NNNNN.idx``: a numpy archive: per document the key and where its ids begin (the directory, in key order), and the
  index: the bit arrays of the hash levels with their ranks, and per slot a fingerprint and the directory row.

and the table ``manifest`` (shard, first and last key, documents, ids, ids of all shards before it). A key finds its
shard by the manifest, its slot by one hash per level, and its ids by one read at an offset.

Files are written under a name of the attempt's own and then moved, so a repeated task leaves the same files. The files
go through pyarrow's file systems, so the shared folder may be a local path, HDFS or an object store.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .common import text_rows

GAMMA, LEVELS = 2.0, 64
# Words that a worker remembers at most.
MEMO = 1_000_000
# What is cut off the end of a word; ">" could end a special token.
PUNCTUATION = ".,;:!?*#$%&|()[]{}\"'-/"
MANIFEST = "shard int, first_key long, last_key long, n_docs long, n_ids long, width int"


# -- the minimal perfect hash ------------------------------------------------------------------------------------------


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each key."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return mixed(keys, 1 << 20).astype(np.uint32)


def perfect_hash(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Levels of bits: a key's bit is set where no other key of the level hashed to; the others go on to the next
    level. Its slot is the number of bits set before. ``keys`` are distinct."""
    words, sizes, left, level = [], [], keys, 0
    while len(left):
        if level == LEVELS:
            raise ValueError("keys of a perfect hash have to be distinct")
        size = int(np.ceil(max(1, len(left) * GAMMA) / 64)) * 64
        at = (mixed(left, level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        left, level = left[~alone[at]], level + 1
    bits = np.concatenate([np.empty(0, "<u8"), *words])
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    return {"bits": bits, "ranks": ranks, "sizes": np.array(sizes, np.int64)}


def slots(index: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 where no level has its bit (a key that was surely not put in)."""
    out, base = np.full(len(keys), -1, np.int64), 0
    left = np.arange(len(keys))
    for level, size in enumerate(index["sizes"].tolist()):
        at = (mixed(keys[left], level) % np.uint64(size)).astype(np.int64) + base
        word, bit = index["bits"][at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        out[left[hit]] = index["ranks"][at[hit] >> 6] + below[hit]
        left, base = left[~hit], base + size
    return out


def find(index: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The first directory row of each key, -1 where the stored fingerprint is another's."""
    at = slots(index, keys)
    ok = at >= 0
    ok[ok] = index["prints"][at[ok]] == fingerprints(keys[ok])
    rows = np.full(len(keys), -1, np.int64)
    rows[ok] = index["rows"][at[ok]]
    return rows


# -- files -------------------------------------------------------------------------------------------------------------


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it of a folder as Spark names it ("file:/x" has no host part)."""
    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder.removeprefix("file:")


def _place(store: fs.FileSystem, root: str, name: str, fill) -> None:
    draft = f"{root}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        fill(out)
    store.move(draft, f"{root}/{name}")


def _load_index(store: fs.FileSystem, root: str, shard: int) -> dict[str, np.ndarray]:
    with store.open_input_file(f"{root}/{shard:05d}.idx") as file, np.load(io.BytesIO(file.read())) as data:
        return dict(data)


class WordCoder:
    """Ids of whole texts. No pretoken of these tokenizers spans white space, so words are coded by the library once and
    remembered; ``split`` must agree with the tokenizer on what white space is, else the text goes to it whole."""

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        kinds = json.dumps(data.get("pre_tokenizer"))
        self.lowers = '"Lowercase"' in json.dumps(data.get("normalizer"))
        self.by_word = '"Removed"' in kinds and "add_prefix_space\": true" not in kinds
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        suffix = data["model"].get("end_of_word_suffix") or "\0"
        self.ends = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for t, i in data["model"]["vocab"].items() if t.endswith(suffix)]] = True

    def _stem(self, word: str) -> tuple[str, str]:
        """The word less a last run of punctuation, which is a pretoken of its own after a letter or digit, and that
        run; in lower case where the tokenizer lowers it to the same. Few new words have a new stem."""
        stem = word.rstrip(PUNCTUATION)
        if not stem or not stem[-1].lower().isalnum():  # "\u0130" is lowered to a letter and a mark
            stem = word
        tail = word[len(stem) :]
        return stem.lower() if self.lowers and stem.isascii() and "<|" not in stem else stem, tail

    def _learn(self, plain: list[str], odd: list[str]) -> None:
        """Codes of new stems. Those of letters alone are coded in one string, which parts again after the tokens that
        end a word; should the number of parts be another, they go the way of the odd ones, one by one."""
        if plain and self.ends.any():
            (code,) = self.library.encode_batch_fast([" ".join(plain)], add_special_tokens=False)
            ids = np.array(code.ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(plain) and cuts[-1] == len(ids):
                data, step = ids.tobytes(), self.kind.itemsize
                ends = [0, *(cuts * step).tolist()]
                self.memo.update((p, data[ends[i] : ends[i + 1]]) for i, p in enumerate(plain))
                plain = []
        odd = odd + plain
        for stem, code in zip(odd, self.library.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self.memo[stem] = np.array(code.ids, self.kind).tobytes()

    def code(self, text: str) -> bytes:
        # \x1c-\x1f separate words for str.split, not for the tokenizer
        if not self.by_word or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        words, memo = text.split(), self.memo
        coded = list(map(memo.get, words))
        missing = {w for w, c in zip(words, coded, strict=True) if c is None}
        if not missing:
            return b"".join(coded)
        if len(memo) + 3 * len(missing) > MEMO:
            memo.clear()
        parts = {w: self._stem(w) for w in missing}
        stems = {x for x, _ in parts.values()}.union(t for _, t in parts.values() if t).difference(memo)
        self._learn([x for x in stems if x.isalpha()], [x for x in stems if not x.isalpha()])
        for word, (stem, tail) in parts.items():
            memo[word] = memo[stem] + memo[tail] if tail else memo[stem]
        return b"".join([memo[w] if c is None else c for w, c in zip(words, coded, strict=True)])


_CODERS: dict[str, WordCoder] = {}


def coder(path: str | None, name: str = "word_bpe_49k.json") -> WordCoder:
    place = vocabulary_path(path, name)
    if place not in _CODERS:
        _CODERS[place] = WordCoder(place)
    return _CODERS[place]


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every text (null: empty), append ``end_id``, write shards in ascending key order; returns the manifest.

    Rows with equal keys stay together in the order of their texts and the index leads to the first of them. Rows with a
    null key come first, and only reading in order reaches them. An empty table gives an empty manifest.
    """

    def run(batches):
        tool, store, root = coder(path), *_store(folder)
        end = np.array([end_id], tool.kind).tobytes()
        shard, keys, nulls, counts = TaskContext.get().partitionId(), [], 0, []

        def fill(out):
            nonlocal nulls
            for batch in batches:
                nulls += batch.column(0).null_count
                keys.append(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
                for value in text_rows(batch, "_text"):
                    data = tool.code(value) + end
                    counts.append(len(data) // tool.kind.itemsize)
                    out.write(data)

        _place(store, root, f"{shard:05d}.ids", fill)
        named = np.concatenate([np.empty(0, np.int64), *keys])
        begins = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
        distinct, first = np.unique(named, return_index=True)
        index = perfect_hash(distinct)
        slot = slots(index, distinct)
        prints, rows = np.empty(len(distinct), np.uint32), np.empty(len(distinct), np.int64)
        prints[slot], rows[slot] = fingerprints(distinct), first + nulls
        parts = {**index, "prints": prints, "rows": rows, "keys": named, "begins": begins, "nulls": np.array([nulls])}
        packed = io.BytesIO()
        np.savez(packed, **parts)
        _place(store, root, f"{shard:05d}.idx", lambda out: out.write(packed.getvalue()))
        if counts:
            ends = (named[0], named[-1]) if len(named) else (None, None)
            row = [shard, *(None if e is None else int(e) for e in ends), len(counts), int(begins[-1]), tool.kind.itemsize]
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "first_key", "last_key", "n_docs", "n_ids", "width"), row, strict=True))], schema=kinds)

    kinds = pa.schema(
        [("shard", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())]
    )
    spark = docs.sparkSession
    store, root = _store(folder)
    store.create_dir(root)
    lean = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    ranged = lean.repartitionByRange("_key").sortWithinPartitions("_key", "_text")
    ranged.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard, with ``start``, the ids of all shards before it. The window sees a row per shard only."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _spread(shards: DataFrame) -> DataFrame:
    """A task for every few shards: their rows are tiny, what they stand for is not, so the number is given."""
    return shards.repartition(max(1, shards.count()), "shard")


def read(spark: SparkSession, folder: str, keep_ids: bool = True) -> DataFrame:
    """Every document from the files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids.

    Rows with a key go through the index: the key's slot gives its directory row; only repeats of a key, which the
    index counts from the first one, and null keys are taken in directory order.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def run(batches):
        store, root = _store(folder)
        for batch in batches:
            for shard, width, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                index = _load_index(store, root, shard)
                keys, begins, nulls = index["keys"], index["begins"], int(index["nulls"][0])
                repeat = np.arange(len(keys)) - np.searchsorted(keys, keys)
                first = find(index, keys)
                if (first < 0).any():
                    raise ValueError(f"shard {shard}: the index lacks a key of its directory")
                rows = np.concatenate([np.arange(nulls), first + repeat])
                names = pa.array([None] * nulls + keys.tolist(), pa.int64())
                # shards are read in blocks of documents, by offset
                with store.open_input_file(f"{root}/{shard:05d}.ids") as file:
                    for a in range(0, len(rows), 512):
                        part = rows[a : a + 512]
                        low, high = begins[part.min()], begins[part.max() + 1]
                        block = np.frombuffer(file.read_at(int(high - low) * width, int(low) * width), f"<u{width}")
                        ids = [block[begins[r] - low : begins[r + 1] - low] for r in part]
                        columns = [
                            names[a : a + 512],
                            pa.array(start + begins[part], pa.int64()),
                            pa.array([len(x) for x in ids], pa.int64()),
                            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        ]
                        if keep_ids:
                            columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    shards = _spread(manifest(spark, folder).select("shard", "width", "start"))
    return shards.mapInArrow(run, schema)


def lookup(spark: SparkSession, folder: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``ids`` of the wanted keys that the files have: one index probe and one read at an offset each.

    Of a repeated key the first document is given. Keys meet their shard by the manifest's key ranges, which join as a
    broadcast only where Spark finds the manifest small.
    """

    def run(table: pa.Table) -> pa.Table:
        store, root = _store(folder)
        shard, width = table["shard"][0].as_py(), table["width"][0].as_py()
        index = _load_index(store, root, shard)
        wanted = table["_key"].to_numpy().astype(np.int64)
        rows = find(index, wanted)
        found, ids = [], []
        with store.open_input_file(f"{root}/{shard:05d}.ids") as file:
            for name, row in zip(wanted[rows >= 0].tolist(), rows[rows >= 0].tolist(), strict=True):
                low, high = int(index["begins"][row]), int(index["begins"][row + 1])
                found.append(name)
                ids.append(np.frombuffer(file.read_at((high - low) * width, low * width), f"<u{width}").astype(np.int32))
        return pa.table({"doc_id": pa.array(found, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))})

    shards = manifest(spark, folder).select("shard", "first_key", "last_key", "width")
    asked = keys.select(F.col(key).cast("long").alias("_key")).dropna().distinct()
    # equal keys never part, so a key lies in one shard's range at most
    meets = asked.join(shards, F.col("_key").between(F.col("first_key"), F.col("last_key")))
    return meets.select("shard", "width", "_key").groupBy("shard").applyInArrow(run, "doc_id long, ids array<int>")
