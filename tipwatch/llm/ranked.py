"""Ranked lexical search: every document scored for every item, equal bags of words once.

One pass over the texts counts each document's terms and keeps the frequencies of those that some item asks for. With a
document's length norm ``m`` they decide all its scores, so documents of equal frequencies and norm form a class: rows
meet by a hash and are told apart by the whole bag. A class is scored once, as the sum over its terms of what each
contributes to the items that ask for it. No document of an item's best ``top`` lies in a class that comes after ``top``
others by score and least key, nor after ``top`` smaller keys of its own class, so that many classes and keys are enough.

Items are answered in blocks of at most ``BLOCK`` bytes of text (or of one item), so what goes to every task is bounded,
not the number of items; each block reads all documents. Within a block a task keeps ``top`` classes per item.

Null or blank texts have no terms; they count neither as documents nor as answers. A null key ranks before all others
among equal scores, and rows of repeated keys are documents of their own. Items of repeated id and text are one item;
items without terms have no answers. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_rows, written

# Terms in lower-cased UTF-8: all bytes of characters beyond ASCII belong to one.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
LAST_GAP = re.compile(rb"[^0-9a-z\x80-\xff][0-9a-z\x80-\xff]*\Z")
BLOCK = 4 << 20  # bytes of items answered in one pass
SLICE = 1 << 22  # bytes of a text tokenised at once
CELLS = 1 << 21  # scores held at once: classes of a step times items
KEPT = 1 << 16  # answers held before the best are chosen
WEIGHT, SCALE, SLOPE = 1000, 1_000_000_000, 25


def slices(data: bytes, most: int = SLICE) -> Iterator[bytes]:
    """Parts of a text that cut no term."""
    first = 0
    while len(data) - first > most:
        gap = LAST_GAP.search(data, first, first + most)
        if gap is None:  # a term longer than a slice
            after = re.compile(rb"[^0-9a-z\x80-\xff]").search(data, first + most)
            end = after.start() if after else len(data)
        else:
            end = gap.start() + 1
        yield data[first:end]
        first = end
    yield data[first:]


def term_counts(text: str | bytes) -> Counter:
    """Frequencies of all terms; only A-Z are lower-cased."""
    data, out = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower(), Counter()
    for part in slices(data):
        out.update(TERM.findall(part))
    return out


def _bags(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, lengths, ends, terms, counts = [], [], [0], [], []

        def flush(keys=keys, lengths=lengths, ends=ends, terms=terms, counts=counts, batch=batch):
            offsets = pa.array(ends, pa.int32())
            bag = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, counts)]
            chosen = batch.column("_key").take(pa.array(keys, pa.int64()))
            out = pa.RecordBatch.from_arrays([chosen, pa.array(lengths, pa.int64()), *bag], names=["_key", "n", "terms", "counts"])
            for x in (keys, lengths, terms, counts):
                x.clear()
            ends[:] = [0]
            return out

        for i, text in enumerate(text_rows(batch)):
            found = term_counts(text)
            if not found:
                continue
            keys.append(i)
            lengths.append(found.total())
            asked = sorted((vocabulary[t], c) for t, c in found.items() if t in vocabulary)
            terms.extend(t for t, _ in asked)
            counts.extend(c for _, c in asked)
            ends.append(len(terms))
            if len(terms) > 1 << 18:
                yield flush()
        if keys:
            yield flush()


class Answers:
    """The best ``top`` classes of each item: by score, then by the least key (nulls first), nothing else held."""

    def __init__(self, n_items: int, top: int):
        self.top, self.floor = top, np.ones(n_items, np.int64)  # scores below it can't be among the best
        self.items, self.scores, self.rows, self.held, self.members = [], [], [], 0, []

    def add(self, scores: np.ndarray, members: list) -> None:
        """``scores`` by class and item, ``members`` the smallest keys of each class in order."""
        row, item = np.nonzero(scores >= self.floor)
        used, back = np.unique(row, return_inverse=True)
        self.items.append(item)
        self.scores.append(scores[row, item])
        self.rows.append(back + len(self.members))
        self.members += [members[i] for i in used.tolist()]
        self.held += len(item)
        if self.held > max(KEPT, 4 * self.top * len(self.floor)):
            self.choose()

    def choose(self) -> None:
        items, scores, rows = (np.concatenate([np.empty(0, np.int64), *x]) for x in (self.items, self.scores, self.rows))
        by_key = sorted(range(len(self.members)), key=lambda i: (self.members[i][0] is not None, self.members[i][0]))
        place = np.empty(len(by_key), np.int64)
        place[by_key] = np.arange(len(by_key))
        order = np.lexsort((place[rows], -scores, items))
        items, scores, rows = items[order], scores[order], rows[order]
        nth = np.arange(len(items)) - np.searchsorted(items, items)
        full = nth == self.top - 1
        self.floor[items[full]] = scores[full]
        best = nth < self.top
        items, scores, rows = items[best], scores[best], rows[best]
        used, back = np.unique(rows, return_inverse=True)
        self.members = [self.members[i] for i in used.tolist()]
        self.items, self.scores, self.rows, self.held = [items], [scores], [back], len(items)


def _scored(batches: Iterator[pa.RecordBatch], asked: dict, top: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    begins, items, repeats, weights, n_items = (asked[k] for k in ("begins", "items", "repeats", "weights", "n_items"))
    answers, step = Answers(n_items, top), max(1, CELLS // max(1, n_items))
    for batch in batches:
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            ends = pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(part.num_rows), ends)
            terms, counts = (pc.list_flatten(part.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "counts"))
            norm = part.column("m").to_numpy(zero_copy_only=False).astype(np.int64)[owner]
            gain = weights[terms] * ((SCALE * counts) // (1000 * counts + 12 * norm))
            total = np.zeros(part.num_rows * n_items, np.int64)
            # terms of a class one after another; each is spread over the items that ask for it
            for low in range(0, len(terms), 1 << 16):
                some = slice(low, low + (1 << 16))
                wide = begins[terms[some] + 1] - begins[terms[some]]
                at = np.repeat(begins[terms[some]] - np.concatenate([[0], np.cumsum(wide)[:-1]]), wide) + np.arange(wide.sum())
                cell = np.repeat(owner[some] * n_items, wide) + items[at]
                np.add.at(total, cell, np.repeat(gain[some], wide) * repeats[at])
            answers.add(total.reshape(part.num_rows, n_items), part.column("members").to_pylist())
    answers.choose()
    items, scores, rows = answers.items[0], answers.scores[0], answers.rows[0]
    for first in range(0, len(items), 4096):
        some = slice(first, first + 4096)
        members = [answers.members[i] for i in rows[some].tolist()]
        columns = [pa.array(items[some], pa.int64()), pa.array(scores[some], pa.int64()), pa.array(members, pa.list_(kind))]
        yield pa.RecordBatch.from_arrays(columns, names=["_item", "score", "members"])


def _blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """Distinct items, dealt by their hash into blocks of at most ``BLOCK`` bytes, or of one item."""
    size = F.octet_length("_text")
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-2 * total // BLOCK)) if total > BLOCK else 1
    while True:
        dealt = items.withColumn("_block", F.pmod(F.xxhash64("_item_id", "_text"), F.lit(n)))
        most = dealt.groupBy("_block").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).filter(F.col("rows") > 1)
        if n == 1 or (most.agg(F.max("bytes")).first()[0] or 0) <= BLOCK or n > 64 * (1 + total // BLOCK):
            return dealt, n
        n *= 2


def _answered(docs: DataFrame, block: list, top: int) -> DataFrame:
    """Best classes of each item of one block: _item (its place in ``block``), score, members."""
    spark = docs.sparkSession
    bags = [term_counts(r["_text"]) for r in block]
    vocabulary = {t: i for i, t in enumerate(sorted({t for b in bags for t in b}))}
    shared = spark.sparkContext.broadcast(vocabulary)
    kind = dict(docs.dtypes)["_key"]
    spread = f"_key {kind}, n long, terms array<int>, counts array<int>"
    held = written(docs.mapInArrow(lambda batches: _bags(batches, shared.value), spread), "bags")
    shared.unpersist()
    all_docs, all_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(float(WEIGHT)) * F.log((2.0 * all_docs + 2) / (2 * F.col("df") + 1))).alias("weight")
    weights = np.zeros(len(vocabulary), np.int64)
    for row in df.select("term", weight).collect():  # a row per term of the block
        weights[row["term"]] = row["weight"]

    triples = np.array(sorted((vocabulary[t], i, c) for i, b in enumerate(bags) for t, c in b.items()), np.int64).reshape(-1, 3)
    begins = np.searchsorted(triples[:, 0], np.arange(len(vocabulary) + 1))
    asked = {"begins": begins, "items": triples[:, 1], "repeats": triples[:, 2], "weights": weights, "n_items": len(block)}

    norm = F.expr(f"{100 - SLOPE} + (({SLOPE} * n * {all_docs}L) div {max(1, all_terms)}L)").alias("m")
    bag = held.filter("size(terms) > 0").select("_key", norm, "terms", "counts")
    bag = bag.withColumn("_hash", F.xxhash64("m", "terms", "counts"))
    same = ["_hash", "m", "terms", "counts"]
    # the least keys of a class are chosen before the shuffle too, so a hot class moves few rows of each task
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.col("_key").asc_nulls_first()))
    few = bag.withColumn("_nth", nth).filter(F.col("_nth") <= top)
    members = F.transform(F.array_sort(F.collect_list(F.struct("_nth", "_key"))), lambda x: x["_key"]).alias("members")
    known = few.groupBy(*same).agg(members).select("m", "terms", "counts", "members")
    given = spark.sparkContext.broadcast(asked)
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    found = known.mapInArrow(lambda batches: _scored(batches, given.value, top, arrow), f"_item long, score long, members array<{kind}>")
    out = written(found, "answers")
    given.unpersist()
    return out


def ranked(docs: DataFrame, items: DataFrame, top: int = 20, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id and score of the best ``top`` documents of each item; equal scores by ascending key."""
    rows = docs.select(F.col(key).alias("_key"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col(item_key).alias("_item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    asked, n = _blocks(asked.distinct())
    out = None
    for number in range(n):
        block = asked.filter(F.col("_block") == number).orderBy("_item_id", "_text").collect()  # at most BLOCK bytes
        found = _answered(rows, block, top)
        names = F.from_json(F.lit(json.dumps([r["_item_id"] for r in block])), f"array<{dict(asked.dtypes)['_item_id']}>")
        found = found.withColumn("_id", F.get(names, F.col("_item").cast("int"))).withColumn("_block", F.lit(number))
        out = found if out is None else out.unionByName(found)
    item = ["_block", "_item"]
    least = F.get("members", 0).asc_nulls_first()
    best = out.withColumn("_nth", F.row_number().over(Window.partitionBy(*item).orderBy(F.desc("score"), least)))
    best = best.filter(F.col("_nth") <= top).select(*item, "_id", "score", F.explode("members").alias("_key"))
    rank = F.row_number().over(Window.partitionBy(*item).orderBy(F.desc("score"), F.col("_key").asc_nulls_first()))
    best = best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= top)
    return best.select(F.col("_id").alias(item_key), "rank", F.col("_key").alias(key), "score")
