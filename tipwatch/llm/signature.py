"""N-gram Jaccard join by signature trees.

Texts are linked when their sets of five-word shingles have a similarity of 0.75 or more; the classes of the links come
back, with one representative for each different set, so copies are never paired.

The join is exact. Shingles have one global order (by the grade of their count, rarer first, then by hash; grades come from
counts that tasks add up, and any grades give the same links), and linked sets share a shingle in their first quarter. Over the sets that share such a shingle with another stands a tree of three
levels: classes linked so far, their nodes of like size, and the sets. Nodes hold the OR of their sets' shingle bitmaps
and their range of sizes. Both sides of a pair are descended together:

* sets are first held against the leaders of their runs of equal shingles, which joins most of every group of near
  copies;
* pairs of nodes of different classes that share a shingle are dropped where sizes, bitmaps and the number of shared
  first shingles bound the overlap below what a link needs;
* of the others a few sets that share first shingles are compared, and, where that gives no link, all sets of both nodes
  under the same bounds.

What is left out each time is a pair within one class (already joined) or one that cannot link. Sets are compared by
their 64-bit shingle hashes. Texts are read again rather than stored: a pass writes only the sets that are asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from . import shingles
from .common import written

# A link needs 4 / 3 of the shared shingles to be no fewer than all: 7 shared >= 3 (a + b).
SHARED, SIZES = 7, 3
# Bits of the fixed tables that passes take along (8 MiB each), and of a set's bitmap.
TABLE_BITS, MAP_BITS = 26, 2048
# Shingles counted at a time; one that occurs so often among them is counted towards its grade.
COUNTED, COMMON = 4_000_000, 2
# Grades go by powers of two of the counts that share a place in the fixed table, 4 bits each.
GRADE_BITS, GRADES = 24, 16
# Leaders of a run of equal shingles: the more, the fewer sets of a large group are left for the pairs of nodes.
LEADERS = 6
# Pairs of sets that are compared before all of two nodes are.
FEW = 48
# Nodes hold sets whose sizes differ by this factor at most.
STEP = 1.06


def first_part(n):
    """Shingles of which a linked set of any size must share one: all but those that any overlap may leave out."""
    return n - (3 * n + 3) // 4 + 1


def reach(n, place):
    """Three times the size of the largest set that a set of ``n`` shingles may link with if their first common shingle
    in the global order is its shingle at ``place``: all that they share comes from there on, and 7 (n - place) must be
    no less than 3 (n + other)."""
    return (SHARED - SIZES) * n - SHARED * place


def _pack(ids: pa.Table, name: str) -> np.ndarray:
    bits = np.zeros(1 << (TABLE_BITS - 6), "<u8")
    bits[ids["word"].to_numpy()] = ids[name].to_numpy().view(np.uint64)
    return bits


def _bit_table(positions: DataFrame) -> np.ndarray:
    """A bit for each value of column ``bit``. Its size is fixed, whatever the number of rows."""
    words = positions.groupBy(F.shiftright("bit", 6).cast("int").alias("word"))
    return _pack(words.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow(), "bits")


def _grades(counts: DataFrame) -> np.ndarray:
    """Sixteen grades a word from (bit, count): 0 for a place without counts, else one more than the power of two."""
    grade = F.least(F.lit(GRADES - 1), 1 + F.floor(F.log2(F.sum("count").cast("double")))).alias("grade")
    each = counts.groupBy("bit").agg(grade).withColumn("word", F.shiftright("bit", 4).cast("int"))
    words = each.groupBy("word").agg(F.expr("bit_or(shiftleft(cast(grade as bigint), cast(4 * (bit % 16) as int)))").alias("grades")).toArrow()
    table = np.zeros(1 << (GRADE_BITS - 4), "<u8")
    table[words["word"].to_numpy()] = words["grades"].to_numpy().view(np.uint64)
    return table


def _grade(table: np.ndarray, own: np.ndarray) -> np.ndarray:
    at = own >> np.uint64(64 - GRADE_BITS)
    return ((table[at >> np.uint64(4)] >> ((at & np.uint64(15)) << np.uint64(2))) & np.uint64(GRADES - 1)).astype(np.uint8)


def _is_set(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _id_of(own: np.ndarray) -> int:
    return int.from_bytes(blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bitmap(own: np.ndarray) -> np.ndarray:
    bits = np.zeros(MAP_BITS, bool)
    bits[own & np.uint64(MAP_BITS - 1)] = True
    return np.packbits(bits, bitorder="little").view("<i8")


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *values]).astype(np.int64)))


class _Texts:
    """The documents as (_key, _text), and the passes over them."""

    def __init__(self, docs: DataFrame, text: str, key: str):
        self.docs = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
        self.spark: SparkSession = docs.sparkSession

    def summaries(self) -> DataFrame:
        """A row per document: size, id and bitmap of its set (null without words); and rows that hold only ``bit`` and
        ``count``, the place of shingles that occur again in the table of grades and how often. Equal sets of a task
        count once."""

        def run(batches):
            seen, held, size = set(), [], 0

            def common():
                every = np.concatenate(held)
                held.clear()
                every.sort()
                at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
                times = np.diff(np.append(at, len(every)))
                often = times >= COMMON
                places, back = np.unique(every[at[often]] >> np.uint64(64 - GRADE_BITS), return_inverse=True)
                return places.astype(np.int64), np.bincount(back, times[often], len(places)).astype(np.int64)

            for batch in batches:
                sizes, ids, maps = [], [], []
                for own in shingles.sets(batch.column(1)):
                    sizes.append(len(own))
                    ids.append(_id_of(own) if len(own) else None)
                    maps.append(_bitmap(own) if len(own) else np.empty(0, np.int64))
                    if len(own) and ids[-1] not in seen:
                        seen.add(ids[-1])
                        held.append(own)
                        size += len(own)
                none = [pa.nulls(len(sizes), pa.int64())] * 2
                columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), _lists(maps), *none]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                if size >= COUNTED:
                    yield from rows_of(*common(), batch)
                    held, size = [], 0
            if held:
                yield from rows_of(*common(), batch)

        def rows_of(places, counts, batch):
            none = [pa.nulls(len(places), t) for t in (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*none, pa.array(places), pa.array(counts)], names=names)

        names = ["_key", "n", "id", "map", "bit", "count"]
        kinds = StructType([self.docs.schema["_key"]]).add("n", "long").add("id", "long").add("map", ArrayType(LongType()))
        kinds = kinds.add("bit", "long").add("count", "long")
        return written(self.docs.mapInArrow(run, kinds), "summaries")

    def postings(self, grades: np.ndarray) -> DataFrame:
        """The first part of every different set of a task: token, id, n, and how far its place reaches."""
        shared = self.spark.sparkContext.broadcast(grades)

        def run(batches):
            table, seen = shared.value, set()
            for batch in batches:
                tokens, ids, sizes, reaches = [], [], [], []
                for own in shingles.sets(batch.column(0)):
                    if not len(own) or (name := _id_of(own)) in seen:
                        continue
                    seen.add(name)
                    n = len(own)
                    tokens.append(own[np.argsort(_grade(table, own), kind="stable")[: first_part(n)]].view(np.int64))
                    ids.append(name)
                    sizes.append(n)
                    reaches.append(reach(n, np.arange(first_part(n))).astype(np.int32))
                counts = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.empty(0, np.int64), *tokens])),
                        pa.array(np.repeat(np.array(ids, np.int64), counts)),
                        pa.array(np.repeat(np.array(sizes, np.int32), counts)),
                        pa.array(np.concatenate([np.empty(0, np.int32), *reaches])),
                    ],
                    names=["token", "id", "n", "reach"],
                )

        return self.docs.select("_text").mapInArrow(run, "token long, id long, n int, reach int")

    def sets(self, wanted: DataFrame, summaries: DataFrame) -> DataFrame:
        """A written table of id and tokens for the wanted ids, from one document each (and now and then another)."""
        first = F.min_by(F.xxhash64("_key"), F.struct(F.col("_key").isNull(), F.xxhash64("_key")))
        some = summaries.filter("id is not null").join(wanted.select("id").distinct(), "id", "left_semi")
        mask = (1 << TABLE_BITS) - 1
        table = _bit_table(some.groupBy("id").agg(first.alias("_h")).select(F.col("_h").bitwiseAND(F.lit(mask)).alias("bit")))
        shared = self.spark.sparkContext.broadcast(table)

        def run(batches):
            chosen = shared.value
            for batch in batches:
                at = batch.column(1).to_numpy().view(np.uint64) & np.uint64(mask)
                own = [x for x in shingles.sets(batch.column(0).filter(pa.array(_is_set(chosen, at)))) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([_id_of(x) for x in own], pa.int64()), _lists([x.view(np.int64) for x in own])], names=["id", "tokens"])

        lean = self.docs.select("_text", F.xxhash64("_key").alias("_h"))
        return written(lean.mapInArrow(run, "id long, tokens array<long>"), "sets")


def _runs(postings: DataFrame) -> DataFrame:
    """Postings of the tokens that several sets hold, with the run's leaders (its first LEADERS ids, as far as known).

    Rows come sorted, so a task keeps no more than the run's first ids: an endless run streams through.
    """
    names = [f"leader{j}" for j in range(LEADERS)]

    def run(batches):
        token, leaders = None, []
        pending = last = None  # the first row of a run that no second id has confirmed yet; the last id given out
        for batch in batches:
            tokens, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(tokens):
                continue
            n, far = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            fresh = np.ones(len(tokens), bool)
            fresh[1:] = (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1])
            if tokens[0] == token and ids[0] == last:
                fresh[0] = False
            tokens, ids, n, far = tokens[fresh], ids[fresh], n[fresh], far[fresh]
            if not len(tokens):
                continue
            extra = 0
            if pending is not None and tokens[0] == token:
                tokens, ids = np.append(pending[0], tokens), np.append(pending[1], ids)
                n, far = np.append(pending[2], n), np.append(pending[3], far)
            elif pending is None and tokens[0] == token:
                extra = 1  # goes on with a run that is confirmed
            begin = np.concatenate([[True], tokens[1:] != tokens[:-1]])
            if extra:
                begin[0] = False
            starts = np.flatnonzero(begin)
            run_of = np.cumsum(begin) - 1  # -1: the run that goes on
            sizes = np.bincount(run_of[run_of >= 0], minlength=len(starts))
            keep = np.ones(len(tokens), bool)
            inside = run_of >= 0
            keep[inside] = sizes[run_of[inside]] > 1
            # the first ids of each run; a row's own id stands where there is none
            lead = np.repeat(ids[:, None], LEADERS, axis=1)
            ends = np.append(starts[1:], len(tokens))
            before = int(starts[0]) if len(starts) else len(tokens)
            leaders = (leaders + ids[: min(before, LEADERS)].tolist())[:LEADERS] if before else leaders
            for j in range(LEADERS):
                if before and j < len(leaders):
                    lead[:before, j] = leaders[j]
                has = starts + j < ends
                own = run_of[inside]
                lead[inside, j] = np.where(has[own], ids[np.minimum(starts + j, len(ids) - 1)][own], ids[inside])
            open_one = len(starts) > 0 and sizes[-1] == 1
            pending = (tokens[-1:], ids[-1:], n[-1:], far[-1:]) if open_one else None
            if len(starts):
                leaders = ids[starts[-1] : starts[-1] + LEADERS].tolist()
            token, last = tokens[-1], ids[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[keep]), pa.array(ids[keep]), pa.array(n[keep].astype(np.int32)), pa.array(far[keep].astype(np.int32)), *[pa.array(lead[keep, j]) for j in range(LEADERS)]],
                names=["token", "id", "n", "reach", *names],
            )

    dealt = postings.repartition("token").sortWithinPartitions("token", "id")
    return written(dealt.mapInArrow(run, "token long, id long, n int, reach int, " + ", ".join(f"{c} long" for c in names)), "runs")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets link."""
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("_a"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("_b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(SHARED * shared >= SIZES * (F.size("_a") + F.size("_b"))).drop("_a", "_b")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each end of an edge (a, b) reaches. Every round takes the smallest label among
    the neighbours and then the label of that; tables are written between rounds."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("_near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        above = labels.select(F.col("id").alias("_top"), F.col("label").alias("_above"))
        step = step.join(above, F.col("label") == F.col("_top")).select("id", F.least("label", "_above").alias("label"), "_old")
        step = written(step, "labels")
        labels = step.select("id", "label")
        if step.filter("label <> _old").isEmpty():
            return labels


def _range_bound(shared: Column, low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Whether sets of sizes in these ranges that share so many of their first parts may link: what is not in both first
    parts lies beyond the end of one, where the set has 3/4 of its shingles less one.

    The need grows with the smaller size and falls with the larger one beyond it, so the ends of the ranges decide.
    """
    closest = (low_a, high_b), (high_a, low_b), (low_a, low_b), (high_a, high_b)
    slack = F.lit(False)
    for a, b in closest:
        fits = 4 * F.least(a, b) + 4 >= 3 * F.greatest(a, b)
        slack = slack | (fits & (shared + F.ceil(0.75 * F.greatest(a, b)) + 1 >= F.floor(SIZES * (a + b) / SHARED)))
    # the true corner may lie where the size ratio is just 3/4: then any shared shingle may do
    reach = (4 * low_b <= 3 * high_a) & (3 * low_a <= 4 * high_b) | (4 * low_a <= 3 * high_b) & (3 * low_b <= 4 * high_a)
    sizes = (4 * high_a >= 3 * low_b) & (4 * high_b >= 3 * low_a)
    return sizes & (slack | reach)


class _Tree:
    """Sets of the runs with their class, and the nodes above them."""

    def __init__(self, runs: DataFrame, summaries: DataFrame):
        self.runs = runs
        ids = runs.select("id").distinct()
        one = summaries.filter("id is not null").groupBy("id").agg(F.first("n").alias("n"), F.first("map").alias("map"))
        self.sets = written(one.join(ids, "id", "left_semi"), "tree")
        self.labels: DataFrame | None = None

    def joined(self, edges: DataFrame) -> None:
        """Take in links between ids."""
        # the edges run between ids, and so do the labels: both together are the graph so far
        if self.labels is not None:
            edges = edges.select("a", "b").union(self.labels.select("id", "label"))
        self.labels = components(edges)

    def classed(self) -> DataFrame:
        """(id, n, map, label, node); a node is a class's sets of one step of sizes."""
        out = self.sets if self.labels is None else self.sets.join(self.labels, "id", "left")
        label = F.col("id") if self.labels is None else F.coalesce("label", "id")
        step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(STEP)))
        out = out.withColumn("label", label)
        return written(out.withColumn("node", F.xxhash64("label", step)), "classed")

    def pairs(self) -> tuple[DataFrame, DataFrame]:
        """Pairs of nodes (x, y) of different classes that may link, and the table of ids with their nodes."""
        classed = self.classed()
        words = MAP_BITS // 64
        nodes = classed.groupBy("node").agg(
            F.min("n").alias("low"),
            F.max("n").alias("high"),
            # bits that its tokens do not show in a set's own bitmap, at most
            F.max(F.col("n") - F.aggregate("map", F.lit(0), lambda s, w: s + F.bit_count(w))).alias("hidden"),
            *[F.bit_or(F.get("map", F.lit(i))).alias(f"w{i}") for i in range(words)],
        )
        nodes = written(nodes, "nodes")
        held = self.runs.join(classed.select("id", "label", "node"), "id")
        held = held.groupBy("token", "node", "label").agg(
            F.max("reach").alias("reach"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("id").alias("first"), F.max("id").alias("last"),
            F.min_by("id", F.xxhash64("id")).alias("low"), F.max_by("id", F.xxhash64("id")).alias("high"),
        )
        several = held.groupBy("token").agg(F.min("label").alias("_l"), F.max("label").alias("_m")).filter("_l <> _m").select("token")
        held = written(held.join(several, "token", "left_semi"), "held")
        x, y = (
            held.select("token", *[F.col(c).alias(f"{s}{d}") for c, d in (("node", ""), ("label", "l"), ("least", "0"), ("most", "1"), ("reach", "r"))])
            for s in "xy"
        )
        # y holds the smaller set; the token may be the first that two sets share if each one's place in its set reaches
        # to the size of the other
        meets = (F.col("xl") != F.col("yl")) & (F.col("y0") <= F.col("x1")) & (F.col("xr") >= SIZES * F.col("y0")) & (F.col("yr") >= SIZES * F.col("x0"))
        found = x.join(y.filter(F.col("yr") >= SIZES * F.col("y0")), "token").filter(meets)
        found = found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()

        def of(side: str) -> DataFrame:
            return nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in nodes.columns if c != "node"])

        both = found.join(of("x"), "x").join(of("y"), "y")
        seen = sum((F.bit_count(F.col(f"x_w{i}").bitwiseAND(F.col(f"y_w{i}"))) for i in range(words)), F.lit(0))
        overlap = seen + F.least("x_hidden", "y_hidden")
        need = F.ceil(SIZES * (F.col("x_low") + F.col("y_low")) / SHARED)
        both = both.filter((overlap >= need) & (4 * F.col("x_high") >= 3 * F.col("y_low")) & (4 * F.col("y_high") >= 3 * F.col("x_low")))
        # x becomes the node of fewer tokens: what follows expands x first
        held_by = held.groupBy("node").agg(F.count("*").alias("tokens"))
        for s in "xy":
            both = both.join(held_by.select(F.col("node").alias(s), F.col("tokens").alias(f"{s}_tokens")), s)
        swap = F.col("x_tokens") > F.col("y_tokens")
        turned = [F.when(swap, F.col(f"{t}{c}")).otherwise(F.col(f"{s}{c}")).alias(f"{s}{c}") for s, t in ("xy", "yx") for c in ("", "_low", "_high")]
        both = written(both.select(*turned), "node_pairs")
        # tokens that both hold: along the tokens of x, those that y holds too, with a few sets of each side
        sides = {"x": ("first", "last", "low", "high"), "y": ("first", "last", "high", "low")}
        xt, yt = (held.select("token", F.col("node").alias(s), F.array(*some).alias(f"{s}_some")) for s, some in sides.items())
        along = both.select("x", "y").join(xt, "x").join(yt, ["y", "token"])
        ends = F.explode(F.array_distinct(F.zip_with("x_some", "y_some", lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
        met = along.select("x", "y", "token", ends.alias("_e")).groupBy("x", "y", "_e").agg(F.count("*").alias("n"))
        count = along.groupBy("x", "y").agg(F.count("*").alias("shared"))
        kept = both.join(count, ["x", "y"]).filter(_range_bound(F.col("shared"), *[F.col(f"{s}_{c}") for s in "xy" for c in ("low", "high")]))
        # the few of these sets that share most tokens
        few = F.slice(F.sort_array(F.collect_list(F.struct("n", "_e")), asc=False), 1, FEW)
        kept = kept.select("x", "y").join(met.groupBy("x", "y").agg(few["_e"].alias("few")), ["x", "y"])
        return written(kept, "node_pairs"), classed

    def below(self, node_pairs: DataFrame, classed: DataFrame) -> DataFrame:
        """Pairs of sets (a, b) of those nodes whose sizes and bitmaps let them link."""
        hidden = F.col("n") - F.aggregate("map", F.lit(0), lambda s, w: s + F.bit_count(w))
        sets = classed.select("node", "id", "n", "map", hidden.alias("hidden"))
        a, b = (sets.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "map", "hidden")]) for s in "xy")
        both = node_pairs.select("x", "y").join(a, "x").join(b, "y")
        both = both.filter((4 * F.col("n_x") >= 3 * F.col("n_y")) & (4 * F.col("n_y") >= 3 * F.col("n_x")))
        seen = F.aggregate(F.zip_with("map_x", "map_y", lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda s, w: s + w)
        need = F.ceil(SIZES * (F.col("n_x") + F.col("n_y")) / SHARED)
        return both.filter(seen + F.least("hidden_x", "hidden_y") >= need).select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id``, the smallest key that links reach, for every row.

    A text without words (null, empty, blank) has no shingles and is linked with nothing: its component is its own key.
    One of fewer than five words has its whole sequence as the one shingle. Rows with equal sets are copies and share a
    class; a null key takes part in links but never names a class that has another.
    """
    texts = _Texts(docs, text, key)
    summaries = texts.summaries()
    grades = _grades(summaries.filter("bit is not null").select("bit", "count"))
    rows = summaries.filter("bit is null").drop("bit", "count")
    tree = _Tree(_runs(texts.postings(grades)), rows)

    def join(pairs: DataFrame, check: Callable = _linked) -> None:
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            return
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
        links = written(check(pairs, texts.sets(ids, rows)).select("a", "b"), "links")
        if not links.isEmpty():
            tree.joined(links)

    # each set against the leaders that it shares most first shingles with, if it shares a fifth of them
    lead = tree.runs.select("id", "n", F.explode(F.array_distinct(F.array(*[f"leader{j}" for j in range(LEADERS)]))).alias("leader"))
    lead = lead.filter("id <> leader").groupBy("id", "leader", "n").agg(F.count("*").alias("shared")).filter(20 * F.col("shared") >= F.col("n"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("shared", "leader")), asc=False), 1, LEADERS)
    join(lead.groupBy("id").agg(best.alias("_best")).select(F.col("id").alias("a"), F.explode("_best.leader").alias("b")))
    nodes, classed = tree.pairs()
    join(nodes.select(F.explode("few").alias("_e")).select("_e.a", "_e.b").distinct())
    if tree.labels is not None:
        # node pairs whose classes are still apart
        label = classed.select("node", "id").join(tree.labels, "id", "left").groupBy("node").agg(F.min(F.coalesce("label", "id")).alias("label"))
        x, y = (label.select(F.col("node").alias(s), F.col("label").alias(f"{s}l")) for s in "xy")
        nodes = written(nodes.join(x, "x").join(y, "y").filter("xl <> yl"), "node_pairs")
    join(tree.below(nodes, classed))

    labels = tree.labels
    named = rows.select("_key", F.col("n").alias("n_shingles"), "id")
    named = named.join(labels, "id", "left") if labels is not None else named.withColumn("label", F.lit(None).cast("long"))
    named = written(named.select("_key", "n_shingles", F.coalesce("label", "id").alias("_class")), "named")
    least = named.filter("_class is not null").groupBy("_class").agg(F.min("_key").alias("_least"))
    out = named.join(least, "_class", "left")
    return out.select(F.col("_key").alias(key), "n_shingles", F.coalesce("_least", "_key").alias("component_id"))
