"""Shards of near equal bytes by sampled splitters, with SQL functions only.

Records have a total order: the key, the checksum of the text and a serial number. Keys drawn in proportion to their
records' bytes are cut at quantiles; the cuts range-partition all records, and a range that came out overfull is sampled
again and cut further. Ranges only deal out the work: running sums of bytes within each range, on top of the exact bytes
of the ranges before it, give each record its place among all bytes, and equal parts of those are the shards. So a
shard's bytes differ from the mean by less than the largest record, however the samples fell.

Every row is a record: repeated rows each get a slot, null keys come first, null texts count as empty, an empty table
gives no rows. Equal texts are not kept together: a group of copies may be larger than a shard. Columns beside the key
and the text are carried along only where ``keep`` names them; names that the result uses itself are not allowed there.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# Ranges that the first draw is cut into, keys drawn for each, and how many times its part of the bytes a range may hold
# before it is cut again. Splitters go to the driver: some RANGES of them, whatever the input.
RANGES, DRAWS, OVERFULL = 512, 32, 2.0
KEY = ["_key", "_crc", "_serial"]
RESULT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def literal(values: list, kind: str) -> Column:
    """A constant array; folded by Catalyst before rows are read."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def below(bounds: Column, count: int, value: Column, strict: bool) -> Column:
    """How many of ``count`` ascending bounds lie below ``value`` (or at it, unless ``strict``), by bisection."""
    steps = [1 << i for i in reversed(range(max(1, count).bit_length()))]

    def go(at: Column, step: Column) -> Column:
        bound = F.get(bounds, at + step - 1)
        # beyond the last bound the comparison is null, which is not true
        return F.when(bound < value if strict else bound <= value, at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), go)


def _order(key: tuple) -> tuple:
    return (key[0] is not None, *key)


def _ranged(records: DataFrame, bounds: list[tuple], kind: str) -> DataFrame:
    """Records with their range: the number of splitters before their key."""
    if not bounds:
        return records.withColumn("_range", F.lit(0))
    fields = f"struct<_key:{kind},_crc:bigint,_serial:bigint>"
    known = literal([dict(zip(KEY, b, strict=True)) for b in bounds], fields)
    return records.withColumn("_range", below(known, len(bounds), F.struct(*KEY), strict=True))


def _drawn(ranged: DataFrame, pieces: list[int], sizes: list[int], turn: int) -> list[tuple]:
    """Quantiles of keys drawn by bytes, of every range that is to be cut into more than one piece."""
    here = F.get(literal(pieces, "bigint"), F.col("_range"))
    rate = F.get(literal([p * DRAWS / max(1, s) for p, s in zip(pieces, sizes, strict=True)], "double"), F.col("_range"))
    chance = F.pmod(F.xxhash64(*KEY, F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
    draws = ranged.select(*KEY, "_range", here.alias("pieces"), F.floor(F.col("size") * rate + chance).alias("draws"))
    draws = draws.filter("pieces > 1 and draws > 0")
    whole = Window.partitionBy("_range")
    upto = F.sum("draws").over(whole.orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0))
    draws = draws.withColumn("upto", upto).withColumn("total", F.sum("draws").over(whole))
    cut = F.expr("(upto * pieces) div total")
    draws = draws.withColumn("cut", cut).withColumn("before", F.expr("((upto - draws) * pieces) div total"))
    return [tuple(r) for r in draws.filter("cut > before and cut < pieces").select(*KEY).collect()]


def splitters(records: DataFrame, kind: str, total: int, ranges: int) -> tuple[list[tuple], list]:
    """Splitters, and rows and bytes of the ranges between them; none of them is overfull but by a single record."""
    bounds: list[tuple] = []
    target, turn = max(1, total // ranges), 0
    while True:
        ranged = _ranged(records, bounds, kind)
        sums = [F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.max("size").alias("largest")]
        found = {r["_range"]: r for r in ranged.groupBy("_range").agg(*sums).collect()}
        stats = [found.get(i) for i in range(len(bounds) + 1)]
        pieces = [1 if s is None or s["bytes"] - s["largest"] <= OVERFULL * target else -(-s["bytes"] // target) for s in stats]
        if max(pieces) == 1:
            return bounds, stats
        more = set(_drawn(ranged, pieces, [0 if s is None else s["bytes"] for s in stats], turn)) - set(bounds)
        bounds, turn = sorted({*bounds, *more}, key=_order), turn + 1


def sharded(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", keep: tuple = (), ranges: int = RANGES) -> DataFrame:
    """Key, ``keep``, size, text_crc32, law, shard, slot and grown_shard of every record."""
    if clash := {key, *keep} & {*RESULT, "_range", *KEY}:
        raise ValueError(f"columns {sorted(clash)} have names of the result")
    body = F.coalesce(F.col(text), F.lit(""))
    own = [F.col(key).alias("_key"), F.crc32(body.cast("binary")).alias("_crc"), F.monotonically_increasing_id().alias("_serial")]
    # the serial number is fixed by being written; all later steps read it from there
    records = written(docs.select(*own, (F.octet_length(body) + 1).cast("long").alias("size"), *keep), "records")
    total = records.agg(F.sum("size")).first()[0] or 0
    kind = dict(records.dtypes)["_key"]
    bounds, stats = splitters(records, kind, total, ranges) if total else ([], [None])
    rows, size, starts = 0, 0, []
    for s in stats:
        starts.append((rows, size))
        rows, size = (rows, size) if s is None else (rows + s["rows"], size + s["bytes"])
    within = Window.partitionBy("_range").orderBy(*KEY)
    earlier = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.get(literal([s for _, s in starts], "bigint"), F.col("_range")) + earlier
    row = F.get(literal([r for r, _ in starts], "bigint"), F.col("_range")) + F.row_number().over(within) - 1
    cuts = [-(-j * total // n_shards) for j in range(1, n_shards)]
    placed = _ranged(records, bounds, kind).withColumn("_at", at).withColumn("_row", row)
    shard = below(literal(cuts, "bigint"), len(cuts), F.col("_at"), strict=False) if cuts else F.lit(0)
    placed = written(placed.withColumn("shard", shard.cast("int")).drop("_at", "_range", "_serial"), "placed")
    firsts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("_row").alias("first")).collect()}
    slot = F.col("_row") - F.get(literal([firsts.get(i, 0) for i in range(n_shards)], "bigint"), F.col("shard"))
    named = [F.col("_key").alias(key), *keep, "size", F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard"]
    return placed.select(*named, slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all columns into a folder per shard, rows of a file in order of their slots; returns what was written."""
    out = sharded(docs, n_shards, key, text, keep=tuple(c for c in docs.columns if c != key))
    # a range lies in one task, so that a task holds parts of few shards
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.parquet(folder)
