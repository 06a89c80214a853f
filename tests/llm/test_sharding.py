"""Shards by sampled splitters against running sums over the sorted rows."""

import random
import zlib

import pytest

from tipwatch.llm import sharding
from tipwatch.llm.common import shared_path


def plain(rows, n_shards=8):
    sized = sorted(((k is not None, k or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for k, t in rows))
    total, at, out, slots = sum(r[3] for r in sized), 0, [], {}
    for known, k, crc, size in sized:
        shard = at * n_shards // total
        slots[shard] = slots.get(shard, -1) + 1
        out.append((k if known else None, size, crc, "bytes", shard, slots[shard], None))
        at += size
    return out


def placed(df):
    rows = [tuple(r) for r in df.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()]
    return sorted(rows, key=lambda r: r[4:6])


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    out = [(draw.randrange(10**9), "é" * draw.randrange(1, 200)) for _ in range(3000)]
    out += [(77, "copy " * 20)] * 1500 + [(None, "no key")] * 700 + [(5, None), (6, ""), (8, "y" * 300_000)]
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("ranges", [1, 7, 512])
def test_as_running_sums(spark, rows, ranges):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as _range").repartition(5)
    assert placed(sharding.sharded(docs, ranges=ranges)) == plain(rows)


@pytest.mark.parametrize("n", [1, 3, 100])
def test_numbers_of_shards(spark, rows, n):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = placed(sharding.sharded(docs, n_shards=n, ranges=32))
    assert found == plain(rows, n)
    sizes = {}
    for r in found:
        sizes[r[4]] = sizes.get(r[4], 0) + r[1]
    assert all(abs(v - sum(sizes.values()) / n) <= 300_001 for v in sizes.values())


def test_overfull_ranges_are_cut_again(spark, rows, monkeypatch):
    monkeypatch.setattr(sharding, "DRAWS", 1)
    records = spark.createDataFrame([(k, i, i, len(t or "") + 1) for i, (k, t) in enumerate(rows)], "_key long, _crc long, _serial long, size long")
    total = sum(len(t or "") + 1 for _, t in rows)
    bounds, stats = sharding.splitters(records, "bigint", total, 64)
    assert bounds == sorted(bounds, key=sharding._order) and len(stats) == len(bounds) + 1
    assert all(s is None or s["bytes"] - s["largest"] <= 2 * (total // 64) for s in stats)
    assert sum(s["rows"] for s in stats if s) == len(rows)


def test_small_and_empty_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert placed(sharding.sharded(make([(1, "x")]))) == plain([(1, "x")])
    assert placed(sharding.sharded(make([]))) == []
    names = spark.createDataFrame([("b", "x"), ("a", "y"), (None, "z")], "doc_id string, text string")
    assert [r[0] for r in placed(sharding.sharded(names, n_shards=1))] == [None, "a", "b"]


def test_files(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", sharding.F.lit("en")).repartition(4)
    back = sharding.write_shards(docs, shared_path(spark, "shards"))
    assert placed(back) == plain(rows)
    assert sorted(map(str, back.select("doc_id", "text", "lang").collect())) == sorted(map(str, docs.collect()))
    with pytest.raises(ValueError, match="shard"):
        sharding.sharded(docs.withColumnRenamed("lang", "shard"), keep=("shard",))
