"""Sharding against its law, counted in plain Python."""

import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, shard string, part int")


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"text {i % 7} é") for i in range(3000)]
    out += [(5, "text 5 é")] * 1500 + [(None, None)] * 4 + [(None, ""), (7, "x" * 100000)]
    return out


@pytest.fixture(scope="module")
def result(spark, rows):
    return sharding.sharded(frame(spark, rows).repartition(5)).collect()


def test_every_row_once(rows, result):
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    expected = sorted(((i, size(t), crc(t)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in result), key=str) == expected


def test_places_have_no_gaps(result):
    places = defaultdict(list)
    for r in result:
        places[r.shard].append(r.slot)
    assert set(places) <= set(range(16))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_key_and_number_decide(spark, result):
    shard = {}
    for r in result:
        assert shard.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    assert {g for _, g in shard.values()} == set(range(17))
    few = sharding.sharded(frame(spark, [(i, "other") for i in range(100, 160)])).collect()
    assert all((r.shard, r.grown_shard) == shard[r.doc_id] for r in few)


def test_slot_bytes(result):
    sums = defaultdict(int)
    for r in result:
        sums[r.virtual_slot] += r.size
    assert all(r.slot_bytes == sums[r.virtual_slot] for r in result)


def test_growth_takes_equal_parts(spark):
    first = sharding.initial_map(spark, 16)
    counts = {r["shard"]: r["count"] for r in sharding.grown(first).groupBy("shard").count().collect()}
    assert counts[16] == 16 * (256 // 17) and all(counts[s] == 256 - 256 // 17 for s in range(16))


def test_rebalancing_moves_bytes_to_lighter_shards(spark, tmp_path):
    path = str(tmp_path / "map")
    first = sharding.store_map(sharding.initial_map(spark, 4, 64), path)
    loads = first.select("slot", F.when(F.col("shard") == 0, 500).otherwise(100).alias("bytes"))
    versions = sharding.store_map(sharding.rebalanced(first, loads), path)
    assert sorted(r.version for r in versions.select("version").distinct().collect()) == [1, 2]
    second = sharding.latest(versions)
    assert second.count() == 64 and second.select("slot").distinct().count() == 64
    load = {r.shard: r.b for r in second.join(loads, "slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    assert max(load.values()) <= 1.2 * 3200 and min(load.values()) >= 0.8 * 3200


def test_empty(spark):
    assert sharding.sharded(frame(spark, [(1, "a")]).limit(0)).collect() == []
