import hashlib
import math
import random
import struct
import zlib

import pytest
from helpers import shown
from pyspark.sql import functions as F

from lodestrata.functions import codec
from lodestrata.operators import integrity, quota, sketches


def test_record_encoding(log):
    rows = log(("testKey", 12345678901234, "testValue"), ("é", 1, None), ("", 0, ""))
    for r in rows.withColumn("b", codec.record_bytes()).withColumn("c", codec.record_crc()).collect():
        one = codec.Record(r.key, r.ts_ns, r.tombstone, r.value and bytes(r.value))
        assert bytes(r.b) == codec.encode(one) and r.c == zlib.crc32(bytes(r.b)[4:])
        assert codec.decode(bytes(r.b))[:3] == one[:3]
    data = bytearray(codec.encode(codec.Record("testKey", 5, False, b"testValue")))
    data[10] = 0xFF
    for bad in (bytes(data), b"short"):
        with pytest.raises(ValueError):
            codec.decode(bad)


def test_corrupt_rows(log):
    rows = integrity.with_crc(log(("a", 1, "value1"), ("b", 1, "value2")))
    assert not integrity.corrupt(rows).count()
    spoilt = rows.withColumn("value", F.when(F.col("key") == "a", F.lit(b"AAA")).otherwise(F.col("value")))
    assert shown(integrity.corrupt(spoilt), "key") == [("a",)]


def tree(leaves):
    while len(leaves) > 1:
        leaves = [hashlib.sha256(leaves[k] + (leaves[k + 1] if k + 1 < len(leaves) else bytes(32))).digest() for k in range(0, len(leaves), 2)]
    return leaves[0].hex()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1024, 1025, 2500, 3073])
def test_merkle_root(spark, n):
    own = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
    df = spark.createDataFrame([(k, h.hex()) for k, h in enumerate(own)], "idx long, hash string")
    assert integrity.root(df).first()[0] == tree(own)


def test_merkle_needs_a_leaf(spark):
    with pytest.raises(ValueError):
        integrity.root(spark.createDataFrame([], "idx long, hash string"))


def test_numbering_and_difference(log):
    a, b = log(("a", 1, "1"), ("b", 1, "2"), ("c", 1, "3")), log(("a", 1, "1"), ("b", 1, "x"), ("c", 1, "3"), ("d", 1, "4"))
    assert shown(integrity.leaves(a), "idx", "key") == [(0, "a"), (1, "b"), (2, "c")]
    assert shown(integrity.difference(integrity.leaves(a), integrity.leaves(b)), "idx", "key") == [(1, "b"), (3, "d")]
    assert not integrity.validate(a, integrity.leaves(a)).count()
    assert integrity.difference(integrity.leaves(b), integrity.leaves(a)).where("idx = 3 and hash is null").count() == 1


@pytest.mark.parametrize("settings", [{}, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}, {"spark.sql.adaptive.enabled": "false"}, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}])
def test_numbering_of_many_partitions(spark, settings):
    """Every row once, numbered 0 to n - 1 in order, with a wide column that plays no part in it; partitions differ in size and hold ties."""
    n, was = 60_000, spark.conf.get("spark.sql.shuffle.partitions")
    own = settings | {"spark.sql.shuffle.partitions": "16"}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        rows = spark.range(n).select(F.md5((F.col("id") % 50_000).cast("string").cast("binary")).alias("key"), F.repeat(F.md5(F.col("id").cast("string").cast("binary")), 20).alias("wide"), F.col("id").alias("n"))
        got = integrity.numbered(rows, "key")
        assert got.columns == ["key", "wide", "n", "idx"]
        first = got.agg(F.count("*"), F.min("idx"), F.max("idx"), F.count_distinct("idx"), F.count_distinct("n")).first()
        assert tuple(first) == (n, 0, n - 1, n, n)
        assert [r.key for r in got.orderBy("idx").select("key").collect()] == sorted(r.key for r in rows.select("key").collect())
        assert got.where(F.col("wide") != F.repeat(F.md5(F.col("n").cast("string").cast("binary")), 20)).count() == 0
    finally:
        for k in own:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_dump_of_registers(spark):
    own = sketches.hll_registers(spark.range(500), "id", 8)
    data = sketches.hll_dump(own, 8)
    again, p = sketches.hll_load(spark, data)
    assert p == 8 and len(data) == 266 and sorted(map(tuple, again.collect())) == sorted(map(tuple, own.collect()))
    for bad in (b"", data[:-1], b"\0" * 300):
        with pytest.raises(ValueError):
            sketches.hll_load(spark, bad)


def test_bloom(spark):
    m, k = sketches.bloom_size(1000, 0.05)
    own = spark.range(1000).select(F.col("id").cast("string").alias("x"))
    bits = sketches.bloom_bits(own, "x", m, k)
    model = {int.from_bytes(hashlib.md5(str(i).encode() + struct.pack(">I", s)).digest()[:4], "big") % m for i in range(1000) for s in range(k)}
    assert {r.bit for r in bits.collect()} == model
    packed = {(r.cell, r.bits & (1 << 64) - 1) for r in sketches.bloom_pack(bits).collect()}
    assert {c * 64 + j for c, b in packed for j in range(64) if b >> j & 1} == model
    assert sketches.bloom_probe(own, "x", bits, m, k).count() == 1000
    assert sketches.bloom_probe(spark.range(10000, 11000).select(F.col("id").cast("string").alias("x")), "x", bits, m, k).count() <= 80
    for n, p in ((0, 0.1), (5, 0), (5, 1)):
        with pytest.raises(ValueError):
            sketches.bloom_size(n, p)


def test_hyperloglog(spark):
    def estimate(items, p=5):
        return sketches.hll_estimate(sketches.hll_registers(spark.createDataFrame([(x,) for x in items], "x string"), "x", p), p).first()[0]

    assert math.isclose(estimate(["abc", "dfg", "sng"] * 3), 3.1500823300240803) and math.isclose(estimate(["abc", "dfg", "sng", "edfg", "hija", "blghi"]), 6.644459672903825)
    assert estimate([]) == 0 and estimate([None]) == 0
    a, b = (sketches.hll_registers(spark.range(lo, lo + 3000).select(F.col("id").alias("x")), "x", 12) for lo in (0, 1500))
    assert abs(sketches.hll_estimate(sketches.hll_merge(a, b), 12).first()[0] - 4500) < 450
    with pytest.raises(ValueError):
        sketches.hll_registers(spark.range(1), "id", 3)


def test_quota_equals_buckets(spark):
    rng = random.Random(4)
    events = sorted((rng.randrange(3), rng.randrange(40_000_000), n) for n in range(400))
    df = spark.createDataFrame(events, "user_id long, ts_us long, event_id long")
    got = {r.event_id: r.allowed for r in quota.quota(df, 3, 5_000_000, 0, "user_id", "ts_us", "event_id").collect()}
    for user in range(3):
        bucket = quota.TokenBucket.new(3, 5, 0)
        for _, ts, n in sorted((e for e in events if e[0] == user), key=lambda e: e[1:]):
            assert got[n] == bucket.allow(ts * 1000)
    with pytest.raises(ValueError):
        quota.quota(df, 0, 1, 0)


def test_bucket():
    s = 10**9
    b = quota.TokenBucket.new(2, 3600, 0)
    assert [b.allow(k) for k in range(3)] == [True, True, False] and quota.TokenBucket.load(b.dump()) == b
    b = quota.TokenBucket.new(10, 1, 0)
    b.current = 0
    assert b.allow(int(1.5 * s)) and b.current == 9 and b.last_ns == s and b.next_refill_s(int(1.5 * s)) == 1
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            quota.TokenBucket.new(*bad, 0)
    with pytest.raises(ValueError):
        quota.TokenBucket.load(b"x")
