"""Bloom filters and HyperLogLog, as relations of bits and of registers."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import big_endian


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions for n items at false-positive rate p."""
    if not 0 < p < 1 or n < 1:
        raise ValueError("a Bloom filter needs items, and a rate between 0 and 1")
    m = math.ceil(n * abs(math.log(p)) / math.log(2) ** 2)
    return m, math.ceil(m / n * math.log(2))


def bloom_positions(item: Column, m: int, k: int) -> Column:
    """The k bits of an item: the first four bytes of md5(item, seed), seeds 0 to k - 1 as four bytes."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.conv(F.substring(F.md5(F.concat(item.cast("binary"), big_endian(s, 4))), 1, 8), 16, 10).cast("long") % m)


def bloom_bits(items: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """The bits that are set: one row each, m at most."""
    return items.select(F.explode(bloom_positions(F.col(column), m, k)).alias("bit")).distinct()


def bloom_pack(bits: DataFrame) -> DataFrame:
    """cell (bit div 64) and its bits as a long: the filter in m / 64 rows."""
    return bits.groupBy(F.floor(F.col("bit") / 64).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))


def bloom_probe(items: DataFrame, column: str, bits: DataFrame, m: int, k: int) -> DataFrame:
    """Items all of whose bits are set: all that were put in, and about the rate of the others."""
    asked = items.select(column).distinct().withColumn("bit", F.explode(F.array_distinct(bloom_positions(F.col(column), m, k))))
    met = asked.join(bits.withColumn("set", F.lit(1)), "bit", "left").groupBy(column).agg(F.count("set").alias("met"), F.count(F.lit(1)).alias("asked"))
    return met.where("met = asked").select(column)


def hll_registers(items: DataFrame, column: str, p: int = 12) -> DataFrame:
    """bucket and its largest rank: from the first eight bytes of md5, the top p bits and the trailing zeros + 1."""
    if not 4 <= p <= 16:
        raise ValueError("the precision is 4 to 16")
    digest = F.md5(F.col(column).cast("string").cast("binary"))
    bucket = F.shiftright(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), 16 - p)
    bits = F.lpad(F.conv(F.substring(digest, 1, 16), 16, 2), 64, "0")
    rank = F.length(F.regexp_extract(bits, "(0*)$", 1)) + 1
    return items.where(F.col(column).isNotNull()).select(bucket.alias("bucket"), rank.alias("rank")).groupBy("bucket").agg(F.max("rank").alias("rank"))


def hll_merge(*registers: DataFrame) -> DataFrame:
    every = registers[0]
    for r in registers[1:]:
        every = every.unionByName(r)
    return every.groupBy("bucket").agg(F.max("rank").alias("rank"))


def hll_dump(registers: DataFrame, p: int = 12) -> bytes:
    """Precision (2 bytes, big-endian), number of registers (8) and a byte for each: 65,546 bytes at most."""
    out = bytearray(1 << p)
    for r in registers.collect():  # a row for each register
        out[r["bucket"]] = r["rank"]
    return struct.pack(">HQ", p, 1 << p) + bytes(out)


def hll_load(spark: SparkSession, data: bytes) -> tuple[DataFrame, int]:
    """Registers and precision of a dump; ValueError where its size doesn't fit."""
    p, m = struct.unpack(">HQ", data[:10]) if len(data) >= 10 else (0, 0)
    if not 4 <= p <= 16 or m != 1 << p or len(data) != 10 + m:
        raise ValueError("no dump of registers")
    return spark.createDataFrame([(k, r) for k, r in enumerate(data[10:]) if r], "bucket int, rank int"), p


def hll_estimate(registers: DataFrame, p: int = 12) -> DataFrame:
    """One row with the estimate, corrected for small and large counts."""
    m, top = 1 << p, float(1 << 32)
    alpha = 0.7213 / (1 + 1.079 / m)
    own = registers.agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count(F.lit(1)).alias("n"))
    own = own.select((F.coalesce("s", F.lit(0.0)) + (m - F.col("n"))).alias("s"), (m - F.col("n")).alias("empty")).withColumn("e", F.lit(alpha * m * m) / F.col("s"))
    small = F.when(F.col("empty") > 0, m * F.log(m / F.col("empty"))).otherwise(F.col("e"))
    return own.select(F.when(F.col("e") <= 2.5 * m, small).when(F.col("e") > top / 30, -top * F.log(1 - F.col("e") / top)).otherwise(F.col("e")).alias("estimate"))
