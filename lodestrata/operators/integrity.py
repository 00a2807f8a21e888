"""Checksums and Merkle trees over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import record_bytes, record_crc
from ..sources.scratch import stored

#: Levels of the tree that one shuffle folds.
FOLD = 10


def with_crc(log: DataFrame) -> DataFrame:
    return log.withColumn("crc", record_crc())


def corrupt(log: DataFrame) -> DataFrame:
    """Rows of a log with crc that it doesn't fit."""
    return log.where(~F.col("crc").eqNullSafe(record_crc()))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """idx from 0 in a global order, without one task for all rows.

    Range partitions are sorted and written once, each row with its partition and its place there. Counts and offsets come from that one table: a plan
    that ran twice might draw other bounds or coalesce otherwise. Rows that tie in `order` share their places out in any way.
    """
    names, mask = rows.columns, (1 << 33) - 1
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit(mask))
    sizes = placed.groupBy(part.alias("_of")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    offsets = sizes.select("_of", F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(offsets), part == offsets["_of"])
    return joined.select(*names, (F.col("_before") + within).alias("idx"))


def leaves(log: DataFrame) -> DataFrame:
    """idx (by key, then newest first), key, hash: SHA-256 of the record's bytes."""
    own = log.withColumn("hash", F.sha2(record_bytes(), 256)).withColumn("_newest", -F.col("ts_ns"))
    return numbered(own.select("key", "hash", "_newest"), "key", "_newest", "hash").select("idx", "key", "hash")


def root(hashes: DataFrame) -> DataFrame:
    """hashes: idx, hash -> one row with the root. Odd levels are padded with 32 zero bytes.

    Each shuffle folds ten levels, so a trillion leaves take four.
    """
    n = hashes.count()
    if not n:
        raise ValueError("a Merkle tree needs a leaf")
    pair = lambda h, i: F.sha2(F.concat(F.unhex(F.get(h, 2 * i)), F.coalesce(F.unhex(F.get(h, 2 * i + 1)), F.lit(bytes(32)))), 256)
    level = lambda h: F.transform(F.sequence(F.lit(0), F.ceil(F.size(h) / 2).cast("int") - 1), lambda i: pair(h, i))
    out = hashes.select("idx", "hash")
    while True:
        last = n <= 1 << FOLD
        grouped = out.groupBy(F.shiftright("idx", FOLD).alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("x"))
        folded = F.aggregate(F.sequence(F.lit(1), F.lit(FOLD)), F.col("x.hash"), lambda h, _: F.when((F.size(h) == 1) & F.lit(last), h).otherwise(level(h)))
        out = grouped.select("idx", F.get(folded, 0).alias("hash"))
        if last:
            return out.select(F.col("hash").alias("root"))
        n = -(-n // (1 << FOLD))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaves that differ by position: idx, key and hash of b (null where b ends first)."""
    x, y = a.select("idx", F.col("hash").alias("was")), b.select(F.col("idx").alias("at"), "key", "hash")
    return x.join(y, x["idx"] == y["at"], "full_outer").where(~F.col("was").eqNullSafe(F.col("hash"))).select(F.coalesce("idx", "at").alias("idx"), "key", "hash")


def validate(log: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a run that its stored leaves don't know: empty for a sound run."""
    return difference(stored, leaves(log))
