"""Which version of a key counts: latest wins, and what a merge of runs keeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import with_defaults


def recency() -> list[Column]:
    """Newest first: time, then the nearer source, then the later write."""
    return [F.col("ts_ns").desc(), F.col("source_rank").asc(), F.col("seq").desc()]


def latest(log: DataFrame, *by: str) -> DataFrame:
    """The newest version of each key, tombstones too; with other columns, of each key in each of their groups.

    Only predicates on the key may go below this. The rank filter is planned as a window group limit: each task
    keeps one row a key before the shuffle, so a key with very many versions sends few.
    """
    columns = log.columns
    ranked = with_defaults(log).withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "key").orderBy(*recency())))
    return ranked.where("_rank = 1").select(*columns)


def live(log: DataFrame) -> DataFrame:
    """Latest versions that are no tombstones; the tombstones have hidden older versions first."""
    return latest(log).where(~F.col("tombstone"))


def deleted(log: DataFrame) -> DataFrame:
    return latest(log).where("tombstone")


def together(sources: Sequence[DataFrame]) -> DataFrame:
    """A bag union of sources, nearest first: equal times are settled in their order."""
    out = None
    for rank, source in enumerate(sources):
        source = source.drop("source_rank").withColumn("source_rank", F.lit(rank).cast("long"))
        out = source if out is None else out.unionByName(source, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def merge(sources: Sequence[DataFrame], purge: bool = False) -> DataFrame:
    """One row a key from several runs. purge: without tombstones, safe only where no older run has those keys."""
    out = latest(together(sources))
    return (out.where(~F.col("tombstone")) if purge else out).drop("source_rank")


def zone_map(log: DataFrame, *by: str) -> DataFrame:
    """Smallest and largest key, rows and largest time, of all rows or by group."""
    return log.groupBy(*by).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("rows"), F.max("ts_ns").alias("max_ts_ns"))


def run_of(capacity: int, seq: str = "seq") -> Column:
    """The memtable instance that a write falls in, when `capacity` writes fill one."""
    return F.floor(F.col(seq) / F.lit(capacity)).cast("long")


def newest_record(log: DataFrame) -> DataFrame:
    """The row of the largest time: one row, or none."""
    columns = log.columns
    return with_defaults(log).orderBy(*recency(), "key").limit(1).select(*columns)


def after(log: DataFrame, high_watermark: int) -> DataFrame:
    """What replay adds: strictly later than the watermark."""
    return log.where(F.col("ts_ns") > high_watermark)
