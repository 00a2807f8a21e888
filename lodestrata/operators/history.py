"""All versions of keys, in the order in which they were written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import with_defaults
from .resolve import live


def _chronological(last_first: bool = False) -> list[Column]:
    order = [F.col("ts_ns"), -F.col("source_rank"), F.col("seq")]
    return [c.desc() for c in order] if last_first else order


def versions(log: DataFrame) -> DataFrame:
    """Each row with version, 0 for a key's first."""
    columns = log.columns
    out = with_defaults(log).withColumn("version", (F.row_number().over(Window.partitionBy("key").orderBy(*_chronological())) - 1).cast("long"))
    return out.select(*columns, "version")


def nth(log: DataFrame, version: int) -> DataFrame:
    """A key's version by number, 0 its first. The bound on the rank is planned as a window group limit: each task sends version + 1 rows a key."""
    columns = log.columns
    ranked = with_defaults(log).withColumn("_rank", F.row_number().over(Window.partitionBy("key").orderBy(*_chronological())))
    return ranked.where((F.col("_rank") <= version + 1) & (F.col("_rank") == version + 1)).select(*columns, (F.col("_rank") - 1).cast("long").alias("version"))


def first(log: DataFrame) -> DataFrame:
    return nth(log, 0)


def last(log: DataFrame) -> DataFrame:
    """The chronologically last version of each key, tombstone or not."""
    columns = log.columns
    ranked = with_defaults(log).withColumn("_rank", F.row_number().over(Window.partitionBy("key").orderBy(*_chronological(True))))
    return ranked.where("_rank = 1").select(*columns)


def at(log: DataFrame, ts_ns: int | DataFrame) -> DataFrame:
    """Versions of exactly this time, or of the times in the one column of a DataFrame."""
    if isinstance(ts_ns, DataFrame):
        times = ts_ns.toDF("_at")
        return log.join(times, log["ts_ns"] == times["_at"], "left_semi")
    return log.where(F.col("ts_ns") == ts_ns)


def counts(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.count(F.lit(1)).alias("versions"))


def listing(log: DataFrame) -> DataFrame:
    """Values by key and time: one row for each time, no tombstones."""
    out = with_defaults(log).groupBy("key", "ts_ns").agg(F.max_by(F.struct("tombstone", "value"), F.struct(-F.col("source_rank"), F.col("seq"))).alias("x"))
    return out.where("not x.tombstone").select("key", "ts_ns", F.col("x.value").alias("value"))


def as_of(log: DataFrame, ts_ns: int) -> DataFrame:
    """Live rows as they were at a time: the bound on time goes below the choice of versions."""
    return live(log.where(F.col("ts_ns") <= ts_ns))
