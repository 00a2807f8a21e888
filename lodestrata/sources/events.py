"""The events table as a log of writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys a user has.
KEYS = 40


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, ts_ns, tombstone, value (text), seq. Errors are deletions."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(":"), F.lpad((F.col("event_id") % KEYS).cast("string"), 2, "0"))
    gone = F.col("event_type") == "error"
    return events.select(
        key.alias("key"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") * 1000).alias("ts_ns"),
        gone.alias("tombstone"),
        F.when(~gone, F.concat_ws("#", "event_type", F.col("event_id").cast("string"))).alias("value"),
        F.col("event_id").alias("seq"),
    )
