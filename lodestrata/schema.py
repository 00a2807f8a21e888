"""The log: one row for each write of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("ts_ns", T.LongType(), False),
        T.StructField("tombstone", T.BooleanType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("seq", T.LongType(), False),
    ]
)
#: A fixed value: the key under which quota state would be kept; users may neither read nor write it.
RESERVED = "__tb__state"


class InvalidKey(ValueError):
    """An empty or reserved key."""


def check_key(key: str) -> str:
    if not key:
        raise InvalidKey("a key must not be empty")
    if key == RESERVED:
        raise InvalidKey("this key is reserved")
    return key


def check_prefix(prefix: str) -> str:
    """A prefix scan may not show the reserved key."""
    if prefix and RESERVED.startswith(prefix):
        raise InvalidKey("this prefix covers the reserved key")
    return prefix


def with_defaults(log: DataFrame) -> DataFrame:
    """seq and source_rank, which break ties of time, where a source has none."""
    for name in ("seq", "source_rank"):
        if name not in log.columns:
            log = log.withColumn(name, F.lit(0).cast("long"))
    return log


def valid(log: DataFrame) -> DataFrame:
    """Rows that may be stored: a key that isn't reserved, a time, and no value on a tombstone."""
    return log.where((F.length("key") > 0) & (F.col("key") != RESERVED) & F.col("ts_ns").isNotNull() & (~F.col("tombstone") | F.col("value").isNull()))
