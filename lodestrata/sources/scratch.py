"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local master gets one of its own; a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def drop_scratch(spark: SparkSession, path: str | None = None) -> None:
    """Delete one scratch folder, or all that this process made. Results read from them are gone after that."""
    jvm = spark.sparkContext._jvm
    for one in [path] if path else list(_made):
        where = jvm.org.apache.hadoop.fs.Path(one)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if one in _made:
            _made.remove(one)


@contextmanager
def freed(spark: SparkSession, *, kept: tuple[str, ...] = ()) -> Iterator[None]:
    """Scratch folders made in the block go at its end, also when it fails; but for those whose tags are kept."""
    before = set(_made)
    try:
        yield
    finally:
        for path in [p for p in _made if p not in before and not p.rsplit("/", 1)[-1].startswith(tuple(f"{t}-" for t in kept) or ("\0",))]:
            drop_scratch(spark, path)


def stored(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write a table to the shared folder and read it again: a lost executor costs no more than what it was reading."""
    path = scratch(df.sparkSession, tag)
    out = df.write
    if by:
        out = out.partitionBy(*by)
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
