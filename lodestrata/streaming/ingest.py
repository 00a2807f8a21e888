"""A stream of writes becomes runs of a store, one for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.resolve import latest
from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, once: bool = False) -> StreamingQuery:
    """stream: key, ts_ns, tombstone, value, seq. Of a batch only each key's newest write is stored.

    A batch that is run again after a failure writes rows that are already there, which changes no result: the newest
    version of a key is the same with its repetition.
    """

    def each(batch: DataFrame, _: int) -> None:
        store.ingest(latest(batch))

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
