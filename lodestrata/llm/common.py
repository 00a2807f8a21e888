"""What the operators share: words, and mapping texts through Arrow."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import drop_scratch, freed, scratch, stored  # noqa: F401  for the operators

#: Bytes of words: 0-9, a-z and everything beyond ASCII; A-Z become a-z and the rest become spaces.
#: With split() this equals finding [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in a text whose A-Z are lower-cased.
WORD_BYTES = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def words(data: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return data.translate(WORD_BYTES).split()


def name(column: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for each Spark context: their Python needs no copy of its own."""
    context, top = spark.sparkContext, Path(__file__).resolve().parents[1]
    if not getattr(context, f"_{top.name}_sent", False):
        to = os.path.join(tempfile.mkdtemp(), f"{top.name}.zip")
        with zipfile.ZipFile(to, "w") as out:
            for p in sorted(top.rglob("*.py")):
                out.write(p, str(p.relative_to(top.parent)))
        context.addPyFile(to)
        setattr(context, f"_{top.name}_sent", True)


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task: one thing at a time, so that an operator's tables go when the next operator's tasks come to the same worker."""
    if key not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just doc_id and text; other columns, whatever they are called, play no part."""
    ship(docs.sparkSession)
    return docs.select(name(id_col).alias("doc_id"), name(text_col).cast("string").alias("text"))


def pieces(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `most` bytes of text; a longer text is a part by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.nonzero(np.diff(ends // most))[0] + 1).tolist(), batch.num_rows] if batch.num_rows else []
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def map_texts(docs: DataFrame, each: Callable[[list[bytes]], dict], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """each(UTF-8 texts) -> columns, for a few MB of whole texts at a time. A null text is empty."""
    own = texts(docs, id_col, text_col)
    fields = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {schema}"
    names = own.sparkSession.createDataFrame([], fields).schema.names
    types = [None] * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1):
                ids, data = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
                got = each([x or b"" for x in data])
                got = {"doc_id": ids, **got}
                yield pa.RecordBatch.from_arrays([got[n] if isinstance(got[n], pa.Array) else pa.array(got[n], type=t) for n, t in zip(names, types)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in own.sparkSession.createDataFrame([], fields).schema]
    return own.mapInArrow(run, fields)
