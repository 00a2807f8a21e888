"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at both ends, A-Z lower-cased; its hash is two 64-bit hashes of the key.
Documents are taken in batches of descending doc_id, as many as the bytes of text ask for. A batch sums up its keys (documents that hold them, largest
doc_id) and merge-anti-joins the runs: a key that a run already shows in enough documents is settled, for its largest
document was in an earlier batch. What is left becomes a new run of level 0. When a level has `fanout` runs they are
merged into one run of the next. Runs are tables bucketed and sorted by hash, so those joins and merges move no run.
At the end the runs' counts are added up; keys in `least_docs` documents lose all lines but those of the largest doc_id.

Keys that hold more than a thousandth of all (key, document) pairs, of which there are a thousand at most, meet their lines in a broadcast join; the
others in a shuffle that none of them can tilt.

Documents are distinct doc_ids: rows that share one count once, and all of them keep a line if theirs is the largest. Rows without a doc_id count as
one document, smaller than any other. doc_id may have any type that has an order. Null and empty texts are one empty line. Repeated rows give the same result each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop_scratch, freed, scratch, stored, texts

SPACE = " \t\n\x0b\f\r"
#: Bytes of text in a batch, about, and the fewest batches.
BATCH_BYTES, LEAST_BATCHES = 1 << 40, 4
#: Sampled doc_ids for each batch, whose quantiles part the batches.
SAMPLED = 1000


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levels of runs. A run has h1, h2, n (documents that hold the key) and keeper (their largest doc_id)."""

    def __init__(self, spark: SparkSession, least_docs: int, fanout: int) -> None:
        self.spark, self.least_docs, self.fanout = spark, least_docs, fanout
        self.levels: list[list[tuple[str, str]]] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, run: DataFrame) -> tuple[str, str]:
        table, path = f"line_run_{uuid.uuid4().hex}", scratch(self.spark, "line-run")
        run.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(table)
        return table, path

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t, _ in level]

    def settled(self) -> list[DataFrame]:
        return [r.where(F.col("n") >= self.least_docs).select("h1", "h2") for r in self.runs()]

    def add(self, batch: DataFrame) -> None:
        """batch: h1, h2, doc_id of each line. No document is in two batches."""
        once = batch.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("_"))
        own = once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        for run in self.settled():
            own = own.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        self._put(0, self._write(own))

    def _put(self, level: int, run: tuple[str, str]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._write(self._summed([self.spark.table(t) for t, _ in old])))
            self._forget(old)

    def _forget(self, runs: list[tuple[str, str]]) -> None:
        for table, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            drop_scratch(self.spark, path)

    @staticmethod
    def _summed(runs: list[DataFrame]) -> DataFrame:
        """Runs merged two at a time: a full outer merge join, as a union of bucketed tables is not co-located."""
        every = runs[0]
        for r in runs[1:]:
            r = r.withColumnsRenamed({"n": "more", "keeper": "other"})
            n = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
            every = every.join(r.hint("merge"), ["h1", "h2"], "full_outer").select("h1", "h2", n.alias("n"), F.greatest("keeper", "other").alias("keeper"))
        return every

    def repeated(self) -> DataFrame:
        """h1, h2, n, keeper of the keys that are in enough documents."""
        runs = self.runs()
        every = self._summed(runs) if len(runs) > 1 else runs[0]
        return stored(every.where(F.col("n") >= self.least_docs).select("h1", "h2", "n", "keeper"), "line-repeats")

    def drop(self) -> None:
        for level in self.levels:
            self._forget(level)
        self.levels = []


def batch_of(own: DataFrame, batches: int) -> Column:
    """0 for the largest doc_ids; null ones come last."""
    ids = own.select("doc_id").where("doc_id is not null")
    chance = min(1.0, SAMPLED * batches / max(1, own.count()))
    some = sorted(r[0] for r in ids.where(F.rand(5) < chance).collect())
    out = F.lit(0)
    for e in sorted({some[len(some) * k // batches] for k in range(1, batches)}) if some else []:
        out = out + F.coalesce(F.col("doc_id") <= F.lit(e), F.lit(True)).cast("int")
    return out


def _drops(own: DataFrame, least_chars: int, least_docs: int, batches: int, fanout: int) -> DataFrame:
    """of, of_mark, drops: the numbers of the lines that each row loses."""
    hashed = F.transform(
        F.transform(lines_of(F.col("text")), lambda x, i: F.struct(key_of(x).alias("k"), i.alias("pos"))),
        lambda x: F.struct(F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit(7), x["k"]).alias("h2"), x["pos"].alias("pos"), (F.char_length(x["k"]) >= least_chars).alias("long")),
    )
    keyed = own.select("doc_id", "mark", F.explode(F.filter(hashed, lambda x: x["long"])).alias("x"), batch_of(own, batches).alias("batch"))
    lines = stored(keyed.select("doc_id", "mark", "x.h1", "x.h2", "x.pos", "batch"), "lines", "batch")
    runs = LineRuns(own.sparkSession, least_docs, fanout)
    try:
        for k in range(batches):
            runs.add(lines.where(F.col("batch") == k).select("h1", "h2", "doc_id"))
        repeats = runs.repeated()
        pairs = sum(r.agg(F.sum("n")).first()[0] or 0 for r in runs.runs())  # a number for each run
    finally:
        runs.drop()
    often = F.col("n") > max(1, pairs // 1000)
    hot = F.broadcast(repeats.where(often).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "keeper"))  # at most a thousand rows
    met = lines.select("doc_id", "mark", "h1", "h2", "pos").join(hot, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    others = met.where("g1 is null").drop("g1", "g2", "keeper").join(repeats.where(~often).select("h1", "h2", "keeper"), ["h1", "h2"])
    columns = ["doc_id", "mark", "pos", "keeper"]
    lost = met.where("g1 is not null").select(columns).unionByName(others.select(columns)).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # a document repeated as a row stands in `lines` twice with the same numbers
    return lost.groupBy(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark")).agg(F.collect_set("pos").alias("drops"))


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int | None = None, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text that is left). batches: as many as the bytes of all texts ask for, if it isn't given."""
    own = texts(docs, id_col, text_col).withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))  # tells rows of one doc_id apart
    if batches is None:
        batches = max(LEAST_BATCHES, -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BATCH_BYTES))
    with freed(docs.sparkSession, kept=("line-drops",)):
        dropped = stored(_drops(own, least_chars, least_docs, batches, fanout), "line-drops")
    out = own.join(dropped, own["doc_id"].eqNullSafe(dropped["of"]) & (own["mark"] == dropped["of_mark"]), "left")
    split = lines_of(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), "drops")
    kept = F.when(F.col("drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get("split", i)), "\n"))
    out = out.select("doc_id", "text", "drops", split.alias("split"))
    return out.select("doc_id", F.size("split").cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
