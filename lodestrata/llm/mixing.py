"""Mixing sources to target weights by capped water-filling.

The total is `total_share` of all sizes (words). It is dealt to sources by weight; a source stops at `most_epochs` times its
size and what it can't take goes to the others by weight, until none is above. Sources in the order of cap / weight
show where that ends: the first one for which the level (what is left / the weight that is left) is no more than
cap / weight, and all after it, get level x weight; those before it get their cap.

Each source repeats its documents floor(target / size) times, and then once more those that come first in a seeded
order, until the words that are missing are met as nearly as one document allows. The seeded order is md5(seed:doc_id). Its
first three digits part a source into 4096 buckets: sums of buckets find the one in which the source's last document lies, and
only that bucket's documents are ordered.

The order of sources is a window over one row for each: with hundreds of millions of sources that one task sorts on disk.

Sources are ordered by code point, null last, and weigh `weights`, repeating. A null text has size 0, and so has an
empty one; a source without words has target 0. Repeated rows each count. Rows of one doc_id, or a null doc_id, stand
together in the seeded order and are taken together, so a source may then miss its target by their words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import freed, name, stored

#: The fixed seed of the production mix.
SEED = 17


def turn_of(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def sizes(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (runs of [^\\x20\\x09-\\x0D]), turn (place in the seeded order)."""
    own = docs.select(name(id_col).alias("doc_id"), name(source_col).cast("string").alias("source"), name(text_col).cast("string").alias("text"))
    turn = turn_of(F.col("doc_id"), seed)
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    return own.select("doc_id", "source", size.alias("size"), turn.alias("turn"))


def targets(by_source: DataFrame, weights: Sequence[int] = (3, 1, 2), total_share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """source, source_size -> with target. One row for each source: windows over them hold no documents."""
    weigh = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("ratio", "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = by_source.withColumn("weight", weigh).withColumn("cap", F.lit(most_epochs) * F.col("source_size"))
    own = own.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("total", F.lit(float(total_share)) * F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    own = own.withColumn("level", level)
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))).over(every)
    own = own.withColumn("final", final["level"])
    return own.select("source", "source_size", F.when(F.col("final").isNull() | (F.col("cap") <= F.col("final") * F.col("weight")), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def plan(own: DataFrame, weights: Sequence[int] = (3, 1, 2), total_share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """From sizes(): a row for each source, with its target and what repeats() needs."""
    with freed(own.sparkSession, kept=("mix-plan",)):
        return _plan(own, weights, total_share, most_epochs)


def _plan(own: DataFrame, weights: Sequence[int], total_share: float, most_epochs: int) -> DataFrame:
    own = own.withColumn("bucket", F.substring("turn", 1, 3))
    buckets = stored(own.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")  # 4096 rows a source at most
    goal = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total_share, most_epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = stored(goal.withColumn("more", F.col("target") - F.col("whole") * F.col("source_size")), "mix-goals")
    in_turn = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = buckets.withColumn("upto", F.sum("words").over(in_turn)).join(goal, buckets["source"].eqNullSafe(goal["source"])).select(buckets["source"], "bucket", "words", "upto", "more")
    edge = filled.where((F.col("upto") - F.col("words") < F.col("more")) & (F.col("upto") >= F.col("more"))).select(F.col("source").alias("edge_source"), F.col("bucket").alias("edge_bucket"), (F.col("more") - F.col("upto") + F.col("words")).alias("left"))
    last = own.join(edge, own["source"].eqNullSafe(edge["edge_source"]) & (own["bucket"] == edge["edge_bucket"])).groupBy("source", "turn", "left").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = last.withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2 <= F.col("left")).groupBy(F.col("source").alias("last_source")).agg(F.max("turn").alias("last_turn"))
    out = goal.join(edge, goal["source"].eqNullSafe(edge["edge_source"]), "left").join(last, goal["source"].eqNullSafe(F.col("last_source")), "left")
    return stored(out.select(goal["source"].alias("plan_source"), "source_size", "target", "whole", "edge_bucket", "last_turn"), "mix-plan")


def repeats() -> Column:
    """How often the mix takes a row that has its turn and its source's plan: all of the buckets before the edge, and within its bucket up to the last document."""
    bucket = F.substring("turn", 1, 3)
    extra = (bucket < F.col("edge_bucket")) | ((bucket == F.col("edge_bucket")) & (F.col("turn") <= F.col("last_turn")))
    return F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), total_share: float = 1.5, most_epochs: int = 2, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, repeats (times that the mix takes the document), taken (repeats x size)."""
    own = stored(sizes(docs, seed, id_col, text_col, source_col), "mix-sizes")
    told = plan(own, weights, total_share, most_epochs)
    out = own.join(told, own["source"].eqNullSafe(told["plan_source"])).withColumn("repeats", repeats())
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **goals: object) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its own columns."""
    with freed(docs.sparkSession, kept=("mix-plan",)):
        told = plan(stored(sizes(docs, seed, id_col, text_col, source_col), "mix-sizes"), **goals)
    every = docs.select(F.struct("*").alias("row"), turn_of(name(id_col), seed).alias("turn"), name(source_col).cast("string").alias("of_source"))
    out = every.join(told, F.col("of_source").eqNullSafe(F.col("plan_source")))
    return out.select("row", F.explode(F.array_repeat(F.lit(1), repeats().cast("int")))).select("row.*")
