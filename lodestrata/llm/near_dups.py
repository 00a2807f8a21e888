"""Jaccard join of documents' word shingles: an LSH forest of MinHash signatures, then exact verification.

1. Signatures. A document's shingles (five words; a document of fewer words is one shingle, one of none has none)
   are hashed to 64 bits. Documents of equal shingle sets are one set: exact copies are never paired.
2. Forest. Each of TREES trees has DEPTH minima of its own, a set's path. Sorted by path, the sets below a node of a tree are those that share a
   prefix. Sets alone below a node of the depth at which shortening must end meet nobody in that tree and go first. Pairs meet first at the longest prefixes: all nodes of depth DEPTH are searched, and then shorter ones, one step at a time, each for the pairs that
   no longer prefix of any tree has brought together. How likely are pairs that they meet this deep? The likenesses of those found so far tell, by the minima of the other
   trees: shortening ends when even the weakest class of them had to be found with the target probability, or pairs at the threshold had to. With none but
   close copies it ends early.
3. Candidates are pairs that met, whose sizes allow the threshold and whose signatures estimate no less than the threshold - MARGIN (pairs at the threshold
   fall below by chance once in a million). Each is the business of one node: the first tree in which it met. Pairs aren't written: a node
   of many sets is dealt into blocks, bounded in sets and in bytes, each pair of blocks is a unit of work, and a unit writes which of its sets have candidates.
4. Verification. A unit gets the shingles of those sets, finds its candidates again and counts what they share, exactly. Only each set's number of links and a
   spanning forest of the links leave a unit. Components of links are the classes.

So nothing but candidates is compared exactly, and no task gets a whole large node. Null texts and texts without words have no links: each is a class of its own.
Repeated rows are copies. Rows whose doc_id is null take part; a class is named by its smallest doc_id (null if it has none). Sets with so many copies that
they hold a thousandth of all rows get their class from a broadcast of at most a thousand rows, the others by a shuffle that they can't tilt. What grows with
the documents is joined by sorting at every size, so that small inputs run as large ones do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import freed, map_texts, stored, texts, words

TREES, DEPTH = 16, 6
RECALL = 0.999
#: How far a signature's estimate may fall below the threshold (0.8: five standard deviations of 96 minima).
MARGIN = 0.2
#: A block has at most about so many sets, and bytes of shingles; a longer set is a block by itself.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Pairs of sets that are looked at together.
PAIRS = 1 << 16
#: Classes of likeness from the threshold to 1.
BINS = 10
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * P2
    x = (x ^ (x >> np.uint64(29))) * P1
    return x ^ (x >> np.uint64(32))


def shingles(text: list[bytes], size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of each `size` consecutive words, or of all if there are fewer."""
    if not text:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, text), np.uint64, len(text))
    n = max(1, len(own) - size + 1)
    out = np.full(n, min(size, len(own)), np.uint64)
    for k in range(min(size, len(own))):
        out = mixed(out * P1 + own[k : k + n])
    return np.unique(out)


def meeting(s: float, depth: int, trees: int = TREES) -> float:
    """How likely two sets of this likeness share a prefix of this depth in some tree."""
    return 1 - (1 - s**depth) ** trees


def deep_enough(found: dict[int, int], depth: int, threshold: float, recall: float = RECALL) -> bool:
    """Whether pairs of the weakest class of likeness that was found (class: pairs) had to meet at this depth, or any pairs at the threshold."""
    weakest = [threshold + (1 - threshold) * b / BINS for b, n in found.items() if n > 0]
    return depth <= 1 or meeting(min(weakest, default=threshold), depth) >= recall or meeting(threshold, depth) >= recall


class Signer:
    def __init__(self, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        n = trees * depth
        self.a = rng.integers(1, 2**63, n, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, np.uint64)[:, None]

    def sign(self, own: np.ndarray) -> np.ndarray:
        """The paths in all trees, one after the other: 16 bits of each function's minimum."""
        least = None
        for k in range(0, len(own), 4096):
            part = (self.a * own[None, k : k + 4096] + self.b).min(1)
            least = part if least is None else np.minimum(least, part)
        return (least >> np.uint64(24)).astype("<u2")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys together, from sorted batches. A run is a unit of work, bounded by the blocks."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.nonzero(change)[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(c[a] for c in columns)
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def prefixes(paths: np.ndarray, depth: int) -> np.ndarray:
    """paths (sets x trees x steps) -> a number for each set's prefix in each tree."""
    out = np.zeros(paths.shape[:2], np.uint64)
    for k in range(depth):
        out = mixed(out * P1 + paths[:, :, k].astype(np.uint64) + np.uint64(1))
    return out


def candidates(unit: dict[str, np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows that are candidates here, and their likeness by the other trees' minima; some pairs at a time.

    unit: of one or several units' rows, one unit after the other, end (where the row's unit ends), cross (pairs within a block are no business of the unit),
    block, tree, depth, size and paths (rows x trees x steps).
    """
    end, paths, depth = unit["end"], unit["paths"], int(unit["depth"][0])
    n, codes = len(end), prefixes(paths, depth)
    deeper = prefixes(paths, depth + 1) if depth < paths.shape[2] else None
    flat, trees = paths.reshape(n, -1), np.arange(paths.shape[1])
    partners = end - 1 - np.arange(n)
    upto = np.cumsum(partners)
    begin = 0
    while begin < n:
        stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
        count = partners[begin:stop]
        i = np.repeat(np.arange(begin, stop), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        begin = stop
        keep = ~unit["cross"][i] | (unit["block"][i] != unit["block"][j])
        a, b = unit["size"][i], unit["size"][j]
        keep &= np.minimum(a, b) >= (threshold - 1e-9) * np.maximum(a, b)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        tree = unit["tree"][i]
        keep = ~((codes[i] == codes[j]) & (trees[None, :] < tree[:, None])).any(1)  # met in an earlier tree
        if deeper is not None:
            keep &= ~(deeper[i] == deeper[j]).any(1)  # met by a longer prefix
        i, j, tree = i[keep], j[keep], tree[keep]
        equal = (flat[i] == flat[j]).sum(1)
        keep = equal >= (threshold - MARGIN) * flat.shape[1]
        i, j, tree, equal = i[keep], j[keep], tree[keep], equal[keep]
        if len(i):
            own = (paths[i, tree] == paths[j, tree]).sum(1)
            yield i, j, (equal - own) / (flat.shape[1] - paths.shape[2])


def shared(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """How many hashes each of a has in common with each of b (or of a), as a matrix."""
    every = a if b is None else [*a, *b]
    sizes, n = np.array([len(x) for x in every], np.int64), len(a)
    out = np.zeros((n, len(a if b is None else b)), np.float32)  # counts are whole and below 2^24
    row = np.repeat(np.arange(len(every)), sizes)
    _, column, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    common = times[column] > 1
    row, column = row[common], column[common]
    if len(column):
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        top = int(column[-1]) + 1
        for c in range(0, top, 2048):
            x, y = np.searchsorted(column, [c, c + 2048])
            part = np.zeros((len(every), min(2048, top - c)), np.float32)
            part[row[x:y], column[x:y] - c] = 1
            out += part[:n] @ (part if b is None else part[n:]).T
    return out


def linked(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float, first: np.ndarray | None = None) -> np.ndarray:
    """Which of these pairs have Jaccard >= threshold, exactly. first: marks one of two blocks, where pairs go from one to the other."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(i) <= 2 * len(sets):  # few pairs: one by one
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], np.int64)
    elif first is None or first.all() or not first.any():
        both = shared(sets)[i, j].astype(np.int64)
    else:
        place = np.where(first, np.cumsum(first), np.cumsum(~first)) - 1
        matrix = shared([s for s, f in zip(sets, first) if f], [s for s, f in zip(sets, first) if not f])
        one, other = np.where(first[i], i, j), np.where(first[i], j, i)
        both = matrix[place[one], place[other]].astype(np.int64)
    num, den = int(round(threshold * 1_000_000)), 1_000_000
    return both * den >= num * (sizes[i] + sizes[j] - both)


def stars(n: int, i: np.ndarray, j: np.ndarray, ids: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Components of links among n rows, each as (smallest id, other id) for all its others."""
    label = np.argsort(np.argsort(ids))  # by id, so the smallest label is the smallest id
    order = np.argsort(label)
    while True:
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = np.minimum(label, label[order[label]])
        if (label == before).all():
            break
    return [(ids[order[label[k]]], ids[k]) for k in np.unique(np.concatenate([i, j])).tolist() if order[label[k]] != k]


def in_blocks(rows: DataFrame, keys: list[str], node: str) -> DataFrame:
    """rows with n and bytes (of all that share the keys) -> one row for each unit of work (keys, b1, b2) that a row is in, and its block."""
    count = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = rows.withColumn("blocks", count).withColumn("block", F.pmod(F.xxhash64(node, F.lit(3)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # (b, b) has the pairs inside a block, (b1, b2) those across two
    return dealt.select("*", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2")).drop("blocks", "other", "n", "bytes")


def components(edges: DataFrame) -> DataFrame:
    """a, b -> node, root (one node of each component; itself has a row too).

    A round hooks each node to its smallest neighbour that is smaller, jumps along the hooks to their roots, and contracts the edges
    to their ends' roots; edges within a root go. Stars are done after one round, and paths of n after one with log n jumps.
    """

    def between(df: DataFrame) -> DataFrame:
        return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()

    edges, labels = stored(between(edges), "edges"), None
    while labels is None or edges.limit(1).count():
        hooks = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        while True:  # until no root is hooked itself
            hooks = stored(hooks, "hooks")
            up = hooks.select(F.col("node").alias("at"), F.col("root").alias("top"))
            if not hooks.join(up, hooks["root"] == up["at"], "left_semi").limit(1).count():
                break
            hooks = hooks.join(up, hooks["root"] == up["at"], "left").select("node", F.coalesce("top", "root").alias("root"))
        if labels is None:
            labels = hooks
        else:
            labels = stored(labels.join(up, labels["root"] == up["at"], "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(hooks), "labels")
        for end, other in (("a", "b"), ("b", "a")):
            edges = edges.join(up, edges[end] == up["at"], "left").select(F.coalesce("top", end).alias(end), other)
        edges = stored(between(edges), "edges")
    return labels.unionByName(labels.select(F.col("root").alias("node"), "root").distinct())


def _signed(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, set_id (null without words), size (shingles), paths."""

    def each(data: list[bytes]) -> dict:
        signer, out = Signer(), {"set_id": [], "size": [], "paths": []}
        for x in data:
            own = shingles(words(x), size)
            if not len(own):
                for v in out.values():
                    v.append(None)
                continue
            out["set_id"].append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            out["size"].append(len(own))
            out["paths"].append(signer.sign(own).tobytes())
        return out

    return map_texts(docs, each, "set_id binary, size long, paths binary", id_col, text_col)


UNIT = ["depth", "key", "b1", "b2"]


def _rows(tables: list[pa.Table]) -> dict[str, np.ndarray]:
    """What candidates() takes, of whole units."""
    sizes = np.array([t.num_rows for t in tables])
    whole = pa.concat_tables(tables)
    out = {k: whole.column(k).to_numpy() for k in ("block", "tree", "depth", "size", "b1", "b2")}
    out["cross"], out["end"] = out["b1"] != out["b2"], np.repeat(np.cumsum(sizes), sizes)
    out["paths"] = np.frombuffer(b"".join(whole.column("paths").to_pylist()), "<u2").reshape(whole.num_rows, TREES, DEPTH)
    return out | {"table": whole}


def _key(depth: int) -> Column:
    """A node's number, from the tree and the first steps of the path."""
    return F.xxhash64("tree", F.substring("paths", F.lit(1) + 2 * DEPTH * F.col("tree"), F.lit(2 * depth)))


def _subtrees(sets: DataFrame, depth: int) -> DataFrame:
    """set_id, tree, size, paths of the sets that aren't alone below their node of this depth. Nobody else meets anyone at a longer prefix of that tree."""
    spots = sets.select("set_id", "paths", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("set_id", "tree", _key(depth).alias("key"))
    nodes = spots.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return spots.join(nodes.hint("merge"), "key", "left_semi").select("set_id", "tree").join(sets.select("set_id", "size", "paths").hint("merge"), "set_id")


def _met(spots: DataFrame, depth: int, threshold: float) -> DataFrame:
    """Nodes of this depth: the sets that have candidates in each unit, and how many pairs are in each class of likeness (bin, n)."""
    spots = spots.withColumns({"depth": F.lit(depth), "key": _key(depth)})
    nodes = spots.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * 8).alias("bytes")).where("n > 1")
    units = in_blocks(spots.join(nodes.hint("merge"), "key"), ["depth", "key"], "set_id").select(*UNIT, "block", "tree", "set_id", "size", "paths")
    schema = "depth int, key long, b1 int, b2 int, block int, tree int, set_id binary, bin int, n long"
    arrow = to_arrow_schema(spots.sparkSession.createDataFrame([], schema).schema)
    unit_columns = arrow.names[:7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(BINS, np.int64)

        def told(tables: list[pa.Table]) -> pa.RecordBatch:
            rows = _rows(tables)
            has = np.zeros(len(rows["end"]), bool)
            for i, j, like in candidates(rows, threshold):
                has[i] = has[j] = True
                like = like[like >= threshold]
                bins[:] += np.bincount(np.minimum(((like - threshold) / (1 - threshold) * BINS).astype(int), BINS - 1), minlength=BINS) if threshold < 1 else 0
            own = rows["table"].filter(pa.array(has)).select(unit_columns).combine_chunks()
            nothing = [pa.nulls(own.num_rows, pa.int32()), pa.nulls(own.num_rows, pa.int64())]
            columns = [own.column(k).combine_chunks() if own.num_rows else pa.array([], arrow.field(k).type) for k in unit_columns]
            return pa.RecordBatch.from_arrays([c.cast(arrow.field(k).type) for c, k in zip([*columns, *nothing], arrow.names)], schema=arrow)

        held, pairs = [], 0
        for unit in runs(batches, UNIT):
            held.append(unit)
            pairs += unit.num_rows**2 // 2
            if pairs >= PAIRS:
                yield told(held)
                held, pairs = [], 0
        if held:
            yield told(held)
        full = np.nonzero(bins)[0]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(full), f.type) for f in list(arrow)[:7]), pa.array(full, pa.int32()), pa.array(bins[full], pa.int64())], schema=arrow)

    return units.repartition(*UNIT[1:]).sortWithinPartitions(*UNIT).mapInArrow(run, schema)


def _bodies(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """wanted: set_id, first_id -> set_id, hashes: the shingles of each set, from one of its documents."""

    def hashed(data: list[bytes]) -> dict:
        made = [shingles(words(x), size) for x in data]
        return {"set_id": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in made], "hashes": [s.tobytes() for s in made]}

    own = texts(docs, id_col, text_col)
    bearing = own.join(wanted.select(F.col("first_id").alias("of")).distinct().hint("merge"), own["doc_id"].eqNullSafe(F.col("of")), "left_semi")
    # rows of one doc_id may have several texts: each set is taken once, by its id
    return map_texts(bearing, hashed, "set_id binary, hashes binary").select("set_id", "hashes").join(wanted.select("set_id").hint("merge"), "set_id", "left_semi").dropDuplicates(["set_id"])


def _links(units: DataFrame, threshold: float) -> DataFrame:
    """Units with the shingles of their sets -> edges (a, b) that join linked sets, and links of a set (b, links)."""
    schema = "a binary, b binary, links long"
    arrow = to_arrow_schema(units.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]
        for unit in runs(batches, UNIT):
            rows = _rows([unit])
            found = [(i, j) for i, j, _ in candidates(rows, threshold)]
            if not found:
                continue
            i, j = (np.concatenate(x) for x in zip(*found))
            sets = [np.frombuffer(x, np.uint64) for x in unit.column("hashes").to_pylist()]
            holds = linked(sets, i, j, threshold, rows["block"] == rows["b1"][0] if rows["cross"][0] else None)
            i, j = i[holds], j[holds]
            if not len(i):
                continue
            ids, copies = unit.column("set_id").to_pylist(), unit.column("copies").to_numpy()
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            pairs, some = stars(len(ids), i, j, ids), np.nonzero(links)[0].tolist()
            out[0] += [*(a for a, _ in pairs), *[None] * len(some)]
            out[1] += [*(b for _, b in pairs), *(ids[k] for k in some)]
            out[2] += [*[None] * len(pairs), *(int(links[k]) for k in some)]
            if len(out[0]) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, arrow)], schema=arrow)
                out = [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, arrow)], schema=arrow)

    return units.repartition(*UNIT).sortWithinPartitions(*UNIT, "set_id").mapInArrow(run, schema)


def join_near(docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, set_id, class_id (smallest doc_id of the class), n_links (other documents of Jaccard >= threshold, equal ones too), class_size."""
    with freed(docs.sparkSession, kept=("signed", "told")):
        return _join_near(docs, threshold, size, recall, id_col, text_col)


def _join_near(docs: DataFrame, threshold: float, size: int, recall: float, id_col: str, text_col: str) -> DataFrame:
    signed = stored(_signed(docs, size, id_col, text_col), "signed")
    sets = stored(signed.where("set_id is not null").groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.any_value("size").alias("size"), F.any_value("paths").alias("paths")), "sets")

    shortest = next(d for d in range(DEPTH, 0, -1) if deep_enough({}, d, threshold, recall))
    spots = stored(_subtrees(sets, shortest), "subtrees")
    met, found = None, dict.fromkeys(range(BINS), 0)
    for depth in range(DEPTH, shortest - 1, -1):
        level = stored(_met(spots, depth, threshold), "met")
        met = level if met is None else met.unionByName(level)
        for r in level.where("bin is not null").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # a row for each class of likeness
            found[r["bin"]] += r["n"]
        if deep_enough(found, depth, threshold, recall):
            break

    members = met.where("set_id is not null").drop("bin", "n")
    wanted = stored(sets.join(members.select("set_id").distinct(), "set_id", "left_semi"), "wanted")
    bodies = _bodies(docs, wanted, size, id_col, text_col).join(wanted.drop("first_id").hint("merge"), "set_id")
    links = stored(_links(members.join(bodies.hint("merge"), "set_id"), threshold), "links")

    classes = components(links.where("a is not null").select("a", "b").distinct())
    counts = links.where("links is not null").groupBy(F.col("b").alias("set_id")).agg(F.sum("links").alias("links"))
    own = sets.select("set_id", "copies", "first_id")
    told = own.join(classes, own["set_id"] == classes["node"], "left").select("set_id", "copies", "first_id", F.coalesce("root", "set_id").alias("root"))
    named = told.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    told = told.join(named, "root").join(counts, "set_id", "left")
    told = stored(told.select("set_id", "copies", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "told")

    rows = signed.select("doc_id", "set_id")
    often = max(1000, rows.count() // 1000)
    hot = F.broadcast(told.where(F.col("copies") > often).drop("copies").withColumnRenamed("set_id", "of"))  # at most a thousand sets
    at_once = rows.where("set_id is not null").join(hot, F.col("set_id") == F.col("of"), "left")
    columns = ["doc_id", "set_id", "class_id", "n_links", "class_size"]
    others = at_once.where("of is null").select("doc_id", "set_id").join(told.where(F.col("copies") <= often), "set_id")
    alone = rows.where("set_id is null").select("doc_id", "set_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size"))
    return at_once.where("of is not null").select(columns).unionByName(others.select(columns)).unionByName(alone)
