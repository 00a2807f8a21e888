"""Document fingerprints as invertible Bloom lookup sketches.

A text's paragraphs are its lines, cut after PIECE code points. A text of fewer than SHORT code points also has stretches of 2^k code points,
eight to fifteen of them, as it may be one line. Each distinct one has a 64-bit digest. A sketch has three
sections of CELLS cells; a digest goes to one cell of each, which holds a count, the xor of digests and the xor of their
checks. Sketches of two versions subtract cell by cell, which leaves the digests that only one of them has. Peeling takes
digests from cells that hold just one (count 1 or -1, check right) out of their other cells, until nothing is left, which
tells how many each version has alone. Where it gets stuck it is tried again larger: the digests are dealt into FANOUT parts,
each with a sketch of its own, and parts that get stuck are dealt again; after LEVELS times what is left is compared directly.

All of it is expressions of Spark SQL over one exchange of the texts. The next document comes by range buckets of (doc_id, hash of the text): their
edges are documents from a sample, so each edge is its bucket's first document, which also goes to the bucket before: no window spans more than one
bucket, and each row finds its bucket by bisection. A document that is repeated as a row so often that it would fill buckets goes through as one row with a count.

The likeness of two fingerprints is shared / all distinct digests; two without any are alike (1). Null and empty texts have no paragraphs
and 0 characters. doc_id may have any type that has an order. A null doc_id comes last in descending order; rows of one doc_id follow by descending hash of the text. The
only document is its own next, and of rows that repeat a document all but the last have an equal one as their next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, texts

PIECE, SHORT = 160, 480
CELLS = 8
ROUNDS = 12
FANOUT, LEVELS = 4, 12
#: Documents in a range bucket, about, up to a number of buckets; beyond it buckets grow. Few documents have smaller buckets, of LEAST_BUCKET on, for all cores to have some.
BUCKET, LEAST_BUCKET, MOST_BUCKETS = 4_000, 64, 16_384
#: Sampled documents for each bucket.
SAMPLED = 20


def digests(text: Column) -> Column:
    """Distinct digests of a text's paragraphs."""
    n = F.char_length(text)
    width = F.greatest(F.lit(1), F.pow(F.lit(2), F.floor(F.log2(F.greatest(n, F.lit(1)) / 8))).cast("int"))
    lines = F.transform(F.regexp_extract_all(text, F.lit(f"[^\\n]{{1,{PIECE}}}"), F.lit(0)), lambda x: F.xxhash64(x))
    short = F.when((n > 0) & (n < SHORT), F.transform(F.sequence(F.lit(1), n, width), lambda k: F.xxhash64(F.substring(text, k, width), F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(lines, short))


def own_bits(key: str, level: str) -> str:
    """A digest's bits from those of a level on. A level has eleven of its own: three times three for cells, two for parts; after five levels digests are hashed anew."""
    return key if level == "0" else f"shiftright(if({level} < 5, {key}, xxhash64({key}, {level} div 5)), {level} % 5 * 11)"


def sketch(keys: str, level: str = "0") -> str:
    """Cells: n (count), k (xor of digests), c (xor of their checks); a digest is in the cell if its bits from s on are v."""
    cells = ", ".join(f"named_struct('s', {3 * j}, 'v', {v}L)" for j in range(3) for v in range(CELLS))
    told = f"transform({keys}, k -> named_struct('k', k, 'b', {own_bits('k', level)}, 'c', xxhash64(k)))"
    return f"""transform(array({told}), r -> transform(array({cells}), p -> aggregate(r, named_struct('n', 0, 'k', 0L, 'c', 0L, 's', p.s, 'v', p.v),
        (a, k) -> if(shiftright(k.b, p.s) & {CELLS - 1} = p.v, named_struct('n', a.n + 1, 'k', a.k ^ k.k, 'c', a.c ^ k.c, 's', p.s, 'v', p.v), a))))[0]"""


def minus(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c, 's', x.s, 'v', x.v))"


def peeled(cells: str, level: str = "0") -> str:
    """whole (all was recovered), plus and minus (digests recovered that the first or the second has alone)."""
    pure = f"array_distinct(transform(filter(s.cells, x -> abs(x.n) = 1 and x.c = xxhash64(x.k)), x -> named_struct('k', x.k, 'n', x.n, 'c', x.c, 'b', {own_bits('x.k', level)})))"
    left = f"""aggregate(u, x, (a, q) -> if(shiftright(q.b, x.s) & {CELLS - 1} = x.v,
        named_struct('n', a.n - q.n, 'k', a.k ^ q.k, 'c', a.c ^ q.c, 's', x.s, 'v', x.v), a))"""
    # transform(array(x), u -> f(u))[0] names a value that is used more than once
    step = f"""transform(array({pure}), u -> if(size(u) = 0, named_struct('cells', s.cells, 'net', s.net, 'all', s.all, 'done', true),
        named_struct('cells', transform(s.cells, x -> {left}), 'net', s.net + aggregate(u, 0, (a, q) -> a + q.n), 'all', s.all + size(u), 'done', false)))[0]"""
    return f"""aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'net', 0, 'all', 0, 'done', false),
        (s, r) -> if(s.done, s, {step}),
        s -> named_struct('whole', not exists(s.cells, x -> x.n <> 0 or x.k <> 0 or x.c <> 0), 'plus', (s.all + s.net) div 2, 'minus', (s.all - s.net) div 2))"""


def alone(side: str, a: str, b: str) -> str:
    """plus and minus, how many digests a and b have alone, from the peeled difference `side` of their sketches: where it got stuck, by larger sketches of parts."""
    dealt = f"filter({{0}}, f -> shiftright({own_bits('f', '(l - 1)')}, 9) & {FANOUT - 1} = g)"
    part = f"transform(array(named_struct('a', {dealt.format('w.a')}, 'b', {dealt.format('w.b')})), h -> named_struct('a', h.a, 'b', h.b, 'd', {peeled(minus(sketch('h.a', 'l'), sketch('h.b', 'l')), 'l')}))[0]"
    parts = f"flatten(transform(t.left, w -> transform(sequence(0, {FANOUT - 1}), g -> {part})))"
    step = f"""transform(array({parts}), o -> named_struct('left', transform(filter(o, i -> not i.d.whole), i -> named_struct('a', i.a, 'b', i.b)),
        'plus', t.plus + aggregate(o, 0L, (e, i) -> e + if(i.d.whole, i.d.plus, 0L)), 'minus', t.minus + aggregate(o, 0L, (e, i) -> e + if(i.d.whole, i.d.minus, 0L))))[0]"""
    return f"""if({side}.whole, named_struct('plus', {side}.plus, 'minus', {side}.minus), aggregate(sequence(1, {LEVELS}), named_struct('left', array(named_struct('a', {a}, 'b', {b})), 'plus', 0L, 'minus', 0L),
        (t, l) -> if(size(t.left) = 0, t, {step}),
        t -> named_struct('plus', t.plus + aggregate(t.left, 0L, (e, i) -> e + size(array_except(i.a, i.b))), 'minus', t.minus + aggregate(t.left, 0L, (e, i) -> e + size(array_except(i.b, i.a))))))"""


def written(cells: str) -> Column:
    """A sketch as text: count, digest and check of each cell in hexadecimal."""
    return F.expr(f"concat_ws('', transform({cells}, x -> concat(lpad(hex(x.n), 8, '0'), lpad(hex(x.k), 16, '0'), lpad(hex(x.c), 16, '0'))))")


def _edges(keyed: DataFrame, n: int) -> tuple[str, str, int]:
    """From known, doc_id, mark: the buckets' first documents, descending, and those that repeat so often that they would fill buckets, as JSON; and how many buckets.

    The sample has about SAMPLED documents for each bucket, so both are bounded. Results don't depend on it.
    """
    cores = keyed.sparkSession.sparkContext.defaultParallelism
    buckets = max(1, min(max(n // BUCKET, min(n // LEAST_BUCKET, 4 * cores)), MOST_BUCKETS))
    chance = min(1.0, SAMPLED * buckets / max(n, 1))
    width = max(1, int(n * chance / buckets))
    key = F.struct("known", "doc_id", "mark").alias("k")
    sample = keyed.where(F.rand(17) < chance) if buckets > 1 else keyed.where("false")
    times = sample.select(key).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    slots = times.withColumn("slot", F.floor((upto - F.col("n")) / width)).groupBy("slot").agg(F.max("k").alias("k"), F.max_by("k", "n").alias("hot"), F.max("n").alias("n"))
    told = slots.select("k", F.when(F.col("n") >= 2 * width, F.col("hot")).alias("hot")).unionByName(keyed.agg(F.max(key).alias("k")).select("k", F.lit(None).cast(times.schema["k"].dataType).alias("hot")))
    row = told.agg(F.to_json(F.sort_array(F.collect_set("k"), False)).alias("edges"), F.to_json(F.collect_set("hot")).alias("hot"), F.size(F.collect_set("k")).alias("n")).first()
    return row["edges"], row["hot"], row["n"]


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text -> also keys (digests), next_text and next_keys, of the next document by descending doc_id (after the last: the first), and times, how many such rows there are."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"), F.col("doc_id").isNotNull().alias("known"))
    edges, hot, buckets = _edges(keyed, docs.count())
    key = F.struct("known", "doc_id", "mark")
    of = f"array<struct<known:boolean,doc_id:{docs.schema['doc_id'].dataType.simpleString()},mark:bigint>>"
    edge, often = F.from_json(F.lit(edges), of), F.from_json(F.lit(hot), of)
    middle = lambda s: F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
    halves = lambda s, _: F.when(key <= F.get(edge, middle(s)), F.struct(middle(s).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), F.greatest(s["low"], middle(s) - 1).alias("high")))
    steps = F.sequence(F.lit(1), F.lit(max(1, buckets.bit_length())))
    bucket = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(buckets - 1).alias("high")), halves, lambda s: s["low"])
    own = keyed.withColumn("times", F.lit(1).cast("long"))
    if hot != "[]":
        is_hot = F.array_contains(often, key)
        once = own.where(is_hot).groupBy("known", "doc_id", "mark").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
        own = own.where(~F.coalesce(is_hot, F.lit(False))).unionByName(once)
    own = own.withColumn("bucket", bucket)
    before = F.pmod(F.col("bucket") - 1, F.lit(max(buckets, 1)))
    place = F.when(F.get(edge, F.col("bucket")) == key, F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ghost")), F.struct(before.alias("bucket"), F.lit(1).alias("ghost"))))
    place = place.otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ghost"))))
    dealt = own.select("doc_id", "text", "mark", "times", F.explode(place).alias("place")).select("doc_id", "text", "mark", "times", "place.*")
    turn = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("mark").desc())
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(buckets, 4 * docs.sparkSession.sparkContext.defaultParallelism))
    every = dealt.repartition(tasks, F.col("bucket")).withColumn("keys", digests(F.col("text")))
    every = every.withColumns({"next_text": F.lead("text").over(turn), "next_keys": F.lead("keys").over(turn)}).where("ghost = 0")
    if hot == "[]":
        return every.select("doc_id", "text", "keys", "next_text", "next_keys", "times")
    # the last of equal rows has the next document; the others have an equal one
    last = F.struct(F.col("next_text").alias("next_text"), F.col("next_keys").alias("next_keys"), F.lit(1).cast("long").alias("times"))
    others = F.struct(F.col("text").alias("next_text"), F.col("keys").alias("next_keys"), (F.col("times") - 1).alias("times"))
    return every.select("doc_id", "text", "keys", F.explode(F.when(F.col("times") > 1, F.array(last, others)).otherwise(F.array(last))).alias("x")).select("doc_id", "text", "keys", "x.*")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by as many characters from the start of the next document.
    """
    own = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    told = with_next(own).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    told = told.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))
    told = told.select("doc_id", "times", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "keys", digests(F.col("edited")).alias("edited_keys"), "next_keys")
    told = stored(told, "digests")
    for side in ("keys", "edited_keys", "next_keys"):
        told = told.withColumn(f"of_{side}", F.expr(sketch(side)))
    told = told.withColumns({"to_edited": F.expr(peeled(minus("of_keys", "of_edited_keys"))), "to_next": F.expr(peeled(minus("of_keys", "of_next_keys")))})
    told = told.withColumns({"to_edited": F.expr(alone("to_edited", "keys", "edited_keys")), "to_next": F.expr(alone("to_next", "keys", "next_keys"))})

    def likeness(side: str) -> Column:
        every = F.size("keys") + F.col(f"{side}.minus")
        return F.when(every == 0, F.lit(1.0)).otherwise((F.size("keys") - F.col(f"{side}.plus")) / every)

    out = told.select("doc_id", "n_chars", "edited_sha256", written("of_keys").alias("fingerprint"), written("of_edited_keys").alias("edited_fingerprint"), likeness("to_edited").alias("near_edited"), likeness("to_next").alias("near_next"), "times")
    return out.select(*out.columns[:-1], F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_")).drop("_")
