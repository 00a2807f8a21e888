"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is some MB of whole documents of one partition. Its words become numbers of the benchmark's vocabulary, 0 for all
other words: a phrase cannot cross a 0, so only runs of vocabulary words as long as the shortest phrase
are indexed, which loses no occurrence. FMIndex sorts their suffixes, keeps the last column in a wavelet matrix
with rank blocks of 64 bits, and samples suffix positions. Phrases are searched backwards, all at once, and
occurrences are located by walking to the next sample. Their spans are merged document by document.

A phrase is a window of `window` consecutive words of an item; an item of fewer words, but not none, is one phrase.
Items without an id or without words are no items; repeated items and ids count once. Null and empty texts have no
words. Every row gives one row, repeated rows too. The benchmark is searched in slices of bounded size, one after the other: a slice is collected, sent,
searched for in all documents, and released before the next. Items of more than PART_WORDS words go in parts that overlap by window - 1 words, so a long item
is in several slices and no window is lost. Spans found by several slices are merged by row afterwards; each slice reads all documents once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import freed, held, name, pieces, stored, texts, words

#: Bytes of benchmark words in one slice, and words of an item in one part.
SLICE_BYTES, PART_WORDS = 2_000_000, 10_000
#: Bytes of text in a shard, about.
SHARD_BYTES = 8 << 20
#: Every so many positions of the text a suffix position is kept.
SAMPLE = 8
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Bits:
    """Bits with rank in constant time: a count before each 64."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits) // 64 + 1
        self.cells = np.packbits(np.pad(bits.astype(np.uint8), (0, 64 * n - len(bits))), bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.cells), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        k = i >> 6
        return self.before[k] + np.bitwise_count(self.cells[k] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.cells[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0


class WaveletMatrix:
    """Rank of any symbol, and the symbol at a place, over a sequence of small numbers."""

    def __init__(self, values: np.ndarray, top: int) -> None:
        self.levels = []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bits = (values >> shift) & 1
            self.levels.append((shift, Bits(bits), int(len(bits) - bits.sum())))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before i."""
        first = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = (symbols >> shift) & 1 > 0
            a, b = bits.rank(first), bits.rank(i)
            first, i = np.where(one, zeros + a, first - a), np.where(one, zeros + b, i - b)
        return i - first

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it stands before i."""
        symbols, first = np.zeros_like(i), np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = bits.get(i)
            a, b = bits.rank(first), bits.rank(i)
            first, i = np.where(one, zeros + a, first - a), np.where(one, zeros + b, i - b)
            symbols |= one.astype(np.int64) << shift
        return symbols, i - first


def suffix_array(values: np.ndarray) -> np.ndarray:
    """By prefix doubling. Zeros end runs: each is a different smallest symbol, so no comparison passes it."""
    n, zero = len(values), values == 0
    ends = np.cumsum(zero)
    rank = np.where(zero, ends, values.astype(np.int64) + ends[-1])
    _, rank = np.unique(rank, return_inverse=True)
    order, k = np.argsort(rank, kind="stable"), 1
    while rank.max() < n - 1:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
    return order


class FMIndex:
    """values: numbers from 0 on, the last one 0. Phrases don't hold 0."""

    def __init__(self, values: np.ndarray) -> None:
        values = np.asarray(values, np.int64)
        self.n, top = len(values), int(values.max())
        order = suffix_array(values)
        self.last = WaveletMatrix(values[order - 1], top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=top + 1))])
        before = np.roll(values, 1)
        kept = (order % SAMPLE == 0) | (before[order] == 0)  # the start of a run too: a walk never crosses a 0
        self.kept, self.samples = Bits(kept), order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) whose suffixes start with each phrase; phrases: one a row, all of one length."""
        n = len(phrases)
        low, high, live = np.zeros(n, np.int64), np.full(n, self.n, np.int64), np.arange(n)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbols = phrases[live, k]
            known = symbols < len(self.first) - 1
            high[live[~known]] = low[live[~known]]
            live, symbols = live[known], symbols[known]
            low[live], high[live] = (self.first[symbols] + self.last.rank(symbols, x[live]) for x in (low, high))
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows."""
        out, steps, live, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), np.asarray(rows, np.int64)
        while len(live):
            kept = self.kept.get(at)
            out[live[kept]] = self.samples[self.kept.rank(at[kept])] + steps
            live, at = live[~kept], at[~kept]
            symbols, before = self.last.access(at)
            at, steps = self.first[symbols] + before, steps + 1
        return out


@dataclass
class Phrases:
    """The distinct windows of a slice of the benchmark: by length, and the items that have each."""

    vocabulary: dict[bytes, int]
    by_length: list[tuple[int, np.ndarray, np.ndarray]]  # length, windows, their numbers
    item_from: np.ndarray  # items of window k: items[item_from[k] : item_from[k + 1]]
    items: np.ndarray
    ids: list[str]

    @classmethod
    def of(cls, rows: list[tuple[str, bytes]], window: int) -> Phrases:
        """rows: item id, its words or some of them, with spaces between."""
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        ids = sorted({i for i, _ in rows})
        number = {i: k for k, i in enumerate(ids)}
        for i, text in rows:
            own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in text.split()]
            for k in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[k : k + window]), set()).add(number[i])
        keys = sorted(found, key=len)
        by_length = []
        for size in sorted({len(k) for k in keys}):
            which = np.array([n for n, k in enumerate(keys) if len(k) == size])
            by_length.append((size, np.array([keys[n] for n in which], np.int64), which))
        return cls(vocabulary, by_length, np.cumsum([0, *(len(found[k]) for k in keys)]), np.array([x for k in keys for x in sorted(found[k])], np.int64), ids)


def find(phrases: Phrases, texts: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """For each text, given as its words: merged spans of words inside occurrences [start, end), and the ids of their items."""
    spans: list[list] = [[] for _ in texts]
    ids: list[list] = [[] for _ in texts]
    if not phrases.by_length:
        return spans, ids
    get, least = phrases.vocabulary.get, phrases.by_length[0][0]
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])  # a 0 after each text
    values = np.zeros(begins[-1], np.int32)
    for t, b in zip(texts, begins):
        values[b : b + len(t)] = [get(w, 0) for w in t]
    edges = np.diff(np.concatenate([[0], (values > 0).view(np.int8), [0]]))
    starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return spans, ids
    lengths = ends - starts + 1  # with the 0 that follows
    firsts = np.cumsum(lengths) - lengths
    index = FMIndex(values[np.arange(lengths.sum()) + np.repeat(starts - firsts, lengths)])
    at, size, which = [], [], []
    for length, windows, numbers in phrases.by_length:
        low, high = index.search(windows)
        n = high - low
        rows = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        at.append(index.locate(rows))
        size.append(np.full(len(rows), length))
        which.append(np.repeat(numbers, n))
    at, size, which = np.concatenate(at), np.concatenate(size), np.concatenate(which)
    if not len(at):
        return spans, ids
    run = np.searchsorted(firsts, at, "right") - 1
    at = at - firsts[run] + starts[run]  # in values
    cover = np.zeros(len(values) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    edges = np.diff(np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).view(np.int8), [0]]))
    for s, e in zip(np.nonzero(edges == 1)[0].tolist(), np.nonzero(edges == -1)[0].tolist()):
        k = int(np.searchsorted(begins, s, "right")) - 1
        spans[k].append((s - int(begins[k]), e - int(begins[k])))
    pairs = np.unique(np.stack([np.searchsorted(begins, at, "right") - 1, which]), axis=1)
    for k, w in pairs.T.tolist():
        ids[k].extend(phrases.items[phrases.item_from[w] : phrases.item_from[w + 1]].tolist())
    return spans, [[phrases.ids[x] for x in sorted(set(i))] for i in ids]


def cut(data: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without those words; what stands between two words of a span goes too."""
    if not spans:
        return data.decode("utf-8", "replace")
    at, out, begin = list(WORD.finditer(data)), [], 0
    for s, e in spans:
        out.append(data[begin : at[s].start()])
        begin = at[e - 1].end()
    return b"".join([*out, data[begin:]]).decode("utf-8", "replace")


SPANS = "array<struct<start:long,end:long>>"


def _phrases(token: str, rows: list[tuple[str, bytes]], window: int) -> Phrases:
    """One for each worker and slice, kept from task to task."""
    return held(("phrases", token), lambda: Phrases.of(rows, window))


def _search(docs: DataFrame, rows: Broadcast, window: int, with_text: bool) -> DataFrame:
    own, token = docs, uuid.uuid4().hex
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_words long, spans {SPANS}, item_ids array<string>" + ", text string" * with_text
    arrow = to_arrow_schema(own.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _phrases(token, rows.value, window)
        for batch in (piece for whole in batches for piece in pieces(whole, 1, SHARD_BYTES)):
            data = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            split = [words(x) for x in data]
            spans, ids = find(phrases, split)
            columns = [batch.column(0), [len(x) for x in split], [[{"start": s, "end": e} for s, e in x] for x in spans], ids]
            if with_text:
                columns.append([cut(x, s) for x, s in zip(data, spans)])
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return own.mapInArrow(run, schema)


def item_parts(benchmark: DataFrame, window: int, item_col: str, item_text_col: str) -> DataFrame:
    """item, part, words (with spaces between), bytes: whole items, and long ones in overlapping parts."""
    own = benchmark.select(name(item_col).cast("string").alias("item"), name(item_text_col).cast("string").alias("text")).where("item is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                w = words(text)
                parts = [b" ".join(w[k : k + PART_WORDS + window - 1]) for k in range(0, max(len(w) - window + 1, min(len(w), 1)), PART_WORDS)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()), pa.array(map(len, parts), pa.int64())], ["item", "part", "words", "bytes"])

    return own.mapInArrow(run, "item string, part int, words binary, bytes long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, spans (words inside occurrences, merged), item_ids (sorted), n_hit, and the cut text if asked for."""
    spark = docs.sparkSession
    own, sent = texts(docs, id_col, text_col), spark.sparkContext.broadcast
    hits = F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)").alias("n_hit")
    with freed(spark, kept=("decontaminated",)):
        parts = stored(item_parts(benchmark, window, item_col, item_text_col), "benchmark")
        slices = int((parts.agg(F.sum("bytes")).first()[0] or 0) // slice_bytes) + 1
        if slices == 1:
            out = _search(own, sent([(r["item"], bytes(r["words"])) for r in parts.collect()]), window, with_text)  # no more than a slice
            return out.select("*", hits)
        rows = stored(own.withColumn("row", F.monotonically_increasing_id()), "decontaminate").select(F.struct("row", "doc_id").alias("doc_id"), "text")
        whole, found = None, []
        for k in range(slices):
            some = sent([(r["item"], bytes(r["words"])) for r in parts.where(F.pmod(F.xxhash64("item", "part"), F.lit(slices)) == k).collect()])
            one = _search(rows, some, window, False)
            if whole is None:  # the first slice counts the words of every row; the others keep rows that they found something in
                whole = stored(one, "slice")
            else:
                found.append(stored(one.where(F.size("spans") > 0), "slice"))
            some.destroy()
        every = whole
        for one in found:
            every = every.unionByName(one)
        every = every.groupBy("doc_id").agg(F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
        merged = F.expr(f"""aggregate(spans, cast(array() as {SPANS}), (a, x) -> case
            when size(a) = 0 or element_at(a, -1).end < x.start then concat(a, array(x))
            else concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))) end)""")
        every = every.select("doc_id", "n_words", merged.alias("spans"), "item_ids")
        out = _cut(every.join(rows, "doc_id")) if with_text else every.select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", "spans", "item_ids")
        return stored(out, "decontaminated").select("*", hits)


def _cut(joined: DataFrame) -> DataFrame:
    own = joined.select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", "spans", "item_ids", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, spans = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()
            done = [cut(x or b"", [(s["start"], s["end"]) for s in y]) for x, y in zip(data, spans)]
            yield batch.set_column(4, "text", pa.array(done, batch.schema.field("text").type))

    return own.mapInArrow(run, own.schema)
