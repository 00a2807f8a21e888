"""Token ids in files of canonical length-limited Huffman codes, and back.

1. Tokenize: documents, range-partitioned and sorted by id, become segments of plain ids in the shared folder.
2. Code: ids are counted over all segments; package-merge gives the best code lengths of at most 16 bits (more only where over 32,768 ids occur), and
   lengths alone define the canonical code.
3. Write: a segment holds its documents' ids and lengths, the code bits of all their tokens, and the bit offset of
   each block of 512 tokens. The plain segments go.
4. Read: blocks decode by table without each other; numpy steps through all blocks of a segment at once.

The format: a folder of Parquet files. segments/: part, seq (ascending document order), ids_before (in the part),
doc_ids, doc_tokens, block_bits (checkpoints), payload (big-endian code bits, 8 bytes of zeros after them).
codebook/: id, bits (code length). Spark's writers commit them, so a lost executor leaves no half a file.

Null and empty texts hold the end id alone. doc_id may have any type that has an order. Repeated doc_ids follow each other, by a hash of the text, and may be in several
parts; a null doc_id comes first.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from .common import drop_scratch, held, pieces, scratch, texts
from .token_counts import byte_letters

MOST_BITS, LONGEST = 16, 25  # a decoder's window has 25 bits for certain
BLOCK = 512
#: Bytes of text in a segment, about (a document is never parted).
SEGMENT_BYTES = 1 << 20
#: Chunks that a worker remembers before it starts afresh.
REMEMBERED = 1_000_000
#: Chunks of these need no normalizer: lower-case letters of U+0000..00FF, digits and signs, but for those that open an added token.
LATIN = re.compile(r"[!-;=?-@\[-~ß-öø-ÿ]+")
#: The pattern of the vocabularies that this shortcut serves, over such chunks; fixed, as their files have it.
SPLIT = repr(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
CONTROL = ("\x1c", "\x1d", "\x1e", "\x1f")


class Chunks(dict):
    """Row of each white-space chunk in a growing table of ids.

    The vocabularies here drop white space and look at nothing beyond it, so a text's ids are its chunks' ids.
    """

    def __init__(self, tokenizer_json: str, end_id: int | None = None) -> None:
        super().__init__()
        self.end_id = end_id
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.added = [a["content"] for a in json.loads(tokenizer_json)["added_tokens"]]
        self.latin = SPLIT in str(json.loads(tokenizer_json)["pre_tokenizer"]) and "Lowercase" in str(json.loads(tokenizer_json)["normalizer"])
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.letters = {c: "".join(self.letters[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}
        self.small = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.start()

    def start(self) -> None:
        self.clear()
        self.ids, self.ends = array("i"), array("q", [0])
        if self.end_id is not None:  # row 0
            self.ids.append(self.end_id), self.ends.append(1)
            self[None] = 0

    def of(self, chunk: str) -> list[int]:
        t = self.tokenizer
        tokenize = t.model.tokenize
        if any(a in chunk for a in self.added):
            return t.encode(chunk, add_special_tokens=False).ids
        return [x.id for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(chunk)) for x in tokenize(p)]

    def __missing__(self, chunk: str) -> int:
        low = chunk.lower()
        if self.latin and LATIN.fullmatch(low):
            if low != chunk:  # as its lower case
                row = self[chunk] = self[low]
                return row
            word = low[:-1]
            if low[-1] in ".,!?;:" and word.isalpha():  # a word and a sign
                base = self[word]
                ids = self.ids[self.ends[base] : self.ends[base + 1]] + self.ids[self.ends[self[low[-1]]] : self.ends[self[low[-1]] + 1]]
            else:
                tokenize = self.tokenizer.model.tokenize
                ids = [x.id for p in ([low] if low.isalpha() else PIECES.findall(low)) for x in tokenize(p if p.isascii() else p.translate(self.letters))]
        else:
            ids = self.of(chunk)
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        row = self[chunk] = len(self.ends) - 2
        return row

    def chunks(self, text: str) -> list[str]:
        """Chunks; the whole text where Python and the library disagree on white space."""
        return [text] if any(c in text for c in CONTROL) else text.split()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, and how many each has."""
        rows = [np.fromiter(map(self.__getitem__, self.chunks(t)), np.int64) for t in texts]
        per_text = np.array([len(r) for r in rows], np.int64)
        rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        ids, ends = np.frombuffer(self.ids, np.int32), np.frombuffer(self.ends, np.int64)
        if self.end_id is not None:
            rows, per_text = np.insert(rows, np.cumsum(per_text), 0), per_text + 1
        sizes = ends[rows + 1] - ends[rows]
        to = np.cumsum(sizes)
        at = np.arange(to[-1] if len(to) else 0) + np.repeat(ends[rows] - (to - sizes), sizes)
        upto = np.concatenate([[0], to])[np.cumsum(per_text)]
        out = ids[at], np.diff(upto, prepend=0)
        del ids, ends  # else the arrays can't grow
        if len(self) > REMEMBERED:
            self.start()
        return out


def _chunks(tokenizer_json: str, end_id: int | None) -> Chunks:
    """One for each worker, kept from task to task."""
    return held(("chunks", hash((tokenizer_json, end_id))), lambda: Chunks(tokenizer_json, end_id))


PLAIN = "part int, seq int, ids_before long, n_ids long, doc_ids array<{}>, doc_tokens array<long>, width int, raw binary"


def tokenize(docs: DataFrame, tokenizer_json: str, end_id: int | None) -> DataFrame:
    """Segments of plain ids, in ascending doc_id within and across parts."""
    spark, schema = docs.sparkSession, PLAIN.format(docs.schema["doc_id"].dataType.simpleString())
    sent = spark.sparkContext.broadcast(tokenizer_json)
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, part = _chunks(sent.value, end_id), TaskContext.get().partitionId()
        seq = before = 0
        for batch in (piece for whole in batches for piece in pieces(whole, 1, SEGMENT_BYTES)):
            ids, sizes = chunks.encode([x or "" for x in batch.column("text").to_pylist()])
            raw = ids.astype(chunks.small)
            row = [part, seq, before, len(ids), batch.column(0).to_pylist(), sizes, raw.itemsize, raw.tobytes()]
            seq, before = seq + 1, before + len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow)], schema=arrow)

    # rows of one doc_id are parted by their texts, and equal rows by where they stand
    order = ["doc_id", "mark", "place"]
    ordered = docs.withColumns({"mark": F.xxhash64("text"), "place": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("doc_id", "text").mapInArrow(run, schema)


def _plain(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if width == 2 else np.uint32)


def count_ids(segments: DataFrame) -> dict[int, int]:
    """How often each id stands in all documents; the driver gets one row for each id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for width, raw in zip(batch.column("width").to_pylist(), batch.column("raw")):
                more = np.bincount(_plain(raw.as_py(), width), minlength=len(total))
                more[: len(total)] += total
                total = more
        ids = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids], pa.int64())], ["id", "n"])

    got = segments.select("width", "raw").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r.id: r.n for r in got}


def code_lengths(counts: dict[int, int], most: int = MOST_BITS) -> dict[int, int]:
    """Optimal prefix-code lengths of at most `most` bits, by package-merge. A single id gets one bit."""
    if len(counts) > 1 << most:
        raise ValueError(f"{len(counts)} ids don't fit codes of {most} bits")
    ids = sorted(counts, key=lambda i: (counts[i], i))
    n = len(ids)
    if n < 2:
        return dict.fromkeys(ids, 1)
    leaves, packed, kinds = np.array([counts[i] for i in ids], np.float64), np.zeros(0), []
    for _ in range(most):
        row = np.concatenate([leaves, packed])
        order = np.argsort(row, kind="stable")
        kinds.append(order < n)
        row = row[order]
        packed = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(kinds):
        k = int(is_leaf[:take].sum())
        bits[:k] += 1
        take = 2 * (take - k)
    return dict(zip(ids, bits.tolist(), strict=True))


def canonical(bits: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by id: shorter codes first, ids ascending within a length."""
    size = max(bits, default=0) + 1
    codes, lengths = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    code = before = 0
    for i in sorted(bits, key=lambda i: (bits[i], i)):
        code <<= bits[i] - before
        codes[i], lengths[i], before = code, bits[i], bits[i]
        code += 1
    return codes, lengths


def decode_table(bits: dict[int, int], most: int = MOST_BITS) -> np.ndarray:
    """For each value of the next `most` bits: id * 32 + length."""
    codes, lengths = canonical(bits)
    table = np.zeros(1 << most, np.int64)
    for i, b in bits.items():
        first = int(codes[i]) << (most - b)
        table[first : first + (1 << (most - b))] = i * 32 + b
    return table


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code bits, and the bit offset of every block."""
    size = lengths[ids]
    ends = np.cumsum(size)
    begins = ends - size
    at, left = begins >> 5, codes[ids] << (64 - size - (begins & 31)).astype(np.uint64)
    n = (int(ends[-1]) >> 5) + 2 if len(ids) else 1
    out = np.bincount(at, (left >> np.uint64(32)).astype(np.float64), n) + np.bincount(at + 1, (left & np.uint64(0xFFFFFFFF)).astype(np.float64), n)  # bits never meet: sums stay below 2^32, exact in doubles
    return out.astype(np.uint32).astype(">u4").tobytes() + bytes(8), begins[::BLOCK]


def unpack(payload: bytes, block_bits: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """The n ids of a payload; all blocks move on by one id at a time. The table's size says how many bits the longest code has."""
    most = len(table).bit_length() - 1
    at = np.asarray(block_bits, np.int64).copy()
    window = np.ndarray((len(payload) - 3,), ">u4", payload, strides=(1,))
    out = np.zeros((BLOCK, len(at)), np.int32)
    last = n - BLOCK * (len(at) - 1)
    for k in range(min(BLOCK, n)):
        if k == last:
            at = at[:-1]
            if not len(at):
                break
        got = table[(window[at >> 3].astype(np.int64) >> (32 - most - (at & 7))) & ((1 << most) - 1)]
        out[k, : len(at)] = got >> 5
        at += got & 31
    return out.T.reshape(-1)[:n]


SEGMENTS = "part int, seq int, ids_before long, n_ids long, doc_ids array<{}>, doc_tokens array<long>, block_bits array<long>, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every whole text's ids, each document followed by end_id, in ascending id_col."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    own = texts(docs, id_col, text_col)
    between, id_type = scratch(spark, "plain-ids"), own.schema["doc_id"].dataType.simpleString()
    tokenize(own, source, end_id).write.option("compression", "zstd").parquet(between)
    plain = spark.read.schema(PLAIN.format(id_type)).parquet(between)
    counts = count_ids(plain)
    bits = code_lengths(counts, min(LONGEST, max(MOST_BITS, len(counts).bit_length())))
    spark.createDataFrame(list(bits.items()), "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    sent = spark.sparkContext.broadcast(canonical(bits))
    schema = SEGMENTS.format(id_type)
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                payload, block_bits = pack(_plain(one.column("raw")[0].as_py(), one.column("width")[0].as_py()), *sent.value)
                yield pa.RecordBatch.from_arrays([*one.columns[:6], pa.array([block_bits], arrow.field("block_bits").type), pa.array([payload], pa.binary())], schema=arrow)

    plain.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(f"{path}/segments")
    drop_scratch(spark, between)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """From the files alone: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), and the ids if asked for.

    The driver gets the code book and a sum for each part.
    """
    segments = spark.read.parquet(f"{path}/segments")
    bits = {r.id: r.bits for r in spark.read.schema("id int, bits int").parquet(f"{path}/codebook").collect()}
    base, starts = 0, {}
    for r in sorted(segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        starts[r.part], base = base, base + r.n
    sent = spark.sparkContext.broadcast((decode_table(bits, max([MOST_BITS, *bits.values()])), starts))
    schema = f"doc_id {segments.schema['doc_ids'].dataType.elementType.simpleString()}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, starts = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                n, sizes = row["n_ids"].as_py(), row["doc_tokens"].values.to_numpy(zero_copy_only=False)
                ids = unpack(row["payload"].as_py(), row["block_bits"].values.to_numpy(zero_copy_only=False), n, table)
                ends = np.cumsum(sizes)
                raw, first = memoryview(ids.astype("<u4").tobytes()), starts[row["part"].as_py()] + row["ids_before"].as_py()
                crcs = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist())]
                got = [row["doc_ids"].values, pa.array(first + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    got.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32())).cast(arrow.field("ids").type))
                yield pa.RecordBatch.from_arrays(got, schema=arrow)

    return segments.select("part", "ids_before", "n_ids", "doc_ids", "doc_tokens", "block_bits", "payload").mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write to a new folder under the shared one and read that again."""
    path = scratch(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer_path, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, path)
