import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import SF
from tokenizers import Tokenizer

from lodestrata.llm import common, queries
from lodestrata.llm import token_counts as tc
from lodestrata.llm import token_files as tf

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", "B", "the", " ", " ", "  ", "\n", "\t", "\r\n", ".", ",", "!", "é", "ß", "日本", "한", "é", "İ", "Σ", "\x1c", "\x85", "\xa0", " ", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "12", "½", "Ⅷ", "😀", "‍", "\x00", "ﬁ", "̇"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(15))) for _ in range(n)]


def test_counts_equal_the_library():
    with open(BYTES, encoding="utf-8") as f:
        source = f.read()
    t = Tokenizer.from_str(source)
    whole = tc.prove_whole_tokens(t)
    assert len(whole) > 45_000 and all(len(t.encode(w, add_special_tokens=False).ids) == 1 for w in list(whole.values())[::100])
    counter = tc.TokenCounter(source, whole)
    for x in [*texts(2000), "a" * 5000, " " * 300, "ab " * 3000, "\n\n a"]:
        assert counter.count(x) == len(t.encode(x, add_special_tokens=False).ids), repr(x)


def test_chunks_equal_the_library():
    with open(WORDS, encoding="utf-8") as f:
        source = f.read()
    t, chunks = Tokenizer.from_str(source), tf.Chunks(source, 1)
    some = [*texts(2000, 2), "a" * 3000]
    ids, sizes = chunks.encode(some)
    want = [[*t.encode(x, add_special_tokens=False).ids, 1] for x in some]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_count_query_edges(docs):
    got = tc.count_tokens(docs(None, "", "hello world", (2, "hello world"), (None, "x" * 100_000)), BYTES, limit=1)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(tuple(r)[1:] for r in got.collect())[:4] == [(0, 0, False), (0, 0, False), (11, 2, True), (11, 2, True)] and got.count() == 5
    assert not tc.count_tokens(docs("a").where("false"), BYTES).count()


@pytest.mark.parametrize("seed", range(4))
def test_code_lengths_are_optimal_and_limited(seed):
    rng = random.Random(seed)
    counts = {i: int(2 ** rng.uniform(0, 30)) for i in rng.sample(range(1000), 60)}
    for most in (6, 7, 16):
        bits = tf.code_lengths(counts, most)
        assert max(bits.values()) <= most and sum(2.0**-b for b in bits.values()) == 1
    import heapq

    heap = [(n, 0) for n in counts.values()]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        n = heapq.heappop(heap)[0] + heapq.heappop(heap)[0]
        total += n
        heapq.heappush(heap, (n, 0))
    free = tf.code_lengths(counts, 40)
    assert sum(counts[i] * b for i, b in free.items()) == total
    with pytest.raises(ValueError):
        tf.code_lengths(dict.fromkeys(range(65), 1), 6)


def test_pack_and_unpack():
    rng = np.random.default_rng(0)
    for n in (1, 2, 511, 512, 513, 5000):
        ids = (rng.zipf(1.3, n) % 40_000).astype(np.uint16)
        bits = tf.code_lengths(dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True)))))
        payload, blocks = tf.pack(ids, *tf.canonical(bits))
        assert (tf.unpack(payload, blocks, n, tf.decode_table(bits)) == ids).all() and len(blocks) == -(-n // tf.BLOCK)


def test_longer_codes():
    """More ids than codes of 16 bits could have, and codes as long as a decoder's window takes."""
    ids = np.concatenate([np.arange(70_000), np.zeros(5000, np.int64)])
    bits = tf.code_lengths(dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True)))), 17)
    for most in (17, 20, 25):
        payload, blocks = tf.pack(ids, *tf.canonical(bits))
        assert (tf.unpack(payload, blocks, len(ids), tf.decode_table(bits, most)) == ids).all()
    skewed = tf.code_lengths({k: 2**k for k in range(40)}, tf.LONGEST)
    ids = np.arange(40).repeat(30)
    assert max(skewed.values()) == tf.LONGEST and (tf.unpack(*tf.pack(ids, *tf.canonical(skewed)), len(ids), tf.decode_table(skewed, tf.LONGEST)) == ids).all()


def test_files_round_trip(spark):
    got = sorted(queries.op10_token_files(spark, "/root/testdata/sf0.001").collect())
    t, start = Tokenizer.from_file(WORDS), 0
    for r, x in zip(sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()), got, strict=True):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert tuple(x) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_edges(spark, docs):
    path = common.scratch(spark, "test-files")
    tf.write_tokens(docs((5, "b a"), (3, None), (5, "b a"), (4, ""), (None, "a")), path, WORDS)
    got = tf.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    a, b = (Tokenizer.from_file(WORDS).encode(x).ids for x in "ab")
    assert [(r.doc_id, r.start, r.ids) for r in got] == [(None, 0, [*a, 1]), (3, 2, [1]), (4, 3, [1]), (5, 4, [*b, *a, 1]), (5, 7, [*b, *a, 1])]
    assert not tf.token_files(docs("a").where("false"), WORDS).count()
    named = spark.createDataFrame([("b", "x"), (None, "y"), ("a", None), *[("c", "same")] * 50], "doc_id string, text string")
    told = tf.token_files(named, WORDS).orderBy("start").collect()
    assert [r.doc_id for r in told] == [None, "a", "b", *["c"] * 50] and len({r.ids_crc32 for r in told[3:]}) == 1 and [r.start for r in told[3:]] == [5 + 2 * k for k in range(50)]
    common.drop_scratch(spark, path)


def test_token_count_query(spark):
    t = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r.n_tokens for r in queries.op2_token_counts(spark, SF).collect()}
    every = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert all(got[r.doc_id] == len(t.encode(r.text or "").ids) for r in every) and len(got) == len(every)
