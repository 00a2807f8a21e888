"""Language identification with a linear-chain conditional random field over words.

A word's features are its affixes (first and last one to three characters), its character n-grams (two and three, with
ends), its shape and its place in a lexicon (the commonest words of each language in the training sample), hashed
into one table of weights. Transitions between neighbouring words are learned with them. Training chains
are pieces of labelled documents, some spliced from two languages, so the model has seen code switching;
gradients are exact, from forward-backward. A text is labelled word by word by forward-backward over pieces of
`CHAIN` words, each run with the `CONTEXT` words before and after it, so that what neighbours say crosses the cuts; the language is the one with the largest sum of
word probabilities, the score its mean.

The training sample is bounded: about `sample_docs` labelled documents of each language, chosen by hash of
doc_id over all documents, of which at most `sample_words` words each, spread over the whole text, are used. All languages
are learned, however many and rare: chains grow with their number, and so do the model and the time of training.

Null texts and texts without a letter get `und` and score 0. Documents without a language are not learned from; with
none to learn from every text is `und`. Rows are labelled one by one, so repeated rows get the same.
Words have letters; digits and signs between them play no part. A run of more than `PIECE` letters, as scripts without spaces
have them, is cut into words of as many, which overlap by two letters so that no n-gram is lost.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, map_texts, name, ship

UNKNOWN = "und"
CHAIN, CONTEXT = 128, 16
#: Rows of the table of weights, a power of two; the last row is for padding and stays 0.
TABLE = 1 << 17
FEATURES = 32
#: Letters of the longest word all of whose n-grams are features.
PIECE = 10
#: Words whose features a worker remembers; fewer with very many labels.
REMEMBERED = 400_000
#: Numbers in an array over words and labels: with more, fewer words are taken at a time.
CELLS = 1 << 25
#: Training chains for each label, at least.
LEAST_CHAINS = 140
LETTER = regex.compile(r"\p{L}")
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Bytes of letters in ASCII texts and beyond; all others become spaces.
LETTERS = bytes(b if 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
#: Texts made of these hold no letter beyond U+00FF, and none of its signs: lower-casing bytes and splitting finds their words.
SIMPLE = regex.compile(r"[\x00-\x7FÀ-ÖØ-öø-ÿ]*")


def words_of(text: str) -> list[str]:
    if SIMPLE.fullmatch(text):
        found = text.lower().encode().translate(LETTERS).decode().split()
    else:
        found = WORD.findall(text.lower())
    out = []
    for w in found:
        if len(w) <= PIECE:
            out.append(w)
        else:
            out += [w[k : k + PIECE] for k in range(0, len(w) - 2, PIECE - 2)]
    return out


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Rows of the table of weights."""
    w, n = f"^{word}$", len(word)
    out = [f"p{word[:k]}" for k in range(1, min(3, n) + 1)] + [f"s{word[-k:]}" for k in range(1, min(3, n) + 1)]
    out += [f"b{w[k : k + 2]}" for k in range(n + 1)] + [f"t{w[k : k + 3]}" for k in range(n)]
    out.append("a" if word.isascii() else "u")
    if word in lexicon:
        out += [f"l{lexicon[word]}", f"w{word}"]
    return [zlib.crc32(x.encode()) % (TABLE - 1) for x in out[:FEATURES]]


def padded(rows: list[list[int]]) -> np.ndarray:
    out = np.full((len(rows), FEATURES), TABLE - 1, np.int32)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # TABLE x labels
    moves: np.ndarray  # labels x labels: from, to
    starts: np.ndarray
    lexicon: dict[str, int]

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        return forward_backward(scores, self.moves, self.starts)[0]


def forward_backward(scores: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chains (words x chains x labels): each word's label probabilities, and the expected moves of all chains."""
    top = scores.max(2, keepdims=True)
    emit, step = np.exp(scores - top), np.exp(moves)
    ahead, behind = np.empty_like(emit), np.empty_like(emit)
    a = emit[0] * np.exp(starts)
    ahead[0] = a / a.sum(1, keepdims=True)
    for t in range(1, len(emit)):
        a = (ahead[t - 1] @ step) * emit[t]
        ahead[t] = a / a.sum(1, keepdims=True)
    behind[-1] = 1
    for t in range(len(emit) - 1, 0, -1):
        b = (behind[t] * emit[t]) @ step.T
        behind[t - 1] = b / b.sum(1, keepdims=True)
    both = ahead * behind
    both /= both.sum(2, keepdims=True)
    right = behind[1:] * emit[1:]
    total = np.einsum("tci,ij,tcj->tc", ahead[:-1], step, right, optimize=True)
    expected = np.einsum("tci,tcj->ij", ahead[:-1] / np.maximum(total, 1e-30)[..., None], right, optimize=True) * step
    return both, expected


def train(samples: list[tuple[str, list[str]]], seed: int = 5, chain: int = 32, chains: int = 9000, epochs: int = 3, batch: int = 128, rate: float = 0.2) -> Model | None:
    """From (language, words) of the sample. Every other chain switches language once or twice."""
    by: dict[str, list[list[str]]] = {}
    for label, own in sorted(samples):
        if own:
            by.setdefault(label, []).append(own)
    labels = sorted(by)
    if not labels:
        return None
    lexicon: dict[str, int] = {}
    for k, label in enumerate(labels):
        common = Counter(w for own in by[label] for w in own)
        for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:300]:
            lexicon.setdefault(w, k)
    rng, chains = np.random.default_rng(seed), max(chains, LEAST_CHAINS * len(labels))
    rows: dict[str, int] = {}
    table: list[list[int]] = []
    at, gold = np.zeros((chain, chains), np.int64), np.zeros((chain, chains), np.int64)
    for c in range(chains):
        t, parts = 0, 1 if c % 2 else int(rng.integers(2, 4))
        while t < chain:
            k = int(rng.integers(len(labels)))
            own = by[labels[k]][int(rng.integers(len(by[labels[k]])))]
            size = chain - t if parts == 1 else int(rng.integers(4, max(5, chain // 2)))
            begin = int(rng.integers(max(1, len(own) - size + 1)))
            for w in own[begin : begin + min(size, chain - t)]:
                if w not in rows:
                    rows[w] = len(table)
                    table.append(features(w, lexicon))
                at[t, c], gold[t, c] = rows[w], k
                t += 1
    facts, n = padded(table), len(labels)
    weights, moves, starts = np.zeros((TABLE, n), np.float32), np.zeros((n, n)), np.zeros(n)
    squares, move_squares, start_squares = np.full((TABLE, n), 1e-6, np.float32), np.full((n, n), 1e-6), np.full(n, 1e-6)
    for _ in range(epochs):
        for c in np.array_split(rng.permutation(chains), max(1, chains // batch)):
            own, truth = facts[at[:, c]], np.eye(n)[gold[:, c]]
            scores = np.concatenate([weights[part].sum(2) for part in np.array_split(own, min(chain, -(-own.size * n // CELLS)))])
            both, expected = forward_backward(scores.astype(np.float64), moves, starts)
            off = ((both - truth) / len(c)).astype(np.float32)
            used, where = np.unique(own, return_inverse=True)
            slope = np.stack([np.bincount(where.ravel(), np.repeat(off[..., k].ravel(), FEATURES), len(used)) for k in range(n)], 1).astype(np.float32)
            slope += 1e-5 * weights[used]
            slope[used == TABLE - 1] = 0
            squares[used] += slope**2
            weights[used] -= rate * slope / np.sqrt(squares[used])
            observed = np.einsum("tci,tcj->ij", truth[:-1], truth[1:])
            for value, square, g in ((moves, move_squares, (expected - observed) / len(c)), (starts, start_squares, (both[0] - truth[0]).mean(0))):
                square += g**2
                value -= rate * g / np.sqrt(square)
    return Model(labels, weights, moves.astype(np.float32), starts.astype(np.float32), lexicon)


class Labeler:
    """Applies a model to batches of texts; remembers the scores of a bounded number of words."""

    def __init__(self, model: Model) -> None:
        self.model, self.rows = model, {}
        self.scores = np.zeros((0, len(model.labels)), np.float32)

    def look_up(self, texts: list[list[str]]) -> np.ndarray:
        rows, n = self.rows, len(self.model.labels)
        if len(rows) > min(REMEMBERED, CELLS // n):
            rows.clear()
            self.scores = self.scores[:0]
        fresh = [w for w in set().union(*texts) if w not in rows] if texts else []
        if fresh:
            made, step = [self.scores], max(1, min(20_000, CELLS // (FEATURES * n)))
            for k in range(0, len(fresh), step):
                some = fresh[k : k + step]
                made.append(self.model.weights[padded([features(w, self.model.lexicon) for w in some])].sum(1))
            rows.update(zip(fresh, range(len(rows), len(rows) + len(fresh))))
            self.scores = np.concatenate(made)
        get = rows.__getitem__
        return np.concatenate([np.fromiter(map(get, t), np.int32, len(t)) for t in texts]) if texts else np.zeros(0, np.int32)

    def label(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's mean label probabilities; and the words' own, one text after the other."""
        model, sizes = self.model, np.array([len(t) for t in texts], np.int64)
        rows, n = self.look_up(texts), len(self.model.labels)
        own = np.zeros((len(rows), n), np.float32)
        per = -(-sizes // CHAIN)
        text = np.repeat(np.arange(len(texts)), per)
        first = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * CHAIN
        last = np.minimum(first + CHAIN, sizes[text])
        begin, end = np.maximum(first - CONTEXT, 0), np.minimum(last + CONTEXT, sizes[text])  # with the context
        at, order = (np.cumsum(sizes) - sizes)[text], np.argsort(end - begin, kind="stable")
        step = max(1, min(4096, CELLS // ((CHAIN + 2 * CONTEXT) * n)))
        for k in range(0, len(order), step):  # chains of about one length
            some = order[k : k + step]
            place = begin[some] + np.arange((end - begin)[some].max())[:, None]
            live = place < end[some]
            got = marginals(self.scores[rows[np.where(live, at[some] + place, 0)]], model.moves, model.starts, None if live.all() else live)
            kept = (place >= first[some]) & (place < last[some])
            own[(at[some] + place)[kept]] = got[kept]
        whose = np.repeat(np.arange(len(texts)), sizes)
        sums = np.stack([np.bincount(whose, own[:, k], len(texts)) for k in range(n)], 1)
        return sums / np.maximum(sizes, 1)[:, None], own


def marginals(scores: np.ndarray, moves: np.ndarray, starts: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
    """forward_backward() without the moves. live: which places are words (words x chains), where some chains end before others."""
    emit, step = np.exp(scores - scores.max(2, keepdims=True)), np.exp(moves)
    a = emit[0] * np.exp(starts)
    ahead = np.empty_like(emit)
    ahead[0] = a / a.sum(1, keepdims=True)
    for t in range(1, len(emit)):
        a = (ahead[t - 1] @ step) * emit[t]
        ahead[t] = a / a.sum(1, keepdims=True)
    b = np.ones_like(emit[0])
    for t in range(len(emit) - 1, 0, -1):
        b = (b * emit[t]) @ step.T
        b /= b.sum(1, keepdims=True)
        if live is not None:
            b = np.where(live[t][:, None], b, np.float32(1))
        ahead[t - 1] *= b
    return ahead / ahead.sum(2, keepdims=True)


def spread(own: list[str], most: int) -> list[str]:
    """At most `most` words in eight pieces from the whole text."""
    if len(own) <= most:
        return own
    size, out = most // 8, []
    for k in range(8):
        begin = k * (len(own) - size) // 7
        out += own[begin : begin + size]
    return out


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def grouped(texts: list[list[str]], most: int) -> Iterator[list[list[str]]]:
    """Texts in groups of about `most` words; a longer text ends its group."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def fit(docs: DataFrame, sample_docs: int = 400, sample_words: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Train on documents that aren't held out and have a language, whichever it is."""
    ship(docs.sparkSession)
    known = docs.select(name(id_col).alias("doc_id"), name(text_col).cast("string").alias("text"), name(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chance = known.groupBy("lang").agg(F.least(F.lit(1.0), sample_docs / F.count(F.lit(1))).alias("chance"))  # a row for each language
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [" ".join(spread(words_of(x), sample_words)) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang").cast(pa.string()), pa.array(own, pa.string())], ["lang", "words"])

    rows = known.join(F.broadcast(chance), "lang").where(place < F.col("chance")).select("lang", "text").mapInArrow(each, "lang string, words string").collect()
    return train([(r.lang, [*map(sys.intern, r.words.split())]) for r in rows])


def _labeler(model: Model) -> Labeler:
    """One for each worker, kept from task to task."""
    return held(("labeler", zlib.crc32(model.weights.tobytes())), lambda: Labeler(model))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), shares (each language's share of the words, for code-switched texts)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(data: list[bytes]) -> dict:
        if sent.value is None:
            return {"lang_pred": [UNKNOWN] * len(data), "score": [0.0] * len(data), "shares": [{}] * len(data)}
        labeler = _labeler(sent.value)
        labels, split = labeler.model.labels, [words_of(x.decode("utf-8", "replace")) for x in data]
        means = np.concatenate([labeler.label(some)[0] for some in grouped(split, max(1, CELLS // len(labels)))]) if split else np.zeros((0, len(labels)))
        best = means.argmax(1)
        return {
            "lang_pred": [labels[k] if t else UNKNOWN for k, t in zip(best.tolist(), split)],
            "score": np.where([bool(t) for t in split], np.clip(means.max(1), 0, 1), 0.0),
            "shares": [[(label, v) for label, v in zip(labels, m) if v >= 0.05] for m in means.tolist()],
        }

    return map_texts(docs, each, "lang_pred string, score double, shares map<string,double>", id_col, text_col)
