"""Token counts by the whole-token shortcut.

Offline, prove_whole_tokens() tests each string of the vocabulary: it must stay one pre-token and come out of
the merges as that single id. While counting, a chunk (a run without white space, with or without the space
before it) or a pre-token that is one of these strings counts as one at once; only the rest goes through the merges.

How chunks stand for the text: white space ends every pre-token of this pattern but for the one space that joins
the next chunk, so a text is a row of chunks and of white-space runs between them, and their tokens add up. Texts
with an added token's string inside are given to the library whole, as are those with U+001C..1F, which
Python and the library class differently.

Null and empty texts have 0 bytes and 0 tokens; every row gives one row, repeated rows too.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import held, map_texts

#: White space as Unicode has it; what is no single plain space parts a text.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD_SPACE = re.compile(f"([{SPACE}]{{2,}}|[{SPACE.replace(' ', '', 1)}])")
CONTROL = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Chunks remembered by a worker, besides the vocabulary's.
REMEMBERED = 600_000


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_whole_tokens(tokenizer: Tokenizer) -> dict[str, str]:
    """Strings of the vocabulary that encode alone as the one token they name: how the text reads, by how the vocabulary writes it."""
    letters, proven = byte_letters(), {}
    for written, i in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(letters[c] for c in written).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        pieces = tokenizer.pre_tokenizer.pre_tokenize_str(text)
        if len(pieces) == 1 and pieces[0][0] == written and [t.id for t in tokenizer.model.tokenize(written)] == [i]:
            proven[written] = text
    return proven


class _Costs(dict):
    """Tokens of a chunk, worked out when first asked for; remembers a bounded number."""

    def __init__(self, whole: dict[str, str], lead: str, counter: TokenCounter) -> None:
        n = len(lead)
        super().__init__((t[n:], 1) for t in whole.values() if t.startswith(lead) and not ODD_SPACE.search(t[n:]) and " " not in t[n:])
        self.lead, self.counter, self.most = lead, counter, len(self) + REMEMBERED

    def __missing__(self, chunk: str) -> int:
        n = self.counter.merged(self.lead + chunk)
        if len(self) < self.most:
            self[chunk] = n
        return n


class TokenCounter:
    """Counts as len(tokenizer.encode(text, add_special_tokens=False).ids) does."""

    def __init__(self, tokenizer_json: str, whole: dict[str, str]) -> None:
        self.tokenizer, self.whole = Tokenizer.from_str(tokenizer_json), frozenset(whole)
        self.added = [a["content"] for a in json.loads(tokenizer_json)["added_tokens"]]
        self.plain, self.spaced = _Costs(whole, "", self), _Costs(whole, " ", self)

    def merged(self, text: str) -> int:
        """One for a pre-token that is a whole token; merges for the others."""
        whole, tokenize = self.whole, self.tokenizer.model.tokenize
        return sum(1 if p in whole else len(tokenize(p)) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

    def count(self, text: str) -> int:
        if any(a in text for a in self.added) or any(c in text for c in CONTROL):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts, n, joins = ODD_SPACE.split(text), 0, False  # segments and, at odd places, the white space between
        for k, part in enumerate(parts):
            if k % 2:
                if k == len(parts) - 2 and not parts[-1]:  # at the end a run stays whole
                    return n + self.plain[part]
                joins = part[-1] == " "
                n += (self.plain[part[:-1]] if len(part) > 1 else 0) + (0 if joins else self.plain[part[-1]])
            elif part:
                chunks = part.split(" ")
                last = chunks.pop() if len(chunks) > 1 and not chunks[-1] else None  # a space that ends the text
                n += self.spaced[chunks[0]] if joins else self.plain[chunks[0]] if chunks[0] else 0
                n += sum(map(self.spaced.__getitem__, chunks[1:])) + (self.plain[" "] if last is not None else 0)
        return n


def _counter(tokenizer_json: str, whole: dict[str, str]) -> TokenCounter:
    """One for each worker, kept from task to task."""
    return held(("counter", hash(tokenizer_json)), lambda: TokenCounter(tokenizer_json, whole))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for every whole text.

    The tokenizer's file is read by the driver and sent along, with the proven strings: a few MB, as large as the vocabulary.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((source, prove_whole_tokens(Tokenizer.from_str(source))))

    def each(data: list[bytes]) -> dict:
        counter = _counter(*sent.value)
        return {"n_bytes": [len(x) for x in data], "n_tokens": [counter.count(x.decode("utf-8", "replace")) if x else 0 for x in data]}

    return map_texts(docs, each, "n_bytes long, n_tokens long", id_col, text_col).withColumn("over_limit", F.col("n_tokens") > F.lit(limit).cast(T.LongType()))
