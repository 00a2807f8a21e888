"""License scan: an exact set-similarity join of text blocks with license templates.

A template is a set of words with a threshold: a block matches where it holds at least ceil(threshold x size) of
them. Words are ordered by how many documents hold them, rarest first, counted over all documents. Of a
template's n words, c must be met, so a match holds one of its first n - c + 1 (prefix filter). A block with
fewer than c template words is out (length filter), and when the k-th word of the template is the first one met, n - k must
reach c (positional filter). What passes is counted exactly.

Blocks are windows of `block_words` words that start every half window, so any stretch of half a window's words lies in
one whole. Blocks are only cut from documents that hold a prefix word, which loses none.

The phrases are templates with threshold 1; an exact check of consecutive words follows in the matching blocks.

Null and empty texts have no words and no labels. Every row gives one row, repeated rows too. Templates are
joined in slices of bounded size, so what is sent to the tasks doesn't grow with them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import stored, texts, words

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Openings of well-known license notices, by label.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by": "This work is licensed under a Creative Commons Attribution International License",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form or by any means without the prior written permission of the publisher",
}
THRESHOLD = 0.8
BLOCK_WORDS = 256
#: Templates and phrases in one slice.
SLICE = 2_000


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    threshold: float
    phrase: bool  # its words must stand consecutively

    @property
    def least(self) -> int:
        return max(1, math.ceil(self.threshold * len(set(self.words)) - 1e-9))


def templates_of(phrases: dict[str, str], templates: dict[str, str], threshold: float) -> list[Template]:
    made = [Template(label, tuple(words(p.encode())), 1.0, True) for p, label in phrases.items()] + [Template(label, tuple(words(t.encode())), threshold, False) for label, t in templates.items()]
    return [t for t in made if t.words]


class Join:
    """Templates ordered by the words' frequencies, with an index of their prefixes."""

    def __init__(self, templates: list[Template], found_in: dict[bytes, int]) -> None:
        self.templates = templates
        self.vocabulary = frozenset(w for t in templates for w in t.words)
        self.rank = {w: k for k, w in enumerate(sorted(self.vocabulary, key=lambda w: (found_in.get(w, 0), w)))}
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}
        self.sets = [frozenset(t.words) for t in templates]
        for n, t in enumerate(templates):
            ordered = sorted(self.sets[n], key=self.rank.__getitem__)
            for k, w in enumerate(ordered[: len(ordered) - t.least + 1]):
                self.prefixes.setdefault(w, []).append((n, k))
        self.heads = frozenset(self.prefixes)

    def matches(self, block: frozenset[bytes] | set[bytes]) -> Iterator[tuple[int, float]]:
        """Templates that the block's words meet, with the share they hold."""
        own = sorted(block & self.vocabulary, key=self.rank.__getitem__)
        done = set()
        for j, w in enumerate(own):
            for n, k in self.prefixes.get(w, ()):
                if n not in done:
                    done.add(n)
                    least, size = self.templates[n].least, len(self.sets[n])
                    if len(own) >= least and 1 + min(size - k - 1, len(own) - j - 1) >= least:
                        held = len(self.sets[n] & block)
                        if held >= least:
                            yield n, held / size


def places(text: list[bytes], begin: int, end: int, phrase: tuple[bytes, ...]) -> list[int]:
    """Where the phrase's words stand consecutively within text[begin:end]."""
    size, out, at = len(phrase), [], begin
    while True:
        try:
            at = text.index(phrase[0], at, end - size + 1) if end - size + 1 > at else -1
        except ValueError:
            at = -1
        if at < 0:
            return out
        if tuple(text[at : at + size]) == phrase:
            out.append(at)
        at += 1


def scan(join: Join, text: list[bytes], block_words: int) -> tuple[list[tuple[str, int]], dict[str, float], int]:
    """Of one text: the phrases' labels and starts, the best share for each label, and how many blocks matched."""
    if join.heads.isdisjoint(text):
        return [], {}, 0
    found, best, blocks, step = set(), {}, 0, max(1, block_words // 2)
    for begin in range(0, max(1, len(text) - block_words + step), step):
        block = text[begin : begin + block_words]
        hit = False
        for n, share in join.matches(set(block)):
            t = join.templates[n]
            if t.phrase:
                at = places(text, begin, min(len(text), begin + block_words), t.words)
                if not at:
                    continue
                found.update((t.label, x) for x in at)
            hit = True
            best[t.label] = max(share, best.get(t.label, 0.0))
        blocks += hit
    return sorted(found), best, blocks


FOUND = "array<struct<label:string,start:long>>"


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, found (labels and starting words of the phrases), shares (of each label's best block), n_blocks (that match)."""
    made = templates_of(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates, threshold)
    longest = max((len(t.words) for t in made), default=1)
    if longest > block_words // 2:
        raise ValueError(f"a template has {longest} words; blocks of {block_words} hold {block_words // 2} for certain")
    own = texts(docs, id_col, text_col)
    slices = [made[k : k + SLICE] for k in range(0, len(made), SLICE)] or [[]]
    if len(slices) == 1:
        return _scan(own, slices[0], block_words)
    rows = stored(own.withColumn("row", F.monotonically_increasing_id()), "licenses")
    every = None
    for one in slices:
        part = _scan(rows.select(F.struct("row", "doc_id").alias("doc_id"), "text"), one, block_words)
        every = part if every is None else every.unionByName(part)
    got = every.groupBy("doc_id").agg(F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"), F.flatten(F.collect_list("shares")).alias("shares"), F.max("n_blocks").alias("n_blocks"))
    best = F.expr("transform(array_sort(array_distinct(transform(shares, x -> x.label))), l -> named_struct('label', l, 'share', array_max(transform(filter(shares, x -> x.label = l), x -> x.share))))")
    return got.select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", "found", best.alias("shares"), "n_blocks")


def _scan(own: DataFrame, templates: list[Template], block_words: int) -> DataFrame:
    spark = own.sparkSession
    vocabulary = frozenset(w for t in templates for w in t.words)
    sent = spark.sparkContext.broadcast((templates, vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(sent.value[1].intersection(words(x or b"")))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counted = own.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row for each word of the templates at most
    found_in = {bytes(r.word): r.n for r in counted}
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_words long, found {FOUND}, shares array<struct<label:string,share:double>>, n_blocks long"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = Join(sent.value[0], found_in)
        for batch in batches:
            n, found, shares, blocks = [], [], [], []
            for x in batch.column(1).cast(pa.binary()).to_pylist():
                text = words(x or b"")
                f, s, b = scan(join, text, block_words)
                n.append(len(text)), blocks.append(b)
                found.append([{"label": label, "start": at} for label, at in f])
                shares.append([{"label": k, "share": v} for k, v in sorted(s.items())])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip((n, found, shares, blocks), list(arrow)[1:]))], schema=arrow)

    return own.mapInArrow(run, schema)
