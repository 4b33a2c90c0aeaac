"""License scans: an exact set-similarity join of text blocks with license templates.

Tokens are ordered by their frequency in all documents. A block of words meets a template of t
distinct tokens if it holds at least ceil(threshold * t) of them; so it must hold one of the
t - ceil(threshold * t) + 1 rarest (the prefix), its text must be long enough (length), and it
can only start so far before a prefix token's place (position). What passes is counted exactly.
A block is every run of as many consecutive words as the template has. Templates are few and
fixed, so they travel with the tasks; documents are only mapped over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonagrid.llm.textarrays import ALNUM, LOWER, Block, blocks, gram_hashes, lookup, span_hashes, words

#: Fixed phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Notices of well-known licenses, by label.
TEMPLATES = {
    "mit": ("released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    "apache-2": ("licensed under the apache license version 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license",),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike 4 0 international license",),
    "gpl-3": ("this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
}
THRESHOLD = 0.8


def word_hashes(text: str) -> np.ndarray:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    at = words(Block(0, np.array([0, len(data)]), data), ALNUM)
    return span_hashes(data, at.start, at.end)


class Template:
    def __init__(self, label: str, text: str, threshold: float) -> None:
        h = word_hashes(text)
        self.label, self.size = label, len(h)
        self.tokens = np.unique(h)
        self.need = max(1, math.ceil(threshold * len(self.tokens) - 1e-9))

    def order(self, count: dict[int, int]) -> Template:
        by_rarity = sorted(self.tokens.tolist(), key=lambda x: (count.get(x, 0), x))
        self.prefix = np.array(sorted(by_rarity[: len(by_rarity) - self.need + 1]), np.uint64)
        return self

    def best(self, hashes: np.ndarray) -> tuple[int, int, int] | None:
        """First and last start of a block that meets the threshold, and the most tokens held."""
        if len(hashes) < self.need or not (where := np.flatnonzero(lookup(self.prefix, hashes) >= 0)).size:
            return None
        token = lookup(self.tokens, hashes)
        if len(np.unique(token[token >= 0])) < self.need:
            return None
        size = min(self.size, len(hashes))
        reach = np.zeros(len(hashes) + 1, np.int64)  # starts whose block holds a prefix token
        np.add.at(reach, np.maximum(where - size + 1, 0), 1)
        np.add.at(reach, where + 1, -1)
        starts = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
        starts = starts[starts + size <= len(hashes)]
        held = np.zeros(len(starts), np.int64)
        for k in range(len(self.tokens)):
            upto = np.concatenate([[0], np.cumsum(token == k)])
            held += upto[starts + size] > upto[starts]
        good = np.flatnonzero(held >= self.need)
        return (int(starts[good[0]]), int(starts[good[-1]]), int(held.max())) if len(good) else None


def templates(threshold: float = THRESHOLD, texts: dict[str, tuple[str, ...]] = TEMPLATES) -> list[Template]:
    return [Template(label, x, threshold) for label, some in texts.items() for x in some]


def token_frequencies(docs: DataFrame, own: list[Template]) -> dict[int, int]:
    """How often each template token stands in all documents: one row a token."""
    keys = np.unique(np.concatenate([t.tokens for t in own])) if own else np.zeros(0, np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                at = words(block._replace(data=LOWER[block.data]), ALNUM)
                key = lookup(keys, span_hashes(LOWER[block.data], at.start, at.end))
                total += np.bincount(key[key >= 0], minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["token", "n"])

    counted = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {int(keys[r.token]): r.n for r in counted.collect()}


_MATCH = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("containment", T.DoubleType())])


def scan(docs: DataFrame, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES, texts: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z went to lower case. n_base counts
    the places of all phrases, first_word and last_word are their smallest and largest start.
    labels are base_labels and those of templates some block meets; score is 1 with a phrase, else
    the largest containment that meets the threshold, else 0. blocks has, per template met, the
    first and last start of such blocks. A null or empty text has no words and no labels (empty
    strings); repeated rows come out as often as they are; a null doc_id stays null; an empty
    table gives an empty result; other columns are not read.
    """
    own = templates(threshold, texts)
    count = token_frequencies(docs, own)
    for t in own:
        t.order(count)
    spoken = [(gram_hashes(h := word_hashes(p), len(h))[0], len(h), label) for p, label in phrases.items()]
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("blocks", T.ArrayType(_MATCH))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = np.unique(np.concatenate([t.prefix for t in own])) if own else np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple] = []
            for block in blocks(batch.column(1)):
                at = words(block._replace(data=LOWER[block.data]), ALNUM)
                h = span_hashes(LOWER[block.data], at.start, at.end)
                texts_here = len(at.bounds) - 1
                base: list[list[tuple[int, str]]] = [[] for _ in range(texts_here)]
                for want, size, label in spoken:
                    for i in np.flatnonzero(gram_hashes(h, size) == want).tolist():
                        text = int(at.text[i])
                        if i + size <= at.bounds[text + 1]:
                            base[text].append((i - int(at.bounds[text]), label))
                likely = np.zeros(texts_here, bool)
                likely[at.text[lookup(prefixes, h) >= 0]] = True
                for k in range(texts_here):
                    a, b = int(at.bounds[k]), int(at.bounds[k + 1])
                    places = [i for i, _ in base[k]]
                    said = {label for _, label in base[k]}
                    met = [(t.label, *found[:2], found[2] / len(t.tokens)) for t in own if (found := t.best(h[a:b]))] if likely[k] else []
                    score = 1.0 if said else max((m[3] for m in met), default=0.0)
                    out.append((b - a, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(said)), ",".join(sorted(said | {m[0] for m in met})), score, [dict(zip(_MATCH.names, m, strict=True)) for m in met]))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(rows, schema)
