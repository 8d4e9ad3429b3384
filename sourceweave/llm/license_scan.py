"""License scans as an exact set-similarity join of text blocks with templates.

A text is cut into overlapping blocks: block k holds the words from k * stride
for two strides, so any passage of up to a stride of words lies in some block,
across line ends as well. A block meets a template when it contains at least the
template's share (its threshold) of the template's distinct words.

One pass counts the template words over all texts, which gives the global order
(rarest first). In that order a template needs only its prefix looked up: a
block that reaches the needed overlap must hold one of the first
|T| - overlap + 1 words, and that word must stand in the block's own prefix.
Blocks with fewer distinct words than the overlap are skipped (length filter),
and so are those where the words left after the first shared one cannot reach it
(positional filter). What is left is counted exactly. Words outside all templates
cannot match and are left out of the order, which changes no overlap.

Phrases are templates with threshold 1 whose words must also stand one after
another; every such place is reported once, by the block that owns its start.

The templates are a parameter and small; the documents are scanned twice and
never shuffled. Defined results: null and empty texts have no words, no places,
empty labels and score 0. Rows are judged one by one, so copies and ties need no
rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceweave.llm.common import ALNUM, LOWER, Roller, chunks, runs, signed

STRIDE = 32
_SEED = 4


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float
    phrase: bool = False


#: fixed values: phrases whose places are counted, and openings of public license notices
PHRASES = [Template("mit", "mit license", 1.0, True), Template("apache", "apache license", 1.0, True), Template("gpl", "general public license", 1.0, True)]
NOTICES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.8),
    Template("mit", "released under the mit license", 1.0),
    Template("apache", "licensed under the apache license version 2 0", 0.9),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", 0.8),
    Template("gpl", "licensed under the gnu general public license version", 1.0),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 0.8),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.8),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.8),
    Template("cc-by-nc", "licensed under cc by nc 4 0", 1.0),
]


def split_words(text: str) -> list[bytes]:
    low = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return np.where(ALNUM[low], low, np.uint8(32)).tobytes().split()


class Index:
    """Templates over the global order: token numbers are ranks, 0 the rarest."""

    def __init__(self, templates: list[Template], counts: dict[bytes, int]):
        words = sorted({w for t in templates for w in split_words(t.text)}, key=lambda w: (counts.get(w, 0), w))
        rank = {w: i for i, w in enumerate(words)}
        roll = Roller(_SEED)
        hashes = np.array([roll.one(w) for w in words], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ranks = hashes[order], order.astype(np.int64)
        self.templates = [t for t in templates if split_words(t.text)]
        self.sets, self.needed, self.phrases = [], [], []
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for n, t in enumerate(self.templates):
            seq = [rank[w] for w in split_words(t.text)]
            own = sorted(set(seq))
            need = max(1, math.ceil(t.threshold * len(own) - 1e-9))
            self.sets.append(frozenset(own))
            self.needed.append(need)
            self.phrases.append(seq if t.phrase else None)
            for i, token in enumerate(own[: len(own) - need + 1]):
                self.prefix.setdefault(token, []).append((n, i))

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 outside the templates."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ranks[at], -1)

    def matches(self, words: np.ndarray, stride: int) -> Iterator[tuple[int, int, int]]:
        """(block, template, overlap) of every block of a text that meets a template; ``words`` are ranks."""
        seeds = np.flatnonzero(self.is_prefix[words]) if len(words) else []
        blocks = sorted({int(p) // stride - d for p in seeds for d in (0, 1) if int(p) // stride >= d})
        for k in blocks:
            here = words[k * stride : (k + 2) * stride]
            own = np.unique(here[here >= 0]).tolist()
            size, tried = len(own), set()
            for j, token in enumerate(own):
                for n, i in self.prefix.get(token, ()):
                    if n in tried:
                        continue
                    tried.add(n)  # tokens come in order: this is the first one that both share
                    need = self.needed[n]
                    if size < need or j > size - need or 1 + min(len(self.sets[n]) - i - 1, size - j - 1) < need:
                        continue
                    overlap = len(self.sets[n].intersection(own))
                    if overlap >= need:
                        yield k, n, overlap

    @property
    def is_prefix(self) -> np.ndarray:
        if not hasattr(self, "_flags"):
            self._flags = np.zeros(len(self.hashes) + 1, bool)  # the last entry is read for -1
            self._flags[list(self.prefix)] = True
        return self._flags


def word_counts(docs: DataFrame, templates: list[Template], text: str = "text") -> dict[bytes, int]:
    """How often each template word stands in all texts (as many rows as there are template words)."""
    words = sorted({w for t in templates for w in split_words(t.text)})
    roll = Roller(_SEED)
    by = {roll.one(w): w for w in words}
    known = np.array(sorted(by), np.uint64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashing = np.zeros(len(known), np.int64), Roller(_SEED)
        for batch in batches:
            for _, _, data, offs in chunks(batch.column("__text")):
                low = LOWER[data]
                s, e, _ = runs(ALNUM[low], offs)
                h = hashing.spans(hashing.sums(low), s, e)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                total += np.bincount(at[known[at] == h], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(signed(known)), pa.array(total)], names=["word", "n"])

    found = docs.select(F.col(text).cast("string").alias("__text")).mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {by[r["word"] & (2**64 - 1)]: r["n"] for r in found}


def scan(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), phrases: list[Template] | None = None, notices: list[Template] | None = None,
         stride: int = STRIDE, text: str = "text") -> DataFrame:
    """``carry`` columns, n_words, places (label, first word) of phrases and blocks (label, block, containment) meeting a notice."""
    templates = [*(PHRASES if phrases is None else phrases), *(NOTICES if notices is None else notices)]
    if any(t.phrase and len(split_words(t.text)) > stride for t in templates):
        raise ValueError("a phrase must not be longer than a stride of words")
    counts = word_counts(docs, templates, text)
    src = docs.select(*carry, F.col(text).cast("string").alias("__text"))
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    block = pa.list_(pa.struct([("label", pa.string()), ("block", pa.int64()), ("containment", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, roll = Index(templates, counts), Roller(_SEED)
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column("__text")):
                low = LOWER[data]
                s, e, first = runs(ALNUM[low], offs)
                ranks = index.tokens(roll.spans(roll.sums(low), s, e))
                seeds = np.concatenate([[0], np.cumsum(index.is_prefix[ranks])])
                some = seeds[first[1:]] > seeds[first[:-1]]
                places, blocks = [], []
                for d in range(hi - lo):
                    p, b = [], []
                    if some[d]:
                        words = ranks[first[d] : first[d + 1]]
                        for k, n, overlap in index.matches(words, stride):
                            seq = index.phrases[n]
                            if seq is None:
                                b.append({"label": index.templates[n].label, "block": k, "containment": overlap / len(index.sets[n])})
                                continue
                            here = words[k * stride : (k + 1) * stride + len(seq) - 1]
                            at = np.arange(max(min(stride, len(here) - len(seq) + 1), 0))
                            good = np.ones(len(at), bool)
                            for i, w in enumerate(seq):
                                good &= here[at + i] == w
                            p += [{"label": index.templates[n].label, "word": k * stride + int(x)} for x in at[good]]
                    places.append(p)
                    blocks.append(b)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in carry], pa.array(np.diff(first)), pa.array(places, place), pa.array(blocks, block)],
                                                 names=[*carry, "n_words", "places", "blocks"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return src.mapInArrow(work, schema + ", n_words long, places array<struct<label:string,word:long>>, blocks array<struct<label:string,block:long,containment:double>>")


def report(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), **how) -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word, base_labels, labels, n_blocks and score (the best containment)."""
    found = scan(docs, carry, **how)
    label = lambda c: F.transform(c, lambda x: x["label"])
    words = F.transform("places", lambda x: x["word"])
    best = F.array_max(F.transform("blocks", lambda x: x["containment"]))
    return found.select(*carry, "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
                        F.array_join(F.array_sort(F.array_distinct(label(F.col("places")))), ",").alias("base_labels"),
                        F.array_join(F.array_sort(F.array_distinct(F.concat(label(F.col("places")), label(F.col("blocks"))))), ",").alias("labels"),
                        F.size("blocks").cast("long").alias("n_blocks"),
                        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"))
