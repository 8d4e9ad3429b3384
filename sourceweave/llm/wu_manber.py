"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of ``window`` consecutive words of every benchmark
item (an item of fewer words is one window). Patterns of one length share a
shift table keyed by blocks of two words: at a position whose block ends no
pattern soon, the search jumps ahead as far as the table allows. At shift 0 the
suffix bucket of the block holds the patterns that may end here; their first
block is looked at next and the words themselves are compared last.

The documents are scanned once, without a shuffle. Pattern tables go to the
executors in blocks of at most ``block_words`` words; a larger benchmark takes
one more pass of the same rows per block, so the size sent is bounded and no
pattern is left out.

Defined results: null or empty texts have no words and are clean; items without
words have no windows; repeated items or ids count once per id. Items with a
null id count like any other for hits and verdict and as one item together; only
the list of names leaves them out. Rows are judged one by one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceweave.llm.common import ALNUM, LOWER, Roller, chunks, runs

WINDOW = 13
#: words of patterns that one pass carries; about 100 bytes of table each
BLOCK_WORDS = 1_000_000
_SEED = 6
_M = 0x9E3779B97F4A7C15


def words_of(text: bytes) -> list[bytes]:
    """Words of one text, as the search sees them (used for patterns and tests)."""
    low = LOWER[np.frombuffer(text, np.uint8)]
    return np.where(ALNUM[low], low, np.uint8(32)).astype(np.uint8).tobytes().split(b" ") if text else []


def windows_of(text: bytes, window: int) -> list[tuple[bytes, ...]]:
    w = [x for x in words_of(text) if x]
    if not w:
        return []
    return [tuple(w)] if len(w) < window else [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]


def pair_hash(a: int, b: int) -> int:
    return (a * _M + b) & (2**64 - 1)


class Table:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[int]], roll: Roller):
        self.length = length
        self.block = min(2, length)
        self.furthest = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, dict[int, list[tuple[bytes, tuple[int, ...]]]]] = defaultdict(lambda: defaultdict(list))
        seen: dict[bytes, int] = {}
        for words, items in patterns.items():
            h = [seen[w] if w in seen else seen.setdefault(w, roll.one(w)) for w in words]
            keys = h if self.block == 1 else [pair_hash(a, b) for a, b in zip(h, h[1:])]
            for at, key in enumerate(keys):
                away = len(keys) - 1 - at
                if away < self.shift.get(key, self.furthest):
                    self.shift[key] = away
            self.bucket[keys[-1]][keys[0]].append((b" ".join(words), tuple(items)))
        self.bucket = {k: dict(v) for k, v in self.bucket.items()}

    def search(self, keys: list[int], lo: int, hi: int, slice_of, hits: list, items: set) -> None:
        """Occurrences in words lo..hi; ``keys[i]`` is the block that begins at word i."""
        shift, furthest, bucket = self.shift.get, self.furthest, self.bucket
        at, end, back = lo + furthest - 1, hi - self.block, furthest - 1
        while at <= end:
            step = shift(keys[at], furthest)
            if step:
                at += step
                continue
            start = at - back
            for text, which in bucket[keys[at]].get(keys[start], ()):
                if slice_of(start, start + self.length) == text:
                    hits.append((start, start + self.length))
                    items.update(which)
            at += 1


def build_tables(items: list[tuple[str | None, bytes]], window: int) -> tuple[list[Table], list[str | None]]:
    """Tables by pattern length and the item names; ``items`` are (id, text)."""
    roll = Roller(_SEED)
    names = sorted({i for i, _ in items if i is not None}) + [None]
    number = {n: k for k, n in enumerate(names)}
    by: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for i, text in items:
        for w in windows_of(text, window):
            by[len(w)][w].add(number[i])
    return [Table(n, p, roll) for n, p in sorted(by.items())], names


def scan(column: pa.Array, tables: list[Table], names: list[str], roll: Roller) -> Iterator[tuple[int, int, np.ndarray, list, list]]:
    """Per chunk: (first row, end row, words per row, spans per row, item names per row)."""
    for lo, hi, data, offs in chunks(column):
        low = LOWER[data]
        s, e, first = runs(ALNUM[low], offs)
        h = roll.spans(roll.sums(low), s, e)
        pairs = (h[:-1] * np.uint64(_M) + h[1:]).tolist() + [0] if len(h) else []
        ones = h.tolist() if any(t.block == 1 for t in tables) else pairs
        raw, starts, ends = low.tobytes(), s, e

        def slice_of(a: int, b: int) -> bytes:
            return b" ".join([raw[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())])

        spans, found = [], []
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            hits: list = []
            items: set = set()
            for t in tables:
                if b - a >= t.length:
                    t.search(ones if t.block == 1 else pairs, a, b, slice_of, hits, items)
            spans.append([(x - a, y - a) for x, y in hits])
            found.append([names[k] for k in items])
        yield lo, hi, np.diff(first), spans, found


def occurrences(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, spans (array of first word, end word) and items (array of strings; null: items without an id) of all occurrences."""
    spark = docs.sparkSession
    work = items.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    # rows of items are dealt to passes by hash: a row is never split, a pass holds about block_words words of six characters
    total = work.agg(F.sum(F.length("t"))).first()[0] or 0
    passes = max(1, -(-int(total) // (block_words * 6)))
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<a:int,b:int>>"), "items": F.array().cast("array<string>")})
    for k in range(passes):
        part = work.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k) if passes > 1 else work
        rows = part.select("i", "t").toArrow()
        pairs = list(zip(rows["i"].to_pylist(), [t.encode() for t in rows["t"].to_pylist()]))
        sent = spark.sparkContext.broadcast(pairs)
        out = out.mapInArrow(_pass(sent, text, window, out.columns), out.schema)
    return out


def _pass(sent, text: str, window: int, columns: list[str]):
    spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, names = build_tables(sent.value, window)
        roll = Roller(_SEED)
        for batch in batches:
            for lo, hi, n, spans, found in scan(batch.column(text), tables, names, roll):
                part = batch.slice(lo, hi - lo)
                before, had = part.column("spans").to_pylist(), part.column("items").to_pylist()
                cols = {c: part.column(c) for c in columns}
                cols["n_words"] = pa.array(n.astype(np.int64))
                cols["spans"] = pa.array([[*x, *[{"a": a, "b": b} for a, b in y]] for x, y in zip(before, spans)], spans_type)
                cols["items"] = pa.array([[*x, *y] for x, y in zip(had, found)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([cols[c] for c in columns], names=columns)

    return work




def contamination(docs: DataFrame, items: DataFrame, carry: tuple[str, ...] = ("doc_id",), least_share: int = 20, text: str = "text", **how) -> DataFrame:
    """``carry`` columns, n_words, n_hit (words inside any occurrence), n_items, items_sha256 and the verdict.

    A row is contaminated with a hit when n_hit is at least 1/``least_share`` of its words.
    """
    src = docs.select(*carry, F.col(text).cast("string").alias("__text"))
    found = occurrences(src, items, text="__text", **how).drop("__text")
    # spans are sorted by start; the part of each that lies beyond all earlier ones is new
    fold = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("done"), F.lit(0).cast("long").alias("n")),
                       lambda acc, x: F.struct(F.greatest(acc["done"], x["b"]).alias("done"),
                                               (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["done"]))).cast("long").alias("n")),
                       lambda acc: acc["n"])
    names = F.array_sort(F.array_distinct("items"))
    return (found.withColumn("n_hit", fold)
            .withColumn("n_items", F.size(F.array_distinct("items")).cast("long"))
            .withColumn("items_sha256", F.sha2(F.array_join(names, ",").cast("binary"), 256))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(least_share) * F.col("n_hit") >= F.col("n_words")))
            .drop("spans", "items"))
