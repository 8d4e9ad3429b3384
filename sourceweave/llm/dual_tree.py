"""Ranked lexical search by dual trees: hierarchies over items and over documents, pruned in pairs of nodes.

A document is a sparse vector of impacts of its terms, an item one of weighted
term counts; a score is their product. Both sides form binary hierarchies in
which every node holds the coordinate maxima of its members, so the product of
two nodes bounds every score between their members. A pair of nodes whose bound
lies below the weakest k-th best score of the node's items is dropped with all
its pairs, exactly; what is left at the leaves is scored in whole numbers, the
highest bounds first.

On Spark: items go out in blocks of bounded size. For each block one scan finds
the block's terms in every document, and the vectors are stored. Then every
task builds hierarchies over batches of its documents and searches them with
the block's hierarchy, keeping k rows an item; the rows of all tasks are ranked
at the end. A first search over a share of the documents gives every task a
k-th score to start with: only a lower bound, so it saves time and drops
nothing. Nothing is shuffled but term counts and those k rows per task.

Defined results: a null or empty text has no terms and neither ranks nor counts
as a document with terms; an item without terms, or with terms that stand
nowhere, has no rows; every item row is an item of its own, also with equal,
repeated or null ids; fewer than k rows come out where fewer score above 0.
Equal scores rank by ascending document id, null last; repeated ids are
documents of their own. An empty table on either side gives an empty result.
A very long text is one vector, a very long item a block of its own with
smaller batches of documents. Words are told apart by 128 bits of hashes. Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sourceweave.llm.common import ALNUM, LOWER, Roller, chunks, owner, ragged, runs, stored
from sourceweave.llm.wu_manber import words_of

#: an item block ends at so many items, different terms or bytes of text
BLOCK_ITEMS, BLOCK_TERMS, BLOCK_BYTES = 256, 1 << 14, 1 << 20
#: members of a leaf, documents of a batch, and cells of the maxima of one batch
ITEM_LEAF, DOC_LEAF, BATCH, CELLS = 4, 32, 4096, 1 << 22
#: one in so many documents is searched first, for scores to start with
SEED_SHARE = 32
_SEEDS = (11, 12)
#: bounds are products of doubles; a bound this much lower still counts as reached
_SLACK = 1e-9


class Hierarchy:
    """Binary hierarchy over sparse rows, in an order that keeps every node's rows together.

    A node is halved by the coordinate that comes nearest to half of its rows;
    where none parts them well, by place.
    """

    def __init__(self, first: np.ndarray, cols: np.ndarray, width: int, leaf: int):
        n = len(first) - 1
        self.order = np.arange(n)
        self.lo, self.hi, self.left, self.right = [0], [n], [-1], [-1]
        size = np.diff(first)
        todo = [0] if n else []
        while todo:
            node = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo <= leaf:
                continue
            rows = self.order[lo:hi]
            at = ragged(first[rows], size[rows])
            count = np.bincount(cols[at], minlength=width) if width else np.zeros(1, int)
            best = int(np.argmin(np.abs(2 * count - (hi - lo))))
            mid = lo + (hi - lo) // 2
            if 8 * min(count[best], hi - lo - count[best]) >= hi - lo:
                has = np.zeros(hi - lo, bool)
                has[np.repeat(np.arange(hi - lo), size[rows])[cols[at] == best]] = True
                self.order[lo:hi] = np.concatenate([rows[has], rows[~has]])
                mid = lo + int(has.sum())
            for side, a, b in ((self.left, lo, mid), (self.right, mid, hi)):
                side[node] = len(self.lo)
                todo.append(len(self.lo))
                self.lo.append(a)
                self.hi.append(b)
                self.left.append(-1)
                self.right.append(-1)

    def maxima(self, first: np.ndarray, cols: np.ndarray, vals: np.ndarray, width: int) -> np.ndarray:
        """Greatest value of every coordinate in every node (nodes by width, doubles)."""
        out = np.zeros((len(self.lo), width))
        for node in range(len(self.lo) - 1, -1, -1):  # children stand behind their parent
            if self.left[node] >= 0:
                np.maximum(out[self.left[node]], out[self.right[node]], out=out[node])
            else:
                rows = self.order[self.lo[node] : self.hi[node]]
                at = ragged(first[rows], first[rows + 1] - first[rows])
                np.maximum.at(out[node], cols[at], vals[at])
        return out


class Items:
    """One block of items: weighted term counts, their hierarchy and its maxima."""

    def __init__(self, counts: list[dict[int, int]], weights: np.ndarray):
        self.width = len(weights)
        first = np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int64)
        cols = np.array([t for c in counts for t in c], np.int64)
        vals = np.array([n for c in counts for n in c.values()], np.int64) * weights[cols] if len(cols) else cols
        self.query = np.zeros((len(counts), self.width), np.int64)
        self.query[np.repeat(np.arange(len(counts)), np.diff(first)), cols] = vals
        self.tree = Hierarchy(first, cols, self.width, ITEM_LEAF)
        self.bound = self.tree.maxima(first, cols, vals, self.width)


class Best:
    """The k best (score, document) of every item: higher scores first, then lower ids."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.rows: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        self.kth = floor.astype(np.int64).copy()

    def add(self, item: int, score: np.ndarray, doc: np.ndarray) -> None:
        keep = score >= max(self.kth[item], 1)
        if not keep.any():
            return
        s, d = (np.concatenate([a, b[keep]]) for a, b in zip(self.rows[item], (score, doc)))
        order = np.lexsort((d, -s))[: self.k]
        self.rows[item] = s[order], d[order]
        if len(order) == self.k:
            self.kth[item] = max(self.floor[item], s[order[-1]])


def search(items: Items, best: Best, first: np.ndarray, cols: np.ndarray, vals: np.ndarray, ids: np.ndarray) -> int:
    """Search one batch of documents (rows of impacts) for all items; returns the number of scored pairs of rows."""
    docs, own = Hierarchy(first, cols, items.width, DOC_LEAF), items.tree
    top = docs.maxima(first, cols, vals, items.width)

    def weakest() -> np.ndarray:
        """Weakest k-th score below every node of the items."""
        out = np.zeros(len(own.lo))
        for node in range(len(own.lo) - 1, -1, -1):
            out[node] = min(out[own.left[node]], out[own.right[node]]) if own.left[node] >= 0 else best.kth[own.order[own.lo[node] : own.hi[node]]].min(initial=1 << 62)
        return out

    pairs, leaves = [(0, 0)], []
    least = weakest()
    while pairs:
        by: dict[int, list[int]] = {}
        for a, b in pairs:
            by.setdefault(a, []).append(b)
        pairs = []
        for a, bs in by.items():
            bound = top[bs] @ items.bound[a]
            for b, value in zip(bs, bound.tolist()):
                if value <= 0 or value * (1 + _SLACK) < least[a]:
                    continue
                here, there = own.left[a] >= 0, docs.left[b] >= 0
                if not here and not there:
                    leaves.append((value, a, b))
                elif here and (not there or own.hi[a] - own.lo[a] > (docs.hi[b] - docs.lo[b]) * ITEM_LEAF // DOC_LEAF):
                    pairs += [(own.left[a], b), (own.right[a], b)]
                else:
                    pairs += [(a, docs.left[b]), (a, docs.right[b])]
    leaves.sort(reverse=True)
    scored = 0
    slices: dict[int, tuple] = {}
    for value, a, b in leaves:
        members = own.order[own.lo[a] : own.hi[a]]
        if value * (1 + _SLACK) < best.kth[members].min():
            continue
        if b not in slices:
            rows = docs.order[docs.lo[b] : docs.hi[b]]
            size = first[rows + 1] - first[rows]
            at = ragged(first[rows], size)
            slices[b] = cols[at], vals[at], np.concatenate([[0], np.cumsum(size)])[:-1], ids[rows]
        c, v, starts, which = slices[b]
        scores = np.add.reduceat(items.query[members][:, c] * v, starts, axis=1)
        scored += scores.size
        for i, s in zip(members.tolist(), scores):
            best.add(i, s, which)
    return scored


def vectors(docs: DataFrame, sent: Broadcast, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n (terms with repeats), terms and tfs (the block's terms in the text and how often) of every document."""
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = "doc_id long, n long, terms array<int>, tfs array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, other = sent.value
        rolls = [Roller(s) for s in _SEEDS]
        order = np.argsort(known)
        ranked = known[order]
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column("__text")):
                low = LOWER[data]
                s, e, first = runs(ALNUM[low], offs)
                h = rolls[0].spans(rolls[0].sums(low), s, e)
                at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
                hit = np.flatnonzero(ranked[at] == h)
                term = order[at[hit]]
                same = rolls[1].spans(rolls[1].sums(low), s[hit], e[hit]) == other[term]
                row = owner(first)[hit][same]
                pair, tf = np.unique(row * np.int64(len(known)) + term[same], return_counts=True)
                cut = pa.array(np.searchsorted(pair, np.arange(hi - lo + 1) * np.int64(len(known))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)),
                     pa.ListArray.from_arrays(cut, pa.array((pair % len(known)).astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(tf.astype(np.int32)))],
                    names=["doc_id", "n", "terms", "tfs"])

    return src.mapInArrow(work, schema)


def _searched(rows: DataFrame, sent: Broadcast, k: int, total: int, length: int) -> DataFrame:
    """item (number in the block), doc_id and score: at most k rows an item and task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floor = sent.value
        best = Best(len(items.query), k, floor)
        per = max(DOC_LEAF, min(BATCH, CELLS // max(items.width, 1) * DOC_LEAF // 2))
        none = 1 << 62
        for batch in batches:
            for lo in range(0, batch.num_rows, per):
                part = batch.slice(lo, per)
                n = part.column("n").to_numpy()
                terms, tfs = part.column("terms"), part.column("tfs")
                first = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())]).astype(np.int64)
                cols, tf = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
                m = 75 + 25 * n * total // length
                vals = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, np.diff(first)))
                search(items, best, first, cols, vals, part.column("doc_id").fill_null(none).to_numpy())
        item = np.repeat(np.arange(len(best.rows)), [len(s) for s, _ in best.rows])
        score, doc = (np.concatenate([r[x] for r in best.rows] or [np.zeros(0, np.int64)]) for x in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(doc, pa.int64(), mask=doc == none), pa.array(score)], names=["item", "doc_id", "score"])

    return rows.where(F.size("terms") > 0).mapInArrow(work, "item int, doc_id long, score long")


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, dict[bytes, int]]]]:
    """Blocks of (id, term counts) that the driver holds one at a time."""
    block: list = []
    seen: set[bytes] = set()
    size = 0
    for row in items.select(F.col(item_id).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).toLocalIterator():
        counts: dict[bytes, int] = {}
        for w in words_of(bytes(row[1])):
            if w:
                counts[w] = counts.get(w, 0) + 1
        if not counts:
            continue
        if block and (len(block) >= BLOCK_ITEMS or size + len(row[1]) > BLOCK_BYTES or len(seen | counts.keys()) > BLOCK_TERMS):
            yield block
            block, seen, size = [], set(), 0
        block.append((row[0], counts))
        seen |= counts.keys()
        size += len(row[1])
    if block:
        yield block


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, text: str = "text", key: str = "doc_id", item_id: str = "item_id", item_text: str = "text",
           seed_share: int = SEED_SHARE) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of every item."""
    spark = docs.sparkSession
    schema = StructType([StructField("item_id", LongType())])
    rolls = [Roller(s) for s in _SEEDS]
    out, shape = None, None
    for block in item_blocks(items, item_id, item_text):
        terms = sorted({t for _, c in block for t in c})
        number = {t: i for i, t in enumerate(terms)}
        sent = spark.sparkContext.broadcast(tuple(np.array([roll.one(t) for t in terms], np.uint64) for roll in rolls))
        rows = stored(vectors(docs, sent, text, key), "term-vectors")
        if shape is None:
            shape = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        total, length = shape[0], shape[1] or 0
        df = np.zeros(len(terms), np.int64)
        for t, n in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's terms
            df[t] = n
        weights = np.floor(1000 * np.log((2.0 * total + 2) / (2.0 * df + 1))).astype(np.int64)
        made = Items([{number[t]: n for t, n in c.items()} for _, c in block], weights)
        floor = np.zeros(len(block), np.int64)
        by_item = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        tops = lambda rows, start: _searched(rows, start, k, total, max(length, 1)).withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= k)
        if seed_share:
            first = spark.sparkContext.broadcast((made, floor))
            for r in tops(rows.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(seed_share)) == 0), first).where(F.col("rank") == k).collect():  # one row an item
                floor[r["item"]] = r["score"]
            first.destroy()
        start = spark.sparkContext.broadcast((made, floor))
        names = F.broadcast(spark.createDataFrame([(i, b[0]) for i, b in enumerate(block)], "item int, item_id long"))  # at most BLOCK_ITEMS rows
        part = stored(tops(rows, start).join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        sent.destroy()
        start.destroy()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], StructType(schema.fields + StructType.fromDDL("rank int, doc_id long, score long").fields))
