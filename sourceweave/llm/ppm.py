"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``order``, with a boundary symbol
before and after every text. A symbol seen in a context has probability
count / (total + distinct) (escape method C); otherwise the escape
distinct / (total + distinct) leads to the next shorter context, in which all
symbols seen in the longer one are excluded, and at last to a uniform choice
among symbols never seen.

The trie is kept as rows, one per *gram*, a symbol with the ``order`` symbols
before it, so it grows with the corpus and nothing of it is cut. A gram's code is
exact, no hash, and starts with the nearest symbol: the grams of a context of
three symbols or more lie together in one task, which works out their log10
probability from the counts of all shorter contexts. What a task needs of the
contexts of up to two symbols is sent to it: at most 257**3 counts, a size
bounded by the order.

The grams met most often (at most ``table_grams``) are sent to the scan as
sorted codes, all others are joined as rows, so both parts are exact. The
unigram base over words beside it is computed in the same way, with at most
``table_words`` words sent. Words are known by 64-bit hashes.

Defined results: null texts are empty and score the end symbol only; a null id
counts as the empty string when the training part is chosen; without training
rows all symbols are equally likely and the base has N = V = 0. Repeated rows
are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceweave.llm.common import LOWER, SPACE, Roller, chunks, owner, runs, signed, stored

SYMBOLS = 257
EDGE = 256
#: words whose counts are sent to the scan: 16 bytes each
TABLE_WORDS = 1 << 19
#: grams whose probabilities are sent to the scan: 12 bytes each
TABLE_GRAMS = 1 << 21
#: a gram of the longest context fits into 63 bits
MAX_ORDER = 6
#: different keys a task holds before it hands on partial counts
_HOLD = 1 << 20
_SEED = 8


def held_out(doc_id: Column, parts: int = 10) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0


def _symbols(low: np.ndarray, offs: np.ndarray, order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(code of each symbol with its ``order`` predecessors, first place of each document).

    The digits of a code are the predecessors, the nearest first, and then the symbol itself.
    """
    docs = len(offs) - 1
    x = np.empty(len(low) + docs, np.int64)
    ends = offs[1:] + np.arange(docs)
    inside = np.ones(len(x), bool)
    inside[ends] = False
    x[ends], x[inside] = EDGE, low
    first = np.concatenate([[0], ends[:-1] + 1]) if docs else np.zeros(0, np.int64)
    code, before = np.zeros(len(x), np.int64), x
    for _ in range(order):
        before = np.concatenate([[EDGE], before[:-1]])
        before[first] = EDGE
        code = code * SYMBOLS + before
    return code * SYMBOLS + x, first


class _Counter:
    """Sums of equal keys, handed on as partial sums when too many are held: ``n`` in training texts, ``met`` in all."""

    def __init__(self, kind: int, training: bool = True):
        self.kind, self.training, self.keys, self.sums, self.held = kind, training, [], [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.sums.append(n)
        self.held += len(k)
        if self.held > 4 * _HOLD:
            self._merge()
            if self.held > _HOLD:
                yield from self.flush()

    def _merge(self) -> None:
        keys, sums = np.concatenate(self.keys), np.concatenate(self.sums)
        k, back = np.unique(keys, return_inverse=True)
        self.keys, self.sums, self.held = [k], [np.bincount(back, weights=sums, minlength=len(k)).astype(np.int64)], len(k)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            self._merge()
            k, n = self.keys[0], self.sums[0]
            k = signed(k) if k.dtype == np.uint64 else k.astype(np.int64)
            for a in range(0, len(k), 100_000):
                part, met = k[a : a + 100_000], n[a : a + 100_000]
                yield _counted(self.kind, part, met if self.training else np.zeros_like(met), met)
        self.keys, self.sums, self.held = [], [], 0


_COUNTED = "kind int, key long, n long, met long"


def _counted(kind: int, keys: np.ndarray, n: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n), pa.array(met)], names=["kind", "key", "n", "met"])


def _count(order: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial counts: kind 0 words of training texts, 1 grams, 2 training texts."""
        roll, words, grams, others, texts = Roller(_SEED), _Counter(0), _Counter(1), _Counter(1, training=False), 0
        for batch in batches:
            away = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, offs in chunks(batch.column("__text")):
                low, held = LOWER[data], away[lo:hi]
                s, e, first = runs(~SPACE[low], offs)
                train = ~held[owner(first)]
                yield from words.add(roll.spans(roll.sums(low), s[train], e[train]))
                code, _ = _symbols(low, offs, order)
                train = np.repeat(~held, np.diff(offs) + 1)
                yield from grams.add(code[train])
                yield from others.add(code[~train])
                texts += int((~held).sum())
        for counter in (words, grams, others):
            yield from counter.flush()
        if texts:
            yield _counted(2, np.zeros(1, np.int64), np.array([texts]), np.array([texts]))

    return work


class _Low:
    """Counts of all contexts of up to two symbols: ``cells`` are codes of order two, ascending, with their counts."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray):
        n = SYMBOLS
        self.cells, self.counts = cells, counts
        near, x = cells // (n * n), cells % n
        one = np.bincount(near * n + x, weights=counts, minlength=n * n).astype(np.int64)
        zero = one.reshape(n, n).sum(axis=0)
        pair = cells // n
        # for contexts of two, one and no symbols: all counts, different symbols, counts in the next shorter context of the symbols seen in this one
        self.stats = [self._stats(np.zeros(n, np.int64), zero, np.zeros(n, np.int64), 1), self._stats(np.arange(n * n) // n, one, np.tile(zero, n), n),
                      self._stats(pair, counts, one[near * n + x], n * n)]
        self.one, self.zero = one, zero

    @staticmethod
    def _stats(context: np.ndarray, counts: np.ndarray, shorter: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seen = counts > 0
        add = lambda w: np.bincount(context, weights=w, minlength=size).astype(np.int64)
        return add(counts), add(seen), add(np.where(seen, shorter, 0))

    def levels(self, codes: np.ndarray, order: int) -> list[tuple[np.ndarray, ...]]:
        """Per order 0 to 2 and gram: its count there, and the three sums of its context."""
        n = SYMBOLS
        pair, x = codes // n ** (order - 1), codes % n
        near, cell = pair // n, pair * n + x
        at = np.minimum(np.searchsorted(self.cells, cell), max(len(self.cells) - 1, 0))
        two = np.where(self.cells[at] == cell, self.counts[at], 0) if len(self.cells) else np.zeros(len(codes), np.int64)
        return [(count, *[s[context] for s in self.stats[k]]) for k, (count, context) in enumerate(
            [(self.zero[x], np.zeros(len(codes), np.int64)), (self.one[near * n + x], near), (two, pair)])]


def log_grams(codes: np.ndarray, counts: np.ndarray, low: _Low, order: int) -> np.ndarray:
    """log10 P(symbol | ``order`` before) of grams, all grams of a context of three symbols (of the order, if less) being there."""
    levels, x = low.levels(codes, order), codes % SYMBOLS
    for k in range(3, order + 1):
        pairs, there, back = np.unique(codes // SYMBOLS ** (order + 1 - k) * SYMBOLS + x, return_index=True, return_inverse=True)
        count = np.bincount(back, weights=counts, minlength=len(pairs)).astype(np.int64)
        context = np.unique(pairs // SYMBOLS, return_inverse=True)[1]
        stats = _Low._stats(context, count, levels[k - 1][0][there], int(context[-1]) + 1 if len(pairs) else 0)
        levels.append((count[back], *[s[context[back]] for s in stats]))
    out, done, begun = np.zeros(len(codes)), np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    gone = kept = np.zeros(len(codes), np.int64)  # counts and number of the symbols that the longer context excludes
    for count, total, kinds, shorter in reversed(levels):
        left, new = total - np.where(begun, gone, 0), kinds - np.where(begun, kept, 0)
        open_ = ~done & (new > 0)
        # where all symbols are seen nothing is left to escape to
        whole = np.maximum(left + np.where(kinds < SYMBOLS, new, 0), 1)
        hit = open_ & (count > 0)
        part = np.where(hit, count, new)
        out[open_] += np.log10(part[open_] / whole[open_])
        done |= hit
        begun |= total > 0
        gone, kept = shorter, kinds
    return out - np.where(done, 0.0, np.log10(np.maximum(SYMBOLS - kept, 1)))


def _model(sent, order: int):
    """Log probabilities of the grams of a task, which come sorted and with all others of their context of three symbols."""
    step = SYMBOLS ** max(order - 2, 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, held, size = sent.value, [], 0

        def done(part: list[np.ndarray]) -> pa.RecordBatch:
            key, n, met = part
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(met), pa.array(log_grams(key, n, low, order).astype(np.float32))], names=["key", "met", "logp"])

        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("key", "n", "met")])
            size += batch.num_rows
            if size < 200_000:
                continue
            whole = [np.concatenate(c) for c in zip(*held)]
            # what follows the last change of the context waits for its rest; up to order two every gram stands alone
            cut = int(np.searchsorted(whole[0], whole[0][-1] // step * step)) if order > 2 else len(whole[0])
            if cut:
                yield done([c[:cut] for c in whole])
            held, size = [[c[cut:] for c in whole]], 0
        if held:
            yield done([np.concatenate(c) for c in zip(*held)])

    return work


def _lists(keys: np.ndarray, doc: np.ndarray, docs: int) -> list[pa.Array]:
    """Per document its different keys and how often each occurs."""
    at = np.lexsort((keys, doc))
    keys, doc = keys[at], doc[at]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    times = np.diff(np.concatenate([begin, [len(keys)]])).astype(np.int32)
    firsts = np.searchsorted(doc[begin], np.arange(docs + 1)).astype(np.int32)
    return [pa.ListArray.from_arrays(firsts, signed(keys[begin])), pa.ListArray.from_arrays(firsts, times)]


def _found(known: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a key is in the sorted table, its value there or 0)."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    there = known[at] == keys
    return there, np.where(there, values[at].astype(np.float64), 0.0)


def _score(sent, order: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, probs, known, logs = sent.value
        roll = Roller(_SEED)
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column("__text")):
                docs = hi - lo
                low = LOWER[data]
                s, e, first = runs(~SPACE[low], offs)
                h, doc = roll.spans(roll.sums(low), s, e), owner(first)
                there, log = _found(known, logs, h)
                code, begin = _symbols(low, offs, order)
                # equal grams are looked up once, in the order of the table
                each, back = np.unique(code, return_inverse=True)
                met, value = _found(grams, probs, each)
                far, gdoc = ~met[back], np.repeat(np.arange(docs), np.diff(offs) + 1)
                cut = [batch.column(c).slice(lo, docs) for c in ("doc_id", "row", "held_out")]
                yield pa.RecordBatch.from_arrays(
                    [*cut, pa.array(np.diff(first) + 1), pa.array(np.bincount(doc[there], minlength=docs).astype(np.int64)),
                     pa.array(np.bincount(doc, weights=log, minlength=docs)), pa.array(np.add.reduceat(value[back], begin)),
                     *_lists(h[~there], doc[~there], docs), *_lists(code[far], gdoc[far], docs)],
                    names=["doc_id", "row", "held_out", "n_tokens", "known", "base", "near", "rare", "times", "far", "far_times"])

    return work


def _floor(rows: DataFrame, count: str, limit: int) -> int:
    """The least count whose rows, with all of higher counts, are at most ``limit``; counts beyond 2**16 are one class."""
    classes = rows.groupBy(F.least(count, F.lit(1 << 16)).alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()
    floor, fit = (1 << 62), 0
    for c, k in sorted(((r["c"], r["k"]) for r in classes), reverse=True):
        if fit + k > limit:
            break
        floor, fit = c, fit + k
    return floor


def _by_key(rows: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    top = rows.select("key", value).toArrow()
    keys, values = top["key"].to_numpy(), top[value].to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", table_words: int = TABLE_WORDS, order: int = 2, table_grams: int = TABLE_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    if not 2 <= order <= MAX_ORDER:
        raise ValueError(f"order must be 2 to {MAX_ORDER}")
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), held_out(F.col(doc_id)).alias("held_out"),
                      F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    counts = stored(src.select("held_out", "__text").mapInArrow(_count(order), _COUNTED)
                    .groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("met").alias("met")), "counts")
    words, counted = counts.where("kind = 0"), counts.where("kind = 1").select("key", "n", "met")
    sums = {r["kind"]: r for r in counts.where("kind <> 1").groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).collect()}  # two rows
    texts = sums[2]["n"] if 2 in sums else 0
    total = texts + (sums[0]["n"] if 0 in sums else 0)
    distinct = (sums[0]["d"] if 0 in sums else 0) + bool(texts)
    whole = total + 0.1 * (distinct + 1)
    # contexts of two symbols: at most 257**3 counts
    cells = counted.where("n > 0").groupBy(F.expr(f"key div {SYMBOLS ** (order - 1)} * {SYMBOLS} + key % {SYMBOLS}").alias("key")).agg(F.sum("n").alias("n"))
    low = spark.sparkContext.broadcast(_Low(*_by_key(cells, "n")))
    if order > 2:
        counted = counted.repartition(F.expr(f"key div {SYMBOLS ** (order - 2)}")).sortWithinPartitions("key")
    model = stored(counted.mapInArrow(_model(low, order), "key long, met long, logp float"), "grams")
    floor, often = _floor(words, "n", table_words), _floor(model, "met", table_grams)
    top, n = _by_key(words.where(F.col("n") >= floor), "n")
    keys = top.view(np.uint64)
    by_hash = np.argsort(keys)
    sent = spark.sparkContext.broadcast((*_by_key(model.where(F.col("met") >= often), "logp"), keys[by_hash], np.log10((n[by_hash] + 0.1) / whole)))
    id_type = src.schema["doc_id"].dataType.simpleString()
    part = stored(src.mapInArrow(_score(sent, order), f"doc_id {id_type}, row long, held_out boolean, n_tokens long, known long, base double, near double, "
                                 "rare array<long>, times array<int>, far array<long>, far_times array<int>"), "scored")

    def outside(keys: str, times: str) -> DataFrame:
        """What the tables do not hold: once per different text, whatever the number of its copies."""
        found = part.select("row", F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(times).alias("times"))).alias("x"))
        return found.groupBy("row", F.col("x.key").alias("key")).agg(F.max("x.times").alias("times"))

    rare, far = outside("rare", "times"), outside("far", "far_times")
    seen = words.where(F.col("n") < floor).select(F.col("key").alias("__key"), "n")
    log = F.log10((F.coalesce("n", F.lit(0)) + F.lit(0.1)) / F.lit(whole))
    more = rare.join(seen, rare.key == seen["__key"], "left").groupBy(F.struct("row").alias("__k")).agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * log).alias("more_base"))
    other = far.join(model.where(F.col("met") < often).select("key", "logp"), "key").groupBy(F.struct("row").alias("__k")).agg(
        F.sum(F.col("times") * F.col("logp").cast("double")).alias("more_score"))
    end = float(np.log10((texts + 0.1) / whole))
    out = part.drop("rare", "times", "far", "far_times").withColumn("__k", F.struct("row")).join(more, "__k", "left").join(other, "__k", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(texts > 0))).cast("long").alias("n_known"),
                      F.lit(int(total)).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + F.lit(end)).alias("base_score"),
                      (F.col("near") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
