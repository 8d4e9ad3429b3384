"""Removal of repeated byte strings by external induced suffix sorting.

A byte is removed when a string of ``length`` bytes over it also starts anywhere
else. Every such string has a designated anchor, its least ``gram``-byte hash;
equal strings have equal anchors at equal places. So the positions of the corpus
fall apart into shards by anchor hash, and only shards that hold two or more
different contexts of one anchor need sorting: a run of positions with one anchor
whose whole context stands elsewhere is repeated as it is, and an anchor found
once is not repeated at all.

A shard is sorted by induced sorting: suffixes are typed, those at the left end
of an increasing run are sorted by recursion on their names, and two passes over
the symbols' queues induce the order of all others from them. The queues are
first-in first-out per symbol, which is the priority order; they move to an
unlinked file of the task when they outgrow memory, and hold (position, name of
what follows) tuples only. Neighbours in the order whose common-prefix value
reaches ``length`` are both repeated.

Copies met in the same chunk of a scan are folded before the shuffle, so a
passage that a third of all texts share reaches its shard a few times per task.

Defined results: null and empty texts have no bytes, no spans and the digest of
the empty string; texts shorter than ``length`` are kept whole; matches never
cross texts; equal rows are copies of each other. Texts, anchors and contexts are
compared by 64-bit hashes before sorting.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceweave.llm.common import Roller, binary_parts, chunks, signed, stored

LENGTH, GRAM = 200, 50
#: bytes of contexts sorted at a time, and queue entries held in memory
SHARD_BYTES, QUEUE_ENTRIES = 4 << 20, 4 << 20
_SEED = 12


# ---- induced sorting ----


class SymbolQueues:
    """First-in first-out queues of positions by symbol; the oldest entries wait on disk when there are too many."""

    def __init__(self, symbols: int, limit: int = QUEUE_ENTRIES):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.held, self.limit, self.file = 0, limit, None

    def push(self, keys: np.ndarray, values: np.ndarray) -> None:
        if not len(values):
            return
        order = np.argsort(keys.astype(np.uint16), kind="stable")  # small symbols sort by radix
        keys, values = keys[order], values[order]
        cut = np.flatnonzero(np.diff(keys)) + 1
        for part, at in zip(np.split(values, cut), [0, *cut.tolist()]):
            self.parts[keys[at]].append(part)
        self.held += len(values)
        if self.held > self.limit:
            self._to_disk()

    def _to_disk(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for queue in self.parts:
            for i, part in enumerate(queue):
                if isinstance(part, np.ndarray):
                    at = self.file.tell()
                    part.tofile(self.file)
                    queue[i] = (at, len(part))
        self.held = 0

    def pop(self, symbol: int) -> np.ndarray:
        """All that waits under a symbol, oldest first."""
        out = []
        for part in self.parts[symbol]:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.fromfile(self.file, np.int64, part[1])
            else:
                self.held -= len(part)
            out.append(part)
        self.parts[symbol] = []
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def rising(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is less than the one after it (the end counts as least)."""
    n = len(text)
    up = np.zeros(n, bool)
    up[:-1] = text[:-1] < text[1:]
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    at = np.where(differs, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return up[np.minimum(nearest, n - 1)]


def induce(text: np.ndarray, up: np.ndarray, seeds: np.ndarray, symbols: int, limit: int) -> np.ndarray:
    """Order of all suffixes from the given order of the leftmost rising ones."""
    falling, order_l = SymbolQueues(symbols, limit), SymbolQueues(symbols, limit)
    first = SymbolQueues(symbols, limit)
    first.push(text[seeds], seeds)
    last = len(text) - 1
    if not up[last]:
        falling.push(text[[last]], np.array([last]))

    def before(here: np.ndarray, want: bool) -> np.ndarray:
        here = here[here > 0] - 1
        return here[up[here] == want]

    for c in range(symbols):
        now = falling.pop(c)
        while len(now):
            order_l.push(np.full(len(now), c), now)
            got = before(now, False)
            same = text[got] == c
            falling.push(text[got[~same]], got[~same])
            now = got[same]
        got = before(first.pop(c), False)
        falling.push(text[got], got)
    climbing, out = SymbolQueues(symbols, limit), []
    for c in reversed(range(symbols)):
        now = climbing.pop(c)
        while len(now):
            out.append(now)
            got = before(now, True)
            same = text[got] == c
            climbing.push(text[got[~same]], got[~same])
            now = got[same]
        lower = order_l.pop(c)[::-1]
        out.append(lower)
        got = before(lower, True)
        climbing.push(text[got], got)
    return np.concatenate(out)[::-1] if out else np.zeros(0, np.int64)


def ranked(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, to ``depth`` names, by doubling tuples (name, name of what follows)."""
    step = 1
    while step < depth:
        after = np.full(len(names), -1, np.int64)
        after[:-step] = names[step:] if step < len(names) else after[:-step]
        _, new = np.unique(names * (len(names) + 1) + after + 1, return_inverse=True)
        if new.max(initial=0) == len(names) - 1 or step >= len(names):
            names = new
            break
        names, step = new, step * 2
    return np.argsort(names, kind="stable")


def suffix_order(text: np.ndarray, symbols: int, depth: int = LENGTH, limit: int = QUEUE_ENTRIES) -> np.ndarray:
    """Start positions of all suffixes in order of their first ``depth`` symbols."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    up = rising(text)
    left = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    if len(left) > 1:
        # names: leftmost rising substrings in induced order, equal ones under one name
        order = induce(text, up, left, symbols, limit)
        mark = np.zeros(n, bool)
        mark[left] = True
        order = order[mark[order]]
        end = np.append(left[1:] + 1, n)
        size = np.zeros(n, np.int64)
        size[left] = end - left
        roll = _roller()
        sums = roll.sums_of(text)
        h = roll.spans(sums, order, order + size[order])
        new = np.ones(len(order), np.int64)
        new[1:] = h[1:] != h[:-1]
        name = np.zeros(n, np.int64)
        name[order] = np.cumsum(new) - 1
        string = name[left]
        left = left[ranked(string, depth) if string.max() < len(string) - 1 else np.argsort(string)]
    return induce(text, up, left, symbols, limit)


class _SymbolRoller(Roller):
    """Range hashes over symbols beyond bytes."""

    def sums_of(self, text: np.ndarray) -> np.ndarray:
        from sourceweave.llm.common import mix

        self._powers(len(text) + 1)
        out = np.zeros(len(text) + 1, np.uint64)
        symbols = mix(np.arange(int(text.max(initial=0)) + 1, dtype=np.uint64) + np.uint64(77))
        np.cumsum(symbols[text] * self.up[: len(text)], out=out[1:])
        return out


_ROLL: list[_SymbolRoller] = []


def _roller() -> _SymbolRoller:
    if not _ROLL:
        _ROLL.append(_SymbolRoller(_SEED))
    return _ROLL[0]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common-prefix value of each suffix with the one before it in order, cut at ``depth``."""
    roll, n = _roller(), len(text)
    sums = roll.sums_of(text)
    a, b = order[1:], order[:-1]
    low = np.zeros(len(a), np.int64)
    high = np.minimum(depth, n - np.maximum(a, b))
    while True:  # binary search on range hashes: equal ranges have equal hashes
        go = low < high
        if not go.any():
            return np.concatenate([[0], low])
        mid = np.where(go, (low + high + 1) // 2, low)
        same = roll.spans(sums, a, a + mid) == roll.spans(sums, b, b + mid)
        low = np.where(same, mid, low)
        high = np.where(same, high, mid - 1)


def agree(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether the common-prefix value of each suffix with the one before it in order reaches ``depth``."""
    roll, n = _roller(), len(text)
    a, b = order[1:], order[:-1]
    out = np.zeros(n, bool)
    at = np.flatnonzero(np.maximum(a, b) + depth <= n)
    sums = roll.sums_of(text)
    whole = roll.spans(sums, np.arange(max(n - depth + 1, 0)), np.arange(max(n - depth + 1, 0)) + depth)
    out[at + 1] = whole[a[at]] == whole[b[at]]
    return out


def repeated_starts(segments: list[bytes], length: int = LENGTH, limit: int = QUEUE_ENTRIES) -> list[np.ndarray]:
    """Per segment the starts of its ``length``-byte strings that also start elsewhere in the segments."""
    # 0 ends a segment, bytes are 1 to 256; a string never reaches over an end, as it is shorter than what it would need
    size = np.array([len(s) + 1 for s in segments])
    first = np.concatenate([[0], np.cumsum(size)])
    text = np.zeros(int(first[-1]), np.uint16)
    inside = np.ones(len(text), bool)
    inside[first[1:] - 1] = False
    text[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint16) + 1
    order = suffix_order(text, 257, length, limit)
    full = agree(text, order, length)
    found = np.zeros(len(text), bool)
    found[order[full]] = True
    found[order[np.flatnonzero(full) - 1]] = True
    out = []
    for a, n in zip(first[:-1].tolist(), size.tolist()):
        out.append(np.flatnonzero(found[a : a + max(n - length, 0)]))
    return out


# ---- shards by anchor ----


def _anchors(length: int, gram: int):
    width = length - gram + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller(_SEED)
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for lo, hi, data, offs in chunks(batch.column("__text")):
                n = len(data)
                if n < length:
                    continue
                sums = roll.sums(data)
                at = np.arange(n - gram + 1)
                h = roll.spans(sums, at, at + gram)
                # least gram of each string: hash above, place below, so ties go to the leftmost
                packed = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
                pad = -len(packed) % width
                tiles = np.concatenate([packed, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
                down = np.minimum.accumulate(tiles, axis=1).reshape(-1)
                back = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].reshape(-1)
                starts = n - length + 1
                place = (np.minimum(back[:starts], down[width - 1 : width - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                doc = np.repeat(np.arange(hi - lo), np.diff(offs))[:starts]
                ok = np.arange(starts) + length <= offs[1:][doc]
                here = np.flatnonzero(ok)
                if not len(here):
                    continue
                new = np.ones(len(here), bool)
                new[1:] = (place[here[1:]] != place[here[:-1]]) | (doc[here[1:]] != doc[here[:-1]])
                s = here[new]
                e = here[np.append(np.flatnonzero(new)[1:] - 1, len(here) - 1)]
                key, context, who = h[place[s]], roll.spans(sums, s, e + length), doc[s]
                begin = offs[:-1][who]
                # contexts met twice in this chunk: all are repeated, one goes on for the others' sake
                order = np.lexsort((context, key))
                k, g = key[order], context[order]
                head = np.ones(len(order), bool)
                head[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
                group = np.cumsum(head) - 1
                twice = np.bincount(group)[group] > 1
                rep = order[head]
                kind = np.where(twice[head], 2, 1)
                dup = np.sort(order[twice])
                if len(dup):  # repeated contexts of one text that touch become one range
                    ds, de = s[dup], e[dup] + length
                    cut = np.ones(len(dup), bool)
                    cut[1:] = (who[dup[1:]] != who[dup[:-1]]) | (ds[1:] > de[:-1])
                    a, b = ds[cut], de[np.append(np.flatnonzero(cut)[1:] - 1, len(dup) - 1)]
                    w = who[dup[cut]]
                    r = rows[lo + w]
                    yield _rows(np.zeros(len(a), np.int32), r, r, r, a - offs[:-1][w], b - offs[:-1][w])
                yield _rows(kind.astype(np.int32), signed(key[rep]), signed(context[rep]), rows[lo + who[rep]], (s - begin)[rep], (e - begin)[rep])

    return work


_NAMES = ["kind", "key", "context", "row", "a", "b"]
_SCHEMA = "kind int, key long, context long, row long, a long, b long"


def _rows(*cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_NAMES)


def _sift(length: int):
    """Rows sorted by anchor and context. Kind 0 comes out for every repeated range, kinds 1 and 2 for one row of
    each context of an anchor that has several (2: known to be repeated). State is one row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # last row, its weight, whether its range is out, whether its anchor has other contexts
        for batch in batches:
            cols = {c: batch.column(c).to_numpy() for c in _NAMES}
            done = cols["kind"] == 0
            if done.any():
                yield batch.filter(pa.array(done))
                cols = {c: x[~done] for c, x in cols.items()}
            if not len(cols["key"]):
                continue
            weight, out, multi = cols["kind"].astype(np.int64), cols["kind"] == 2, False
            if held is not None:
                last, w, o, multi = held
                cols = {c: np.concatenate([[last[c]], x]) for c, x in cols.items()}
                weight, out = np.concatenate([[w], weight]), np.concatenate([[o], out])
            n = len(weight)
            head_key, head = np.ones(n, bool), np.ones(n, bool)
            head_key[1:] = cols["key"][1:] != cols["key"][:-1]
            head[1:] = head_key[1:] | (cols["context"][1:] != cols["context"][:-1])
            run = np.cumsum(head) - 1
            total = np.bincount(run, weights=weight)
            again = (total[run] > 1) & ~out
            if again.any():
                yield _rows(np.zeros(int(again.sum()), np.int32), *[cols[c][again] for c in ("row", "row", "row", "a")], cols["b"][again] + length)
            first = np.flatnonzero(head)
            family = (np.cumsum(head_key) - 1)[first]
            many = np.bincount(family)[family] > 1
            many[family == 0] |= multi
            tell = many.copy()
            tell[-1] = False  # its weight may still grow
            at = first[tell]
            if len(at):
                yield _rows(np.where(total[tell] > 1, 2, 1).astype(np.int32), *[cols[c][at] for c in _NAMES[1:]])
            z = first[-1]
            held = {c: x[z] for c, x in cols.items()}, min(int(total[-1]), 2), bool(total[-1] > 1), bool(many[-1])
        if held is not None and held[3]:
            last, w, _, _ = held
            yield _rows(np.array([2 if w > 1 else 1], np.int32), *[np.array([last[c]]) for c in _NAMES[1:]])

    return work


def _contexts(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = binary_parts(batch.column("__text"))
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            parts = [data[o + x : o + y + length].tobytes() for o, x, y in zip(offs[:-1].tolist(), a.tolist(), b.tolist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("kind", "key", "row", "a")], pa.array(parts, pa.binary())], names=["kind", "key", "row", "a", "bytes"])

    return work


def _sorted_shards(length: int, shard_bytes: int, limit: int):
    """Rows sorted by anchor, whole anchors gathered up to about ``shard_bytes``; kind 0 comes out for what is repeated."""

    def ranges(shard: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(shard) < 2:
            return
        rows, starts, ends = [], [], []
        for (_, kind, row, a, _), at in zip(shard, repeated_starts([x[4] for x in shard], length, limit)):
            if kind == 2 or not len(at):
                continue  # known already, or nothing found
            cut = np.flatnonzero(np.diff(at) > length) + 1
            for part in np.split(at, cut):
                rows.append(row)
                starts.append(a + int(part[0]))
                ends.append(a + int(part[-1]) + length)
        if rows:
            r = np.array(rows, np.int64)
            yield _rows(np.zeros(len(r), np.int32), r, r, r, np.array(starts, np.int64), np.array(ends, np.int64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = [], 0
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "row", "a", "bytes"))):
                if size > shard_bytes and x[0] != shard[-1][0]:
                    yield from ranges(shard)
                    shard, size = [], 0
                shard.append(x)
                size += len(x[4])
        yield from ranges(shard)

    return work


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = binary_parts(batch.column("__text"))
        out = []
        for lo, hi, ranges in zip(offs[:-1].tolist(), offs[1:].tolist(), batch.column("ranges").to_pylist()):
            spans: list[list[int]] = []
            for r in sorted((r["a"], r["b"]) for r in ranges or ()):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            kept, at = [], lo
            for a, b in spans:
                kept.append(data[at : lo + a])
                at = lo + b
            kept.append(data[at:hi])
            out.append((hi - lo, sum(b - a for a, b in spans), len(spans), b"".join([k.tobytes() for k in kept])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([o[i] for o in out], pa.int64()) for i in range(3)], pa.array([o[3] for o in out], pa.binary())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, limit: int = QUEUE_ENTRIES) -> DataFrame:
    """(row, a, b): ranges of bytes under repeated strings; ``docs`` has row and __text."""
    rows = docs.select("row", "__text").mapInArrow(_anchors(length, gram), _SCHEMA)
    sifted = stored(rows.repartition("key").sortWithinPartitions((F.col("kind") == 0), "key", "context").mapInArrow(_sift(length), _SCHEMA), "sifted")
    open_ = sifted.where("kind > 0").select("kind", "key", F.col("row").alias("__row"), "a", "b")
    joined = docs.join(open_, F.col("row") == F.col("__row")).select("kind", "key", "row", "a", "b", "__text")
    shards = joined.mapInArrow(_contexts(length), "kind int, key long, row long, a long, bytes binary").repartition("key").sortWithinPartitions("key")
    found = shards.mapInArrow(_sorted_shards(length, shard_bytes, limit), _SCHEMA)
    return sifted.where("kind = 0").select("row", "a", "b").unionByName(found.select("row", "a", "b"))


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) of every row."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    ranges = repeats(src, length, **how).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("ranges")).select(F.struct("row").alias("__k"), "ranges")
    joined = src.withColumn("__k", F.struct("row")).join(ranges, "__k", "left").select("doc_id", "__text", "ranges")
    id_type = src.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
