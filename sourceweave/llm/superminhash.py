"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document is the set of its distinct five-word shingles. SuperMinHash gives
each shingle a random permutation of the signature's places and a rank that
grows along it, so ranks of one element are correlated and the signature varies
less than with independent hashes; an element stops as soon as its next rank
cannot improve any place. Signatures are cut into bands; documents that agree in
a band are candidates, and a link counts only when the full sets agree.

No bucket is expanded into pairs. Equal sets collapse to one node first. Then
every node is compared with the most central node it shares a bucket with;
components of these links close nearly all buckets. The nodes of buckets that
still hold several components go through an exact set-similarity join (rarest
elements first; prefix, length and positional filters), which leaves out pairs
within one component and finds every other link there is among them.

With 36 bands of 7, a pair of similarity 0.85 shares no band with probability
9e-7; one of similarity 0.3 is a candidate with probability 0.008.
Shingles, sets and nodes are 64-bit hashes.

Defined results: lower-casing covers A-Z only; a text with fewer words than a
shingle is one shingle; null, empty or blank texts have no set and link with
nothing; repeated rows are members like any other and share component_id, the
least id of the component. Extra columns are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourceweave.llm.common import LOWER, SPACE, Roller, chunks, mix, runs, signed, stored
from sourceweave.llm.components import components

SHINGLE, BANDS, ROWS, PERCENT = 5, 36, 7, 85
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_MASK = 2**64 - 1
#: elements whose permutations are in memory at once; one takes a byte per place
_BLOCK = 40_000
#: slots on which elements are counted for the order of prefixes, and the step of set size classes
SLOTS, CLASS_STEP = 1 << 20, 1.03


def _level(elements: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank fraction (32 bits) and place drawn by each element at step j of its permutation."""
    x = mix(elements + _U(int(_GOLD) * (j + 1) & _MASK))
    return x >> _U(32), j + (((x & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32)).astype(np.int64)


def signatures(elements: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signature of each set; set d is elements[first[d]:first[d+1]], m at most 256 places."""
    docs = len(first) - 1
    h = np.full((docs, m), np.iinfo(np.uint64).max, _U)
    flat = h.reshape(-1)
    doc = np.repeat(np.arange(docs), np.diff(first))
    rank, place = _level(elements, 0, m)
    np.minimum.at(flat, doc * m + place, rank)
    open_docs = np.flatnonzero((h >= _U(1) << _U(32)).any(axis=1) & (np.diff(first) > 0))
    at = 0
    while at < len(open_docs):  # blocks of sets whose places are not all settled by the first step
        sizes = np.cumsum(np.diff(first)[open_docs[at:]])
        end = at + max(1, int(np.searchsorted(sizes, _BLOCK, "right")))
        mine = np.concatenate([np.arange(first[d], first[d + 1]) for d in open_docs[at:end]])
        at = end
        el, d, rows = elements[mine], doc[mine], np.arange(len(mine))
        perm = np.tile(np.arange(m, dtype=np.uint8), (len(mine), 1))
        k = place[mine]
        perm[rows, k] = 0
        perm[rows, 0] = k.astype(np.uint8)
        for j in range(1, m):
            go = (h >= _U(j) << _U(32)).any(axis=1)[d]  # early stop: the next ranks are j or more
            if not go.all():
                el, d, perm = el[go], d[go], perm[go]
                rows = rows[: len(el)]
            if not len(el):
                break
            rank, k = _level(el, j, m)
            drawn = perm[rows, k]
            perm[rows, k] = perm[:, j]
            np.minimum.at(flat, d * m + drawn, rank | (_U(j) << _U(32)))
    return h


def shingle_sets(data: np.ndarray, offs: np.ndarray, roll: Roller, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents one after another, index of each document's first)."""
    low = LOWER[data]
    s, e, first = runs(~SPACE[low], offs)
    words = roll.spans(roll.sums(low), s, e)
    gram = words[: max(len(words) - size + 1, 0)].copy()
    for k in range(1, size):
        gram = gram * _GOLD + words[k : k + len(gram)]
    gram = mix(gram)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(gram[a : b - size + 1]))
        elif b > a:
            x = b - a
            for w in words[a:b].tolist():
                x = (x * int(_GOLD) + w) & _MASK
            sets.append(mix(np.array([x], _U)))
        else:
            sets.append(np.zeros(0, _U))
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def set_ids(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash per set, the same for equal sets."""
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(elements ^ _U(0xA5A5A5A5A5A5A5A5)), dtype=_U)])
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(_U) * _GOLD)


def _sketch(size: int, bands: int, rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller(5)
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column("__text")):
                el, first = shingle_sets(data, offs, roll, size)
                sig = signatures(el, first, bands * rows).reshape(hi - lo, bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=_U) + _U(1), (hi - lo, bands)).copy()
                for r in range(rows):
                    key = key * _GOLD + sig[:, :, r]
                n = np.diff(first)
                key = signed(mix(key))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32), key[n > 0].reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("row").slice(lo, hi - lo), pa.array(n),
                     pa.array(signed(set_ids(el, first)), mask=n == 0), lists], names=["doc_id", "row", "n_shingles", "node", "bands"])

    return work


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: those of keys that occur twice or more; state is one row."""
    held = None  # last row and whether it is out
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in ("key", "node", "n")]
        out = np.zeros(len(cols[0]), bool)
        if held is not None:
            cols = [np.concatenate([[h], x]) for h, x in zip(held[0], cols)]
            out = np.concatenate([[held[1]], out])
        like = np.zeros(len(out) + 1, bool)
        like[1:-1] = cols[0][1:] == cols[0][:-1]
        many = like[1:] | like[:-1]
        give = many & ~out
        held = [x[-1] for x in cols], bool(many[-1] or out[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[give]) for x in cols], names=["key", "node", "n"])


def _sets(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller(5)
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column("__text")):
                el, first = shingle_sets(data, offs, roll, size)
                want = batch.column("node").slice(lo, hi - lo).to_numpy()
                same = signed(set_ids(el, first)) == want
                values = pa.array([el[first[i] : first[i + 1]].tobytes() if same[i] else None for i in range(hi - lo)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(want), values], names=["node", "elements"])

    return work


def _agree(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                a, b = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return work


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(_agree(percent), "a long, b long")


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many elements of the task's sets fall on each of a fixed number of slots."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for x in batch.column("elements"):
            np.add.at(total, (np.frombuffer(x.as_buffer(), _U) % _U(SLOTS)).astype(np.int64), 1)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "c"])


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / np.log(CLASS_STEP) + 1e-9).astype(np.int64)


def prefix_rows(elements: np.ndarray, rank: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """((size class, prefix length) of the smaller sets a set looks for, its elements in order, rarest first)."""
    n = len(elements)
    t = percent / 100
    ordered = elements[np.lexsort((elements, rank))]
    classes = []
    for c in range(int(size_class(np.array([max(np.ceil(t * n), 1)]))[0]), int(size_class(np.array([n]))[0]) + 1):
        least = max(int(np.ceil(CLASS_STEP**c - 1e-6)), int(np.ceil(t * n - 1e-9)), 1)
        if least <= n:
            classes.append((c, n - int(np.ceil(t / (1 + t) * (n + least) - 1e-9)) + 1))
    return classes, ordered


def _prefixes(percent: int, sent):
    """Rows (key, probe, node, comp, n, at): a set under the classes of smaller sets it looks for, and under its own to be found."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, t = sent.value, percent / 100
        names = ["key", "probe", "node", "comp", "n", "at"]
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            held = 0
            for x, node, comp in zip(batch.column("elements"), batch.column("node").to_pylist(), batch.column("comp").to_pylist()):
                el = np.frombuffer(x.as_buffer(), _U)
                n = len(el)
                classes, ordered = prefix_rows(el, counts[(el % _U(SLOTS)).astype(np.int64)], percent)
                own = int(size_class(np.array([n]))[0])
                for probe, c, length in [*((True, c, k) for c, k in classes), (False, own, n - int(np.ceil(2 * t / (1 + t) * n - 1e-9)) + 1)]:
                    k = min(length, n)
                    key = signed(mix(ordered[:k] ^ mix(np.array([c], _U))))
                    held += k
                    for col, v in zip(out, (key, np.full(k, probe), np.full(k, node), np.full(k, comp), np.full(k, n), np.arange(k))):
                        col.append(v)
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=names)
                    out, held = [[] for _ in names], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=names)

    return work


def _rest(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different components among ``held`` (node, comp) sets: an exact set-similarity join.

    Elements are ordered by how many sets hold them (counted on a fixed number of slots, so the table of counts has a
    fixed size; any order gives the same links). Sets similar enough share an element of their prefixes.
    """
    mine = sets.join(held, "node").select("node", "comp", "elements")
    got = mine.mapInArrow(_slots, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[got["slot"].to_numpy()] = got["c"].to_numpy()
    sent = held.sparkSession.sparkContext.broadcast(counts)
    rows = stored(mine.mapInArrow(_prefixes(percent, sent), "key long, probe boolean, node long, comp long, n long, at long"), "prefixes")
    # a key whose sets are all of one component joins nothing; of the others, the largest component is met by the rest only
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    mains = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("c", "comp")).alias("main")).where("comps > 1")
    live = rows.withColumn("__k", F.struct("key")).join(mains.select(F.struct("key").alias("__k"), "main"), "__k").drop("__k")
    small = live.where("NOT probe").select("key", F.col("node").alias("b"), F.col("comp").alias("bc"), F.col("n").alias("bn"), F.col("at").alias("bt"), (F.col("comp") == F.col("main")).alias("bm"))
    large = live.where("probe").select("key", F.col("node").alias("a"), F.col("comp").alias("ac"), F.col("n").alias("an"), F.col("at").alias("at"), (F.col("comp") == F.col("main")).alias("am"))
    able = F.expr(f"ac <> bc AND an >= bn AND 100 * bn >= {percent} * an AND {100 + percent} * least(an - at, bn - bt) >= {percent} * (an + bn)")
    one = large.where("NOT am").join(small, "key").where(able)
    two = large.where("am").join(small.where("NOT bm"), "key").where(able)
    return one.unionByName(two).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def links(scan: DataFrame, docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(verified links (a, b) between nodes, nodes (node, row, doc_id)) of a sketch table."""
    nodes = scan.where("node IS NOT NULL").groupBy("node").agg(
        F.min("row").alias("row"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    rows = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = stored(rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, "key long, node long, n long"), "buckets")
    # a bucket's pivot is its most central node: the one with the most company in all its buckets
    company = shared.groupBy("key").agg(F.count(F.lit(1)).alias("c")).select(F.struct("key").alias("__k"), "c")
    weight = shared.withColumn("__k", F.struct("key")).join(company, "__k").groupBy("node").agg(F.sum("c").alias("w"), F.first("n").alias("n"))
    weight = stored(weight, "weights")
    met = shared.select("key", "node").join(weight, "node").select("key", "node", "n", "w")
    pivots = met.groupBy("key").agg(F.max(F.struct("w", "node", "n")).alias("p")).select(F.struct("key").alias("__k"), F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.w").alias("pw"))
    led = stored(shared.withColumn("__k", F.struct("key")).join(pivots, "__k").select("key", "node", "n", "pivot", "pn", "pw"), "led")
    # full sets of the nodes that share a bucket: one row of the table stands for each
    wanted = nodes.select("node", F.col("row").alias("__row")).join(weight.select("node"), "node", "left_semi")
    found = docs.join(wanted, F.col("row") == F.col("__row")).select("node", "__text")
    sets = stored(found.mapInArrow(_sets(size), "node long, elements binary").where("elements IS NOT NULL").groupBy("node").agg(
        F.first("elements").alias("elements")), "sets")
    # first round: each node with the most central pivot of its buckets that its size allows
    fits = F.expr(f"node <> pivot AND 100 * least(n, pn) >= {percent} * greatest(n, pn)")
    first = led.where(fits).groupBy("node").agg(F.max(F.struct("pw", "pivot")).alias("p")).select(F.col("node").alias("a"), F.col("p.pivot").alias("b"))
    one = stored(_verified(first, sets, percent), "links")
    label = components(one)
    # second round: nodes of buckets in which several components are left
    named = led.select("key", "node").join(label.select(F.col("id").alias("node"), "root"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    named = stored(named, "members")
    open_ = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select(F.struct("key").alias("__k"))
    held = stored(named.withColumn("__k", F.struct("key")).join(open_, "__k").select("node", "comp").distinct(), "open")
    two = stored(_verified(_rest(held, sets, percent), sets, percent), "links")
    return one.unionByName(two), nodes.select("node", "row", "doc_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, size: int = SHINGLE,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id) and row (a hash of id and text) of every row."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    scan = stored(src.mapInArrow(_sketch(size, bands, rows), f"doc_id {id_type}, row long, n_shingles long, node long, bands array<long>"), "sketch")
    edges, nodes = links(scan, src, percent, size)
    root = components(edges)
    named = nodes.join(root, nodes.node == root.id, "left").select("node", F.coalesce("root", "node").alias("root"), "doc_id")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    whole = named.withColumn("__k", F.struct("root")).join(least.select(F.struct("root").alias("__k"), "component_id"), "__k").select(
        F.struct("node").alias("__n"), "component_id")
    out = scan.select("doc_id", "row", "n_shingles", F.struct("node").alias("__n")).join(whole, "__n", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "row")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "row")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that stand for their group: those whose id is the component's least, equal rows once.

    Rows without an id are never dropped for another row's sake.
    """
    named = near_duplicates(docs, text, doc_id, **how)
    stay = named.where("kept").select(F.struct("row").alias("__k")).distinct()
    mine = docs.withColumn("__k", F.struct(F.xxhash64(doc_id, text))).join(stay, "__k", "left_semi")
    first = F.row_number().over(Window.partitionBy("__k").orderBy("__k"))  # follows the join's order: no further sort or shuffle
    return mine.withColumn("__first", first).where(F.col(doc_id).isNull() | (F.col("__first") == 1)).select(*docs.columns)
