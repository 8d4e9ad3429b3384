"""SentencePiece encoding and decoding by a lattice over the corpus's different units.

A text gets a leading space; every unit is an optional space and a run of
letters, one digit, or a run of other characters (a run is cut every
``LONGEST`` code points). Only the different units of the corpus are encoded,
dealt to tasks by themselves. The edges of a block of units are laid by a trie
of all pieces and swept by the place where they end: every place keeps its best
score (greatest sum; ties: the longer last piece) and the edge that gave it, and
ids are spelled once, on the way back. Characters without a piece become byte tokens.

Units then meet the texts again. The table of units is sent to the scan as
hashes and packed ids while it has at most ``table_units`` rows, the most spread
ones first; units beyond it are joined as rows, so the result is the same. Units
are known by 64-bit hashes in the first case and by themselves in the second.

The pieces come from a SentencePiece model file. For a model of merges, whose
scores are ranks, the score of a piece is taken from Zipf's law as -ln(rank + 10).
Decoding joins the bytes of the pieces and drops the leading space; it restores
every text exactly, including runs of spaces, line feeds and a literal U+2581.

Defined results: a null text has null ids and decodes to null; an empty text has
no ids; an empty table gives no rows. Rows are encoded one by one, so copies need
no rule; a long text is cut into units like any other. Only ``carry`` columns are
kept; they may not be called ids or round_trip, nor begin with two underscores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceweave.llm.common import Roller, binary_parts, chunks, ragged, stored
from sourceweave.llm.prefix_bpe import Lookup

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONGEST = 32
#: units whose ids are sent to the scan: about 20 bytes each
TABLE_UNITS = 1 << 22
#: units of one task
PART_UNITS = 1 << 14
#: bytes of units whose edges are laid together: about 200 bytes each
BLOCK_BYTES = 1 << 17
_SEED = 9
_HOLD = 1 << 21
#: 0 space, 1 letter (and all of non-ASCII), 2 digit, 3 other
_CLASS = np.full(256, 3, np.uint8)
_CLASS[32] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2


def vocabulary(model: str = MODEL) -> tuple[list[tuple[str, int, float]], list[bytes], list[int], float]:
    """(pieces with id and score, bytes of every id, ids of the 256 byte tokens, score of a byte token)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    ranks = all(float(sp.get_score(i)).is_integer() for i in range(n))
    pieces, raw, byte = [], [], [0] * 256
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte[int(p[3:5], 16)] = i
            raw.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            text = p.replace("▁", " ")
            raw.append(text.encode())
            pieces.append((text, i, -math.log(10 - sp.get_score(i)) if ranks else float(sp.get_score(i))))
    return pieces, raw, byte, min(s for _, _, s in pieces) - 10


def spaced(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text that is not empty with a space before it."""
    size = np.diff(offs)
    more = np.concatenate([[0], np.cumsum(size > 0)])
    out = np.empty(len(data) + int(more[-1]), np.uint8)
    front = (offs[:-1] + more[:-1])[size > 0]
    rest = np.ones(len(out), bool)
    rest[front] = False
    out[front], out[rest] = 32, data
    return out, offs + more


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of each document's first unit) of spaced texts."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    kind = _CLASS[data]
    start = np.ones(n, bool)
    start[1:] = (kind[1:] == 0) | (((kind[1:] == 2) | (kind[1:] != kind[:-1])) & (kind[:-1] != 0))
    start[offs[:-1][np.diff(offs) > 0]] = True
    s = np.flatnonzero(start)
    e = np.append(s[1:], n)
    long = np.flatnonzero(e - s > LONGEST)
    if len(long):
        cuts = []
        for a, b in zip(s[long].tolist(), e[long].tolist()):
            points = np.flatnonzero((data[a:b] & 0xC0) != 0x80)
            cuts.append(a + points[LONGEST::LONGEST])
        s = np.sort(np.concatenate([s, *cuts]))
        e = np.append(s[1:], n)
    return s, e, np.searchsorted(s, offs)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of a task, each about once."""
    roll, seen = Roller(_SEED), np.zeros(0, np.uint64)
    for batch in batches:
        for _, _, data, offs in chunks(batch.column("__text")):
            data, offs = spaced(data, offs)
            s, e, _ = units(data, offs)
            if not len(s):
                continue
            h, at = np.unique(roll.spans(roll.sums(data), s, e), return_index=True)
            if len(seen):
                new = seen[np.minimum(np.searchsorted(seen, h), len(seen) - 1)] != h
                h, at = h[new], at[new]
            seen = np.sort(np.concatenate([seen, h])) if len(seen) < _HOLD else h
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(s[at].tolist(), e[at].tolist())], pa.string())], names=["unit"])


class _Trie:
    """All pieces by their bytes: ``children`` by node and byte, id and score of the piece that ends in a node (id -1: none)."""

    def __init__(self, pieces: list[tuple[str, int, float]]):
        nodes, self.longest = {}, 4
        ends = []
        for piece, i, score in pieces:
            node, raw = 0, piece.encode()
            for c in raw:
                node = nodes.setdefault(node << 8 | c, len(nodes) + 1)
            ends.append((node, i, score))
            self.longest = max(self.longest, len(raw))
        self.children = Lookup(18)
        self.children.put(np.fromiter(nodes, np.uint64, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes)))
        self.id, self.score = np.full(len(nodes) + 1, -1, np.int64), np.zeros(len(nodes) + 1)
        for node, i, score in ends:
            if node:  # a piece without bytes stands nowhere
                self.id[node], self.score[node] = i, score

    def edges(self, data: np.ndarray, stop: np.ndarray, byte_score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, bytes, id, score) of every edge of units that lie one behind the other; ``stop`` is the end of each byte's unit.

        A character that is no piece has an edge with the id -1.
        """
        head = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(head, len(data)))
        single = np.zeros(len(head), bool)
        out, at, node, depth = [], np.arange(len(head)), np.zeros(len(head), np.uint64), 0
        while len(at):
            node = self.children.get(node << np.uint64(8) | data[head[at] + depth])
            at, node = at[node >= 0], node[node >= 0]
            depth += 1
            i = self.id[node]
            piece = i >= 0
            out.append((head[at[piece]], np.full(int(piece.sum()), depth), i[piece], self.score[node[piece]]))
            single[at[piece & (width[at] == depth)]] = True
            more = head[at] + depth < stop[head[at]]
            at, node = at[more], node[more].astype(np.uint64)
        bare = ~single
        out.append((head[bare], width[bare], np.full(int(bare.sum()), -1), byte_score * width[bare]))
        return tuple(np.concatenate([o[k] for o in out]) for k in range(4))


@lru_cache(maxsize=1)
def _trie(pieces: tuple[tuple[str, int, float], ...]) -> _Trie:
    return _Trie(list(pieces))


def _best(trie: _Trie, byte: np.ndarray, byte_score: float, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the best paths of all units, offsets): edges are met by the place they end at, so what they start from is settled."""
    size, n = np.diff(offs), len(offs) - 1
    of = np.repeat(np.arange(n), size)
    begin, width, i, score = trie.edges(data, offs[1:][of], byte_score)
    unit = of[begin]
    start = begin + unit  # a unit has one place more than bytes
    end, place = start + width, begin - offs[unit] + width
    order = np.argsort((place * (len(data) + n + 1) + end) * (trie.longest + 1) + trie.longest - width)
    start, end, place, score = start[order], end[order], place[order], score[order]
    total, edge = np.zeros(len(data) + n + 1), np.zeros(len(data) + n + 1, np.int64)
    cuts = np.searchsorted(place, np.arange(1, int(size.max(initial=0)) + 2))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if lo == hi:
            continue
        to = end[lo:hi]
        groups = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        sums = total[start[lo:hi]] + score[lo:hi]
        top = np.maximum.reduceat(sums, groups)
        total[to[groups]] = top
        # the first of equal sums is the longest piece
        best = np.flatnonzero(sums == np.repeat(top, np.diff(np.append(groups, hi - lo))))
        edge[to[groups]] = lo + best[np.searchsorted(best, groups)]
    on, first = np.zeros(len(total), bool), offs[:-1] + np.arange(n)
    at, floor = (first + size)[size > 0], first[size > 0]
    while len(at):
        on[at] = True
        at = start[edge[at]]
        at, floor = at[at > floor], floor[at > floor]
    path = order[edge[on]]
    many = np.where(i[path] < 0, width[path], 1)
    ids = np.repeat(i[path], many)
    bare = path[i[path] < 0]
    ids[ids < 0] = byte[data[ragged(begin[bare], width[bare])]]
    counts = np.bincount(unit[path], weights=many, minlength=n).astype(np.int64)
    return ids.astype(np.int32), np.concatenate([[0], np.cumsum(counts)])


def lattice(words: DataFrame, pieces: list[tuple[str, int, float]], byte: list[int], byte_score: float) -> DataFrame:
    """(unit, ids): the best path of every row's unit; ``words`` keeps its partitioning, nothing is shuffled."""
    table, number = tuple(pieces), np.array(byte, np.int64)  # as large as the model's file

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(table)
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column("unit"), BLOCK_BYTES):
                ids, ends = _best(trie, number, byte_score, data, offs)
                yield pa.RecordBatch.from_arrays([batch.column("unit").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], names=["unit", "ids"])

    return words.select("unit").mapInArrow(work, "unit string, ids array<int>")


def unit_table(docs: DataFrame, text: str = "text", model: str = MODEL) -> tuple[DataFrame, DataFrame]:
    """(unit, spread) and (unit, ids) of all different units of a text column; spread is the number of tasks that met it."""
    pieces, _, byte, low = vocabulary(model)
    found = docs.select(F.col(text).cast("string").alias("__text")).mapInArrow(_distinct, "unit string").groupBy("unit").agg(F.count(F.lit(1)).alias("spread"))
    found = stored(found, "units")
    parts = max(1, -(-found.count() // PART_UNITS))
    return found, stored(lattice(found.select("unit").repartition(parts, "unit"), pieces, byte, low), "unit-ids")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per batch: hashes, lengths and ids as bytes."""
    roll = Roller(_SEED)
    for batch in batches:
        data, offs = binary_parts(batch.column("unit"))
        base = offs[0]
        data, offs = data[base : offs[-1]], offs - base
        h = roll.spans(roll.sums(data), offs[:-1], offs[1:])
        lists = batch.column("ids")
        n = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy().astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (h, n.astype(np.uint16), flat)], names=["h", "n", "flat"])


def _table(known: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes, first id, number of ids, ids) of (unit, ids) rows."""
    rows = known.select("unit", "ids").mapInArrow(_packed, "h binary, n binary, flat binary").toArrow()
    h, n, flat = ([np.frombuffer(x.as_buffer(), t) for x in rows[c]] for c, t in (("h", np.uint64), ("n", np.uint16), ("flat", np.uint32)))
    small = np.uint16 if max((int(x.max(initial=0)) for x in flat), default=0) < 2**16 else np.uint32
    ids = np.concatenate([np.zeros(0, small), *[x.astype(small) for x in flat]])  # each part shrinks before they are joined
    h, n = np.concatenate([np.zeros(0, np.uint64), *h]), np.concatenate([np.zeros(0, np.uint16), *n])
    del rows, flat
    first = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[:-1]
    order = np.argsort(h)
    return h[order], first[order].astype(np.int64), n[order], ids


def _bytes_table(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, bytes, all bytes) of every id."""
    size = np.array([len(x) for x in raw], np.int64)
    return np.concatenate([[0], np.cumsum(size)])[:-1], size, np.frombuffer(b"".join(raw), np.uint8)


def _restored(ids: np.ndarray, begin: np.ndarray, raw: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(spaced texts of all ids, offsets) of documents whose ids start at ``begin``."""
    first, size, flat = raw
    ends = np.concatenate([[0], np.cumsum(size[ids])])
    return flat[ragged(first[ids], size[ids])], ends[begin]


def _encode(sent, keep: list[str], open_ids: bool, raw: tuple | None = None):
    """Adds ids; with ``raw`` also whether decoding them gives the text back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first_id, count, flat = sent.value
        roll = Roller(_SEED)
        for batch in batches:
            column = batch.column("__text")
            for lo, hi, data, offs in chunks(column):
                data, offs = spaced(data, offs)
                s, e, first = units(data, offs)
                h = roll.spans(roll.sums(data), s, e)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                there = known[at] == h if len(known) else np.zeros(len(h), bool)
                n = np.where(there, count[at], 1).astype(np.int64) if len(known) else np.ones(len(h), np.int64)
                begin = np.concatenate([[0], np.cumsum(n)])
                ids = np.empty(int(begin[-1]), np.int32)
                known_at = np.repeat(there, n)
                if there.any():
                    ids[known_at] = flat[ragged(first_id[at[there]], n[there])]
                # a unit that is not in the table holds the place of its ids: minus its number in the text, minus 1
                number = np.arange(len(s)) - np.repeat(first[:-1], np.diff(first))
                ids[~known_at] = -number[~there] - 1
                void = column.slice(lo, hi - lo).is_null()
                lists = pa.ListArray.from_arrays(pa.array(begin[first].astype(np.int32)), pa.array(ids))
                if void.true_count:
                    lists = pa.array([None if v else x for v, x in zip(void.to_pylist(), lists.to_pylist())], pa.list_(pa.int32()))
                cols = [*[batch.column(c).slice(lo, hi - lo) for c in keep], lists]
                if raw is not None:
                    back, at = _restored(ids, begin[first], raw)
                    good = np.diff(at) == np.diff(offs)
                    if len(back) == len(data) and good.all():
                        good[np.searchsorted(offs, np.flatnonzero(back != data), "right") - 1] = False
                    else:
                        good = np.array([bytes(back[a:b]) == bytes(data[c:d]) for a, b, c, d in zip(at, at[1:], offs, offs[1:])], bool)
                    cols.append(pa.array(good))
                if open_ids:
                    whole, gaps = data.tobytes(), [[] for _ in range(hi - lo)]
                    gone = np.flatnonzero(~there)
                    for d, i in zip((np.searchsorted(first, gone, "right") - 1).tolist(), gone.tolist()):
                        gaps[d].append({"at": int(i - first[d]), "unit": whole[s[i] : e[i]].decode("utf-8", "replace")})
                    cols.append(pa.array(gaps, pa.list_(pa.struct([("at", pa.int32()), ("unit", pa.string())]))))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "ids", *["round_trip"] * (raw is not None), *["gaps"] * open_ids])

    return work


def encode(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", model: str = MODEL, table_units: int = TABLE_UNITS,
           verify: bool = False) -> DataFrame:
    """``carry`` columns and ids (array<int>) of every row; with ``verify`` also round_trip: do they decode to the text?"""
    found, known = unit_table(docs, text, model)
    classes = sorted(((r["c"], r["k"]) for r in found.groupBy(F.least("spread", F.lit(1 << 16)).alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    floor, fit = 1 << 62, 0
    for c, k in classes:
        if fit + k > table_units:
            break
        floor, fit = c, fit + k
    whole = fit == sum(k for _, k in classes)
    top = known if whole else known.join(found.where(F.col("spread") >= floor).select("unit"), "unit", "left_semi")
    sent = docs.sparkSession.sparkContext.broadcast(_table(top))
    keep = list(carry)
    src = docs.select(*carry, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    if whole:
        raw = _bytes_table(vocabulary(model)[1]) if verify else None
        return src.mapInArrow(_encode(sent, keep, False, raw), schema + ", ids array<int>" + ", round_trip boolean" * verify)
    # units beyond the table: rows (text, place, unit), once per different text
    src = src.withColumn("__row", F.xxhash64("__text"))
    keep += ["__text"] * verify
    schema += ", __text string" * verify
    part = src.mapInArrow(_encode(sent, [*keep, "__row"], True), schema + ", __row long, ids array<int>, gaps array<struct<at:int,unit:string>>")
    part = stored(part, "encoded")
    gaps = part.select("__row", F.explode("gaps").alias("g")).groupBy("__row", "g.at").agg(F.first("g.unit").alias("unit"))
    filled = gaps.join(known.select(F.struct("unit").alias("__k"), F.col("ids").alias("new")), F.struct("unit") == F.col("__k")).groupBy("__row").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "new"))).alias("new"))
    joined = part.withColumn("__k", F.struct("__row")).join(filled.select(F.struct("__row").alias("__k"), "new"), "__k", "left")
    whole_ids = F.when(F.col("new").isNull(), F.col("ids")).otherwise(
        F.flatten(F.transform("ids", lambda x: F.when(x >= 0, F.array(x)).otherwise(F.col("new")[-x - 1]))))
    out = joined.select(*keep, whole_ids.alias("ids"))
    if verify:
        out = decode(out, (*keep, "ids"), "ids", "__back", model).withColumn("round_trip", F.col("__text").eqNullSafe(F.col("__back")))
    return out.select(*carry, "ids", *["round_trip"] * verify)


def decode(coded: DataFrame, carry: tuple[str, ...] = ("doc_id",), ids: str = "ids", name: str = "decoded", model: str = MODEL) -> DataFrame:
    """``carry`` columns and the text of the ids of every row."""
    raw = _bytes_table(vocabulary(model)[1])
    keep = list(carry)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("__ids")
            offs = lists.offsets.to_numpy().astype(np.int64)
            for lo in range(0, len(lists), 256):
                hi = min(lo + 256, len(lists))
                got, at = _restored(lists.values.to_numpy()[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], raw)
                text, ends = got.tobytes(), at.tolist()
                out = [text[a + 1 : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(ends, ends[1:])]
                void = lists.slice(lo, hi - lo).is_null()
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in keep], pa.array(out, pa.string(), mask=void.to_numpy(zero_copy_only=False))],
                                                 names=[*keep, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.select(*carry).schema)
    return coded.select(*carry, F.col(ids).alias("__ids")).mapInArrow(work, f"{schema}, `{name}` string")


def measured(docs: DataFrame, text: str = "text", model: str = MODEL, **how) -> DataFrame:
    """doc_id, ids, n_tokens, n_byte_tokens and whether decoding gives the text back."""
    byte = vocabulary(model)[2]
    return encode(docs, ("doc_id",), text, model, verify=True, **how).select(
        "doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.size(F.filter("ids", lambda x: x.between(min(byte), max(byte)))).cast("long").alias("n_byte_tokens"), "round_trip")
