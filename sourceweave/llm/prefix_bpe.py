"""Byte-level BPE by prefix dynamic programming: encoding, decoding and exact edits of stored encodings.

For every prefix of a pattern match there is exactly one token that can end its
BPE encoding. The table of these last tokens is filled from left to right: a
token that ends at a place is the right one when it and the last token before
it are a valid pair, that is when BPE on their joined bytes gives back the two.
Walking back over the table spells the encoding of any prefix; bytes appended
later only extend the table; and after an edit the table is right again as soon
as ``longest`` neighbouring entries agree with the old ones, because an entry
depends on no more than that.

``encode`` returns the ids of every whole text and, with ``keep_table``, the
table itself. ``edit`` changes stored texts and computes only the entries near
the change. ``decode`` turns ids into bytes, ``round_trip`` encodes and decodes
in one worker. All are one pass over the rows, without a shuffle; matches met before are looked up in a table of bounded
size, one per task.

Defined results: a null or empty text has no ids (an empty array) and decodes
to no bytes; bytes that are not UTF-8 count as U+FFFD, as they do when such a
text is read as a string. An id outside the vocabulary, or null, decodes to
nothing; null ids decode to no bytes. An edit beyond the end of a text takes
place at its end, a negative one at its start; a null position, cut or insert
counts as the end, nothing and empty. Rows are handled one by one, so copies,
ties, repeated ids and the order of rows change nothing; an empty table gives
an empty result. Very long texts and very long matches take time in proportion
to their length. Other columns are carried only when named, and a carried
column whose name an output takes is replaced by the output.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sourceweave.llm.common import chunks, ragged

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: fixed value: the pattern that cuts texts before the merges of the rank files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: matches (of up to so many characters) and token pairs that a task keeps; of matches twice as many for a while
KEPT_MATCHES, KEPT_CHARS, KEPT_PAIRS = 1 << 17, 64, 1 << 19
#: a match is safe from an edit when this many bytes lie between them: two characters decide where a match ends
LOOKAHEAD = 8
#: bytes of texts handled together, and matches whose tables are filled together
CHUNK_BYTES = 1 << 20
TOGETHER = 1 << 13
_NEVER = 1 << 60
Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_FREE = np.uint64(2**64 - 1)


class Lookup:
    """Small whole numbers by key, for arrays of keys at once (open addressing); an absent key gives -1."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.keys = np.full(1 << bits, _FREE)
        self.vals = np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        got, out = self.keys[at], self.vals[at]
        todo = np.flatnonzero((got != keys) & (got != _FREE))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            got, out[todo] = self.keys[at[todo]], self.vals[at[todo]]
            todo = todo[(got != keys[todo]) & (got != _FREE)]
        return out

    def put(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Add keys that are different and absent."""
        if 3 * (self.n + len(keys)) > 1 << self.bits:
            old = self.keys != _FREE
            keys, vals = np.concatenate([self.keys[old], keys]), np.concatenate([self.vals[old], vals])
            self.__init__(max(self.bits, int(3 * len(keys)).bit_length()))
        self.n += len(keys)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == _FREE]
            won = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[won]], self.vals[at[won]] = keys[won], vals[won]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)


class Vocabulary:
    """The ranks, the symbols along both ends of every token while it is merged, and a trie of all tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.raw = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.raw[i] = b
        self.longest = max(map(len, ranks), default=0)
        self.pairs: dict[int, bool] = {}
        self.steps = 0  # table entries computed so far
        self.head: list[tuple[int, ...]] = [()] * len(self.raw)
        self.tail: list[tuple[int, ...]] = [()] * len(self.raw)
        self.forwards: dict = {}
        for token in sorted(ranks.values()):
            self._admit(token)
        self.size = np.array([*map(len, self.raw)], np.int64)
        self.seen = Lookup(16)  # pairs met by ``encode_many``
        # the same trie by (node, byte), with the token of every node
        numbered, keys, tokens = [self.forwards], [], [-1]
        for at, node in enumerate(numbered):
            for c, child in node.items():
                if c >= 0:
                    keys.append(at << 8 | c)
                    numbered.append(child)
                    tokens.append(child.get(-1, -1))
        self.children, self.token_at = Lookup(18), np.array(tokens, np.int64)
        self.children.put(np.array(keys, np.uint64), np.arange(1, len(tokens), dtype=np.int32))

    def _admit(self, token: int) -> None:
        """Note how a token comes about from tokens of lower ranks, then let it take part."""
        b = self.raw[token]
        if len(b) == 1:
            self.head[token] = self.tail[token] = (token,)
        else:
            parts = self.spell(self.table(b))
            if len(parts) != 2:
                raise ValueError(f"token {token} is no merge of two lower tokens; this method needs a vocabulary of merges")
            left, right = parts
            self.head[token] = (*self.head[left], token)
            self.tail[token] = (*self.tail[right], token)
        self.pairs.clear()  # pairs seen so far may now merge
        node = self.forwards
        for c in b:
            node = node.setdefault(c, {})
        node[-1] = token

    def valid(self, left: int, right: int) -> bool:
        """Whether BPE on the bytes of both tokens ends with the two.

        Merges come in the order of their ranks, so the symbols on both sides
        of the seam grow in a known order. The pair is lost when the two symbols
        that meet at some moment merge before either of them grows.
        """
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        out = self.pairs[left << 32 | right] = self._valid(left, right)
        return out

    def _valid(self, left: int, right: int) -> bool:
        a, b, raw, rank = self.tail[left], self.head[right], self.raw, self.ranks.get
        i = j = 0
        while True:
            grow_a = a[i + 1] if i + 1 < len(a) else _NEVER
            grow_b = b[j + 1] if j + 1 < len(b) else _NEVER
            seam = rank(raw[a[i]] + raw[b[j]], _NEVER)
            # of equal merges the leftmost comes first: one inside the left token, then the seam, then one inside the right
            if seam < _NEVER and seam < grow_a and seam <= grow_b and self.head[seam]:
                return False
            if grow_a == grow_b == _NEVER:
                return True
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1
    def table(self, data: bytes, known: list[int] | None = None, old: list[int] | None = None, old_from: int = 0) -> list[int]:
        """Last token of every prefix of ``data`` (one pattern match), entry 0 for the first byte.

        ``known`` are entries that hold already. ``old[old_from + k]`` is an
        earlier table's entry for the same bytes at ``len(known) + k`` bytes and
        beyond the changed part; once ``longest`` of them agree the rest is copied.
        """
        n, first = len(data), len(known or ())
        last = [*(known or ()), *[None] * (n - first)]
        trie, known_pair, valid, longest, agree, done = self.forwards, self.pairs.get, self.valid, self.longest, 0, first
        # tokens are laid from every start on, so the longest token that may end at a place is tried first
        for start in range(max(first - longest, 0), n):
            if start > first:
                done = start
                if old is not None:
                    k = old_from + start - 1 - first
                    agree = agree + 1 if 0 <= k < len(old) and old[k] == last[start - 1] else 0
                    if agree > longest and k + n - start + 1 <= len(old):
                        last[start:] = old[k + 1 : k + n - start + 1]
                        break
            before, node = (last[start - 1] if start else None), trie
            for end in range(start, n):
                node = node.get(data[end])
                if node is None:
                    break
                token = node.get(-1)
                if token is not None and last[end] is None:
                    if before is None:
                        last[end] = token
                    else:
                        fits = known_pair(before << 32 | token)
                        if valid(before, token) if fits is None else fits:
                            last[end] = token
        else:
            done = n
        self.steps += done - first
        return last

    def encode_many(self, units: list[bytes]) -> list[bytes]:
        """Packed ids (int32) of many matches: their tables filled together, place by place."""
        size = np.array([*map(len, units)], np.int64)
        data = np.frombuffer(b"".join(units), np.uint8)
        ends = np.cumsum(size)
        starts = ends - size
        stop, offset = np.repeat(ends, size), np.arange(len(data)) - np.repeat(starts, size)
        # every token that stands anywhere: (start, last byte, token)
        found, at, node, depth = [], np.arange(len(data)), np.zeros(len(data), np.uint64), 0
        while len(at):
            node = self.children.get(node << np.uint64(8) | data[at + depth])
            at, node = at[node >= 0], node[node >= 0]
            token = self.token_at[node]
            found.append((at[token >= 0], at[token >= 0] + depth, token[token >= 0]))
            depth += 1
            more = at + depth < stop[at]
            at, node = at[more], node[more].astype(np.uint64)
        begin, end, token = (np.concatenate([f[k] for f in found]) for k in range(3)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(offset[begin], kind="stable")
        begin, end, token = begin[order], end[order], token[order]
        cuts = np.searchsorted(offset[begin], np.arange(int(size.max(initial=0)) + 1))
        last = np.full(len(data), -1, np.int64)
        for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            b, e, t = begin[lo:hi], end[lo:hi], token[lo:hi]
            if k:
                open_ = last[e] < 0
                b, e, t = b[open_], e[open_], t[open_]
                fits = self._fit(last[b - 1], t)
                e, t = e[fits], t[fits]
            last[e] = t
        chosen, at, floor = np.zeros(len(data), bool), ends[size > 0] - 1, starts[size > 0]
        while len(at):
            chosen[at] = True
            at = at - self.size[last[at]]
            at, floor = at[at >= floor], floor[at >= floor]
        packed = last[chosen].astype(np.int32).tobytes()
        cut = (4 * np.concatenate([[0], np.cumsum(chosen)])[np.concatenate([starts, ends[-1:]])]).tolist() if units else []
        return [packed[a:b] for a, b in zip(cut, cut[1:])]

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``valid`` for arrays of tokens."""
        keys = (left << 32 | right).astype(np.uint64)
        got = self.seen.get(keys)
        if (got < 0).any():
            new = np.unique(keys[got < 0])
            if self.seen.n + len(new) > KEPT_PAIRS:
                self.seen = Lookup(16)
                new = np.unique(keys)
            self.seen.put(new, np.array([self._valid(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], np.int32))
            got = self.seen.get(keys)
        return got == 1

    def spell(self, last: list[int]) -> list[int]:
        """Ids of the whole match, walked back over its table."""
        out, at, raw = [], len(last), self.raw
        while at:
            out.append(last[at - 1])
            at -= len(raw[out[-1]])
        return out[::-1]


def _ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank per line."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines())
    return {base64.b64decode(x[0]): int(x[1]) for x in lines if len(x) == 2}


@lru_cache(maxsize=2)
def vocabulary(path: str = RANKS) -> Vocabulary:
    return Vocabulary(_ranks(path))


@lru_cache(maxsize=2)
def token_bytes(path: str = RANKS) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all tokens by id, their lengths): all that decoding needs; a last length of 0 stands for ids that are none."""
    ranks = _ranks(path)
    by_id = {i: b for b, i in ranks.items()}
    raw = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
    return np.frombuffer(b"".join(raw), np.uint8), np.array([*map(len, raw), 0], np.int64)


class Matches(dict):
    """Packed ids of pattern matches met before.

    When full, the table starts anew and takes over what is asked for again, so frequent matches stay.
    """

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab, self.older = vocab, {}

    def learn(self, units: set[str]) -> None:
        """Encode the units that are not known, short ones together."""
        new = [u for u in units if u not in self]
        if len(self) + len(new) > KEPT_MATCHES:
            self.older = dict(self)
            self.clear()
            new = list(units)
        fresh = []
        for u in new:
            if u in self.older:
                self[u] = self.older[u]
            elif len(u) <= KEPT_CHARS:
                fresh.append(u)
        for lo in range(0, len(fresh), TOGETHER):
            part = fresh[lo : lo + TOGETHER]
            self.update(zip(part, self.vocab.encode_many([u.encode() for u in part])))

    def __missing__(self, match: str) -> bytes:
        """A long match: encoded each time it stands somewhere."""
        return np.array(self.vocab.spell(self.vocab.table(match.encode())), np.int32).tobytes()


def encode_table(text: bytes, vocab: Vocabulary, cut: regex.Pattern) -> list[int]:
    """The table of a whole text: ids, stored as -1 - id at the first byte of every match."""
    out: list[int] = []
    for m in cut.findall(text.decode()):
        one = vocab.table(m.encode())
        one[0] = -1 - one[0]
        out += one
    return out


def table_ids(table: list[int], vocab: Vocabulary) -> list[int]:
    """Ids of a text from its table."""
    out, at, raw = [], len(table), vocab.raw
    while at:
        x = table[at - 1]
        out.append(x if x >= 0 else -1 - x)
        at -= len(raw[out[-1]])
    return out[::-1]


def edit_table(text: bytes, table: list[int], at: int, cut: int, insert: bytes, vocab: Vocabulary, pattern: regex.Pattern) -> tuple[bytes, list[int], int]:
    """(text, table, entries computed) after ``cut`` bytes at byte ``at`` gave way to ``insert``.

    The places must lie between characters. Matches that end well before the
    edit stay; matching begins behind them and stops where a match begins at
    the beginning of an old one beyond the edit. Inside a match the entries
    before the edit stay and those behind it are copied once they agree.
    """
    new = text[:at] + insert + text[at + cut :]
    moved = len(insert) - cut  # new place = old place + moved, beyond the edit
    begin = max(at - LOOKAHEAD, 0)
    while begin > 0 and (begin >= len(table) or table[begin] >= 0):
        begin -= 1
    out, before, place = table[:begin], vocab.steps, begin
    # characters are decoded from the first match on; a match is found where it stands, whatever lies before it
    for m in pattern.finditer(new[begin:].decode()):
        old_place = place - moved
        if place >= at + len(insert) and old_place >= at + cut and old_place < len(table) and table[old_place] < 0:
            return new, out + table[old_place:], vocab.steps - before
        data = m.group().encode()
        known: list[int] = []
        if place < at and place < len(table) and table[place] < 0:
            stop = min(at, place + len(data))
            known = table[place : place + 1]
            for x in table[place + 1 : stop]:
                if x < 0:
                    break
                known.append(x)
            known[0] = -1 - known[0]
        first = len(known)
        # entries of the old match that stand beyond the edit, aligned with the first entry to compute
        old_first = place + first - moved
        reach = old_first
        while reach < len(table) and reach < old_first + len(data) - first and (reach < at + cut or table[reach] >= 0):
            reach += 1
        shield = max(at + cut - old_first, 0)
        old = [_NEVER] * shield + table[old_first + shield : reach] if reach > old_first + shield >= 0 else None
        one = vocab.table(data, known, old)
        one[0] = -1 - one[0]
        out += one
        place += len(data)
    return new, out, vocab.steps - before


def _clean(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").encode()


def _carried(df: DataFrame, carry: tuple[str, ...], out: tuple[str, ...]) -> list[str]:
    return [c for c in dict.fromkeys(carry) if c not in out]


def _with(df: DataFrame, names: list[str], more: str) -> StructType:
    return StructType([*df.select(*names).schema.fields, *StructType.fromDDL(more).fields])


def _ints(rows: list[list[int]] | list[bytes]) -> pa.Array:
    """A list<int32> column of lists or of packed ids."""
    parts = [r if isinstance(r, bytes) else np.array(r, np.int32).tobytes() for r in rows]
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), keep_table: bool = False, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``carry`` columns and ids (array<int>) of every text; with ``keep_table`` also last (array<int>), for ``edit``."""
    src, names, schema, work = _encoding(docs, text, carry, keep_table, path, pattern)
    return src.mapInArrow(work, schema)


def _encoding(docs: DataFrame, text: str, carry: tuple[str, ...], keep_table: bool, path: str, pattern: str) -> tuple[DataFrame, list[str], StructType, Work]:
    """Input, carried columns, schema and work of ``encode``."""
    names = _carried(docs, carry, ("ids", "last") if keep_table else ("ids",))
    src = docs.select(*names, F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("__text"))
    schema = _with(docs, names, "ids array<int>" + (", last array<int>" if keep_table else ""))
    out = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, cut = vocabulary(path), regex.compile(pattern)
        known = Matches(vocab)
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column("__text"), CHUNK_BYTES):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
                cols = [batch.column(c).slice(lo, hi - lo) for c in names]
                if keep_table:
                    tables = [encode_table(_clean(t), vocab, cut) for t in texts]
                    cols += [_ints([table_ids(t, vocab) for t in tables]), _ints(tables)]
                else:
                    parts = [cut.findall(t.decode("utf-8", "replace")) for t in texts]
                    known.learn(set().union(*parts))
                    cols.append(_ints([b"".join(map(known.__getitem__, p)) for p in parts]))
                yield pa.RecordBatch.from_arrays(cols, names=out)

    return src, names, schema, work


def edit(coded: DataFrame, at: str = "at", cut: str = "cut", insert: str = "insert", text: str = "text", carry: tuple[str, ...] = ("doc_id",),
         path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``carry`` columns, the changed text, its ids and last, and n_computed, the entries that were computed for it.

    ``coded`` holds texts with their ``last`` (from ``encode`` with
    ``keep_table``, or from ``edit``), the place of the change (``at``) and its
    length (``cut``) in code points, and the text to ``insert``; an append is a
    change at the end.
    """
    names = _carried(coded, carry, (text, "ids", "last", "n_computed"))
    t, whole = F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(1 << 31)
    src = coded.select(*names, t.cast("binary").alias("__text"), F.col("last").alias("__last"), F.coalesce(F.col(at).cast("long"), whole).alias("__at"),
                       F.coalesce(F.col(cut).cast("long"), F.lit(0)).alias("__cut"),
                       F.coalesce(F.col(insert).cast("string"), F.lit("")).cast("binary").alias("__insert"))
    schema = _with(coded, names, f"`{text}` string, ids array<int>, last array<int>, n_computed long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, rx = vocabulary(path), regex.compile(pattern)
        for batch in batches:
            for lo in range(batch.num_rows):  # a table is four times its text: one row at a time
                row = {c: batch.column(c)[lo].as_py() for c in ("__text", "__last", "__at", "__cut", "__insert")}
                s = row["__text"].decode("utf-8", "replace")
                a = min(max(row["__at"], 0), len(s))
                b = min(a + max(row["__cut"], 0), len(s))
                old, front = s.encode(), len(s[:a].encode())
                new, table, n = edit_table(old, row["__last"] or encode_table(old, vocab, rx), front, len(s[a:b].encode()), _clean(row["__insert"]), vocab, rx)
                cols = [batch.column(c).slice(lo, 1) for c in names]
                cols += [pa.array([new.decode()]), _ints([table_ids(table, vocab)]), _ints([table]), pa.array([n], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(work, schema)


def decode(coded: DataFrame, ids: str = "ids", into: str = "bytes", carry: tuple[str, ...] = ("doc_id",), path: str = RANKS) -> DataFrame:
    """``carry`` columns and the bytes that ``ids`` stand for, as a binary column ``into``."""
    names = _carried(coded, carry, (into,))
    src = coded.select(*names, F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("__ids"))
    schema = _with(coded, names, f"`{into}` binary")

    return src.mapInArrow(_decoding(names, "__ids", schema.names, path), schema)


def _decoding(names: list[str], ids: str, out: list[str], path: str) -> Work:
    """Work of ``decode``: ``names`` and the bytes of the column ``ids``, named ``out``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, size = token_bytes(path)
        none = len(size) - 1
        first = np.cumsum(size) - size
        for batch in batches:
            column = batch.column(ids)
            counts = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            lo = 0
            while lo < len(column):  # about a million ids at a time
                hi = min(max(lo + 1, int(np.searchsorted(counts, counts[lo] + (1 << 20), "right")) - 1), len(column))
                mine = flat[counts[lo] : counts[hi]]
                mine = np.where((mine >= 0) & (mine < none), mine, none)
                ends = np.concatenate([[0], np.cumsum(size[mine])])
                offsets = pa.array(ends[counts[lo : hi + 1] - counts[lo]].astype(np.int32)).buffers()[1]
                bytes_ = data[ragged(first[mine], size[mine])].tobytes()
                cols = [batch.column(c).slice(lo, hi - lo) for c in names]
                cols.append(pa.Array.from_buffers(pa.binary(), hi - lo, [None, offsets, pa.py_buffer(bytes_)]))
                yield pa.RecordBatch.from_arrays(cols, names=out)
                lo = hi

    return work


def round_trip(docs: DataFrame, text: str = "text", into: str = "bytes", carry: tuple[str, ...] = ("doc_id",), path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``encode`` and ``decode`` of its ids in one worker per task: ``carry`` columns, ids and the bytes they stand for."""
    src, names, coded, there = _encoding(docs, text, tuple(c for c in carry if c != into), False, path, pattern)
    schema = StructType([*coded.fields, *StructType.fromDDL(f"`{into}` binary").fields])
    back = _decoding(coded.names, "ids", schema.names, path)
    return src.mapInArrow(lambda batches: back(there(batches)), schema)


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = RANKS) -> DataFrame:
    """``key``, n_tokens, and hex digests of the ids and of the bytes that they decode to."""
    back = round_trip(docs, text=text, into="__bytes", carry=(key,), path=path)
    return back.select(key, F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("__bytes", 256).alias("decoded_sha256"))
