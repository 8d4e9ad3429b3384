"""Prefix trie of conversations by ROLLUP over positional columns of turn ids.

Every conversation becomes one row per block of ``BLOCK`` turns: the turn ids
stand in columns t1 to tB beside ``prev``, the key of the node where the block
before ended. One ``GROUP BY block, prev, ROLLUP (t1, ..., tB)`` then aggregates
all prefixes of all blocks together, and ``grouping_id`` tells the length of
each. A turn id is 128 bits of the SHA-256 of role and text, followed by the
number of code points of the text.

Sums over subtrees need no walk up the tree. Every node is charged to its
smallest member; a second ROLLUP adds, for each node, what all its members are
charged with. Of that only the smallest member's own part above the node lies
outside the subtree, and a running sum along its nodes takes it off.

Hot groups: turns are numbered, and running sums taken, over ranges of
(conversation, turn), so a conversation that holds a third of all rows is cut
among tasks; its blocks are chained by doubling, with rounds that grow with the
logarithm of its blocks. Copies of one conversation meet in aggregations that
combine before the shuffle. The members that end in a node are joined into one
text in order, piece by piece: ranges of (node, conversation) become pieces of
bounded size, and a digest runs over a node's pieces without holding them.

Defined results: a null role or text is empty; rows without a conversation id
belong to no conversation; turns follow ``turn`` with null first, equal ones by
role and then by the digest of role and text, and repeated rows count as turns
of their own. A conversation without turns left ends in the root. An empty
table has no nodes. Texts of any length cost their digest only. Other columns
of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceweave.llm.common import stored
from sourceweave.physical import keyed_join
from sourceweave.session import cut_lineage

BLOCK = 8
#: member ids in one piece of a node's list
PIECE = 4096


def _root() -> Column:
    """Key of the root: no bytes."""
    return F.lit("").cast("binary")


def _short(c: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(c, 256)), 1, 16)


def turn_id(role: Column, text: Column) -> Column:
    """Id of a turn: a digest of role and text, then the code points of the text in four bytes."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return F.concat(_short(whole), F.unhex(F.lpad(F.hex(F.length(text).cast("long")), 8, "0")))


def code_points(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 4)), 16, 10).cast("long")


def running(rows: DataFrame, key: str, order: list[Column], value: Column, into: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` (not negative) over the rows of the same ``key`` up to this one.

    Rows are cut into ranges of key and order and stored, sums are taken inside
    each slice of a key, and a slice gets the sums of those before it; only keys
    that span several ranges have such, so the list of them is as short as that
    of the ranges.
    """
    cut = stored(rows.repartitionByRange(F.col(key), *order).withColumn("__part", F.spark_partition_id()), name)
    inside = cut.withColumn(into, F.sum(value).over(Window.partitionBy(key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    each = cut.groupBy(key, "__part").agg(F.sum(value).alias("__sum"))
    before = each.withColumn("__before", F.sum("__sum").over(Window.partitionBy(key).orderBy("__part")) - F.col("__sum")).where("__before > 0")
    out = inside.join(before.select(key, "__part", "__before"), [key, "__part"], "left")
    return out.withColumn(into, F.col(into) + F.coalesce("__before", F.lit(0))).drop("__part", "__before")


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1) and id of every turn of conversations (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), turn_id(role, text).alias("id"))
    return running(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("id")], F.lit(1), "pos", "turns").select("conv_id", "pos", "id")


def shared_heads(turns: DataFrame, conv_ids: DataFrame, head: Column, taken: Column) -> DataFrame:
    """Numbered turns in which every conversation begins with ``taken`` turns of conversation ``head`` in place of its own.

    ``head`` and ``taken`` (at most a handful) are expressions on conv_id. A
    head that is absent or shorter gives what it has.
    """
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("__has"))
    plan = conv_ids.select("conv_id", head.alias("__head"), taken.cast("long").alias("__taken"))
    plan = plan.join(counts.select(F.col("conv_id").alias("__head"), "__has"), "__head", "left")
    plan = plan.withColumn("__has", F.least(F.coalesce("__has", F.lit(0)), "__taken"))
    first = turns.join(plan.select(F.col("__head").alias("conv_id")).distinct(), "conv_id").select(F.col("conv_id").alias("__head"), "pos", "id")
    lent = plan.where("__has > 0").join(first, "__head").where("pos <= __has").select("conv_id", "pos", "id")
    own = keyed_join(turns, plan.select("conv_id", "__taken", "__has"), ["conv_id"]).where("pos > __taken")
    return lent.unionByName(own.select("conv_id", (F.col("pos") - F.col("__taken") + F.col("__has")).alias("pos"), "id"))


def blocks(turns: DataFrame, conv_ids: DataFrame, size: int = BLOCK) -> DataFrame:
    """conv_id, block, prev, t1 to t``size``, next (key of a full block's end) and end (key of a conversation's last node)."""
    t = [f"t{k + 1}" for k in range(size)]
    at = F.pmod(F.col("pos") - 1, F.lit(size))
    placed = turns.select("conv_id", F.floor((F.col("pos") - 1) / size).alias("block"), *[F.when(at == k, F.col("id")).alias(c) for k, c in enumerate(t)])
    bare = conv_ids.select("conv_id", F.lit(0).cast("long").alias("block"), *[F.lit(None).cast("binary").alias(c) for c in t])
    rows = stored(placed.unionByName(bare).groupBy("conv_id", "block").agg(*[F.max(c).alias(c) for c in t]), "blocks")
    # digests of full blocks, then of 2, 4, 8 ... blocks up to each
    chain = rows.where(f"t{size} IS NOT NULL").select("conv_id", "block", _short(F.concat(*t)).alias("next"))
    last = rows.agg(F.max("block")).first()[0] or 0
    step = 1
    while step < last + 1 and last:
        back = chain.select("conv_id", (F.col("block") + step).alias("block"), F.col("next").alias("__back"))
        chain = cut_lineage(chain.join(back, ["conv_id", "block"], "left").select(
            "conv_id", "block", F.when(F.col("__back").isNull(), F.col("next")).otherwise(_short(F.concat("__back", "next"))).alias("next")))
        step *= 2
    prev = chain.select("conv_id", (F.col("block") + 1).alias("block"), F.col("next").alias("prev"))
    out = rows.join(chain, ["conv_id", "block"], "left").join(prev, ["conv_id", "block"], "left").withColumn("prev", F.coalesce("prev", _root()))
    final = rows.groupBy("conv_id").agg(F.max("block").alias("__last"))
    out = keyed_join(out, final, ["conv_id"])
    end = F.when(F.col("next").isNotNull(), F.col("next")).when(F.col("t1").isNull(), F.col("prev")).otherwise(_short(F.concat("prev", *[F.coalesce(c, _root()) for c in t])))
    return stored(out.withColumn("end", F.when(F.col("block") == F.col("__last"), end)).drop("__last"), "trie-rows")


def prefixes(rows: DataFrame, aggregates: str, size: int = BLOCK) -> DataFrame:
    """One ROLLUP over the positional columns: every prefix once, with its depth, key, parent key, last turn and ``aggregates``."""
    t = [f"t{k + 1}" for k in range(size)]
    cols = ", ".join(t)
    rolled = rows.sparkSession.sql(
        f"SELECT block, prev, {cols}, {size} - bit_count(grouping_id()) AS level, max(next) AS next, {aggregates} FROM {{rows}} GROUP BY block, prev, ROLLUP ({cols})", rows=rows)
    level = F.col("level")
    own = F.when(level > 0, F.element_at(F.array(*t), F.greatest(level, F.lit(1)).cast("int")))
    path = lambda n: _short(F.concat("prev", *[F.when(n > k, F.coalesce(c, _root())).otherwise(_root()) for k, c in enumerate(t)]))
    key = F.when(level == size, F.col("next")).when(level == 0, F.col("prev")).otherwise(path(level))
    parent = F.when(level == 1, F.col("prev")).when(level > 1, path(level - 1))
    # a prefix of the block's own turns only: shorter conversations leave null columns, and an empty prefix of a later block is the node before
    kept = rolled.withColumn("__own", own).where((F.col("__own").isNotNull()) | ((level == 0) & (F.col("block") == 0)))
    return (kept.withColumns({"key": key, "parent": parent, "depth": F.col("block") * size + level, "n_chars": F.coalesce(code_points(F.col("__own")), F.lit(0))})
            .drop("block", "prev", "level", "next", "__own", *t))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) rows into (key, first conv_id, ids joined by commas)."""
    key, ids, done = None, [], []
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (k != key or len(ids) >= PIECE):
                done.append((key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = k
            ids.append(c)
        yield _piece_batch(done)
        done = []
    if ids:
        yield _piece_batch([(key, ids[0], ",".join(map(str, ids)))])


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    k, f, i = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(f, pa.int64()), pa.array(i, pa.string())], names=["key", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces into (key, hex digest of all its pieces); one running digest at a time."""
    key, state, done = None, None, []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        k, d = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(d, pa.string())], names=["key", "digest"])

    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if state is not None and k == key:
                state.update(b",")
            else:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        yield batch_of(done)
        done = []
    if state is not None:
        yield batch_of([(key, state.hexdigest())])


def member_digests(ends: DataFrame) -> DataFrame:
    """key and digest of the comma-joined ids, ascending, of the rows (key, conv_id) of each key."""
    pieces = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, digest string")


def trie(turns: DataFrame, conv_ids: DataFrame, size: int = BLOCK) -> DataFrame:
    """Nodes of the trie of numbered turns (conv_id, pos, id); ``conv_ids`` also names conversations without turns.

    Per node: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (code points that sharing saves in the
    subtree) and ends_sha256 (of the ids of members that end here).
    """
    rows = blocks(turns, conv_ids, size)
    nodes = stored(prefixes(rows, "min(conv_id) AS conv_id, count(1) AS n_convs", size), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    saved = ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved")
    nodes = nodes.join(children, "key", "left").select("key", "parent", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), saved)
    nodes = running(nodes, "conv_id", [F.col("depth")], F.col("saved"), "along", "charged")
    charged = nodes.groupBy("conv_id").agg(F.sum("saved").alias("__saved"), F.count(F.when(F.col("n_children") == 0, 1)).alias("__leaves"))
    whole = keyed_join(rows, charged, ["conv_id"], "left")
    below = prefixes(whole, "min(conv_id) AS conv_id, sum(coalesce(__saved, 0)) AS below, sum(coalesce(__leaves, 0)) AS n_leaves", size)
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = member_digests(rows.where("end IS NOT NULL").select(F.col("end").alias("key"), "conv_id"))
    out = nodes.join(below.select("conv_id", "depth", "below", "n_leaves"), ["conv_id", "depth"]).join(ends, "key", "left")
    out = keyed_join(out, above, ["parent"], "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n_convs").cast("long").alias("n_convs"),
                      F.col("n_children").cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
                      (F.col("below") - (F.col("along") - F.col("saved"))).cast("long").alias("saved_tokens"),
                      F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """The trie of conversations that begin with up to five turns of the first conversation of their hundred."""
    turns = stored(numbered(conversations), "numbered")
    conv_ids = turns.select("conv_id").distinct()
    c = F.col("conv_id")
    made = shared_heads(turns, conv_ids, c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6)
    return trie(made, conv_ids, size)
