"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards. A shard draws ``-ln(u) / weight`` for a
document, u from a hash of the document id and the shard's name; a rack draws
the least of its shards' values and a region the least of its racks'. The least
of exponential draws is an exponential draw of the summed weight, so every level
is a weighted draw, and a document descends: least region, least rack in it,
least shard in that. A shard's draw never depends on the other shards, hence a
change of weights moves documents only into subtrees that gain and out of
subtrees that lose; a new shard takes documents only into itself.

Numbering inside shards is gapless: documents are numbered in blocks of a shard
(id hash), and each block starts where the blocks before it end.

Defined results: a null id draws as the empty string; null texts have size 1 and
checksum 0; equal ids share a shard; rows that are equal in all columns take
their slots in any order. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (region, rack, shard, weight) of the sixteen shards of a run
TREE = [(s // 8, s // 4, s, 1.0) for s in range(16)]
#: blocks a shard is numbered in; a block is one task's work, so more data wants more of them
BLOCKS = 256


def grown(tree: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The tree with one more shard, in the last rack."""
    region, rack, shard, weight = max(tree, key=lambda x: x[2])
    return [*tree, (region, rack, shard + 1, weight)]


def _draw(key: Column, shard: int, weight: float) -> Column:
    # 52 bits of the digest are exact as a double; the half keeps u above 0
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(weight)


def _least(values: list[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def _descend(draws: dict[int, Column], tree: list[tuple[int, int, int, float]]) -> Column:
    """The shard reached from the root; ties go to the first in order."""

    def choose(groups: dict[int, list[int]], inside) -> Column:
        value = {g: _least([draws[s] for s in shards]) for g, shards in groups.items()}
        best, out = _least(list(value.values())), None
        for g in reversed(list(groups)):
            out = inside(g) if out is None else F.when(value[g] == best, inside(g)).otherwise(out)
        return out

    def split(level: int, shards: list[tuple[int, int, int, float]]) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for x in shards:
            out.setdefault(x[level], []).append(x[2])
        return out

    def rack(r: int) -> Column:
        return choose(split(2, [x for x in tree if x[1] == r]), lambda s: F.lit(s))

    def region(g: int) -> Column:
        return choose(split(1, [x for x in tree if x[0] == g]), rack)

    return choose(split(0, tree), region)


def assign(rows: DataFrame, key: str = "doc_id", tree: list[tuple[int, int, int, float]] | None = None) -> DataFrame:
    """``rows`` with shard and grown_shard (the shard with one more); no shuffle."""
    tree = tree or TREE
    more = grown(tree)
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    draws = F.array(*[_draw(name, s, w) for _, _, s, w in more])
    place = {x[2]: i for i, x in enumerate(more)}
    drawn = rows.withColumn("__draw", F.explode(F.array(draws)))  # evaluated once, read by every level
    at = {s: F.col("__draw")[i] for s, i in place.items()}
    return (drawn.withColumn("shard", _descend({x[2]: at[x[2]] for x in tree}, tree).cast("int"))
            .withColumn("grown_shard", _descend(at, more).cast("int")).drop("__draw"))


def numbered(rows: DataFrame, order: list[str], blocks: int = BLOCKS) -> DataFrame:
    """``rows`` (with shard) and slot: 0, 1, 2 ... within each shard, without one task holding a shard."""
    cut = rows.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    each = cut.groupBy("shard", "__block").agg(F.count(F.lit(1)).alias("__n"))  # shards times blocks rows at most
    before = each.withColumn("__from", F.sum("__n").over(Window.partitionBy("shard").orderBy("__block")) - F.col("__n")).drop("__n")
    inside = cut.withColumn("__row", F.row_number().over(Window.partitionBy("shard", "__block").orderBy(*order)))
    starts = before.select(F.col("shard").alias("__s"), F.col("__block").alias("__b"), "__from")
    return (inside.join(F.broadcast(starts), (F.col("shard") == F.col("__s")) & (F.col("__block") == F.col("__b")))
            .withColumn("slot", F.col("__from") + F.col("__row") - 1).drop("__block", "__from", "__row", "__s", "__b"))


def shards(docs: DataFrame, tree: list[tuple[int, int, int, float]] | None = None, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    small = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = numbered(assign(small, tree=tree), ["doc_id", "size", "text_crc32"], blocks)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
