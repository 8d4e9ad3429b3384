"""Graph jobs over an edge table.

Iterative jobs run one Spark job per round and cut lineage with a reliable
checkpoint. A hub never becomes one row or one group: neighbourhoods are only
ever aggregated (min, count) or joined on a key of the join's own, so AQE can split the hub.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceweave.physical import keyed_join
from sourceweave.session import cut_lineage


def adjacency(edges: DataFrame, *carry: str) -> DataFrame:
    """Both directions of every edge as (src, dst)."""
    p = F.col("people")
    both = F.array(F.struct(p[0].alias("src"), p[1].alias("dst")), F.struct(p[1].alias("src"), p[0].alias("dst")))
    return edges.select(*carry, F.inline(both))


def leaf_edges(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """Edges with an end of degree one."""
    out = edges
    for i in (0, 1):
        d = degrees.select(F.col("id").alias(f"__e{i}"), F.col("degree").alias(f"__d{i}"))
        out = keyed_join(out.withColumn(f"__e{i}", F.col("people")[i]), d, [f"__e{i}"], "left")
    return out.withColumn("leaf", (F.col("__d0") == 1) | (F.col("__d1") == 1)).drop("__e0", "__d0", "__e1", "__d1")


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the least id of each component; isolated nodes are their own.

    Alternates large-star and small-star steps, so the number of rounds grows
    with the logarithm of the graph and not with its diameter. Each step is a
    min per node and a join back, never a collected neighbourhood.
    """
    pairs = cut_lineage(
        edges.select(F.col("people")[0].alias("a"), F.col("people")[1].alias("b")).where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    last = None
    for _ in range(max_rounds):
        # large star: every neighbour above u moves to the least of u and its neighbours
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = keyed_join(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the neighbours at or below u, and u itself, move to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small_least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = keyed_join(down, small_least, ["u"])
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = cut_lineage(moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        # a fixed point has the same edges; count and an order-free digest tell without a join
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("id").distinct().join(pairs.select(F.col("u").alias("id"), "v"), "id", "left").select(
        "id", F.coalesce("v", "id").alias("component"))


def component_sizes(components: DataFrame, positions: DataFrame) -> DataFrame:
    """(component, size, first_pos), to be ordered by size, ties to the component met first."""
    return components.join(positions, "id").groupBy("component").agg(
        F.count(F.lit(1)).alias("size"), F.min("pos").alias("first_pos"))


def hub(degrees: DataFrame) -> DataFrame:
    """The person of highest degree, ties to the earliest."""
    return degrees.agg(F.max_by("id", F.struct("degree", (-F.col("pos")).alias("p"))).alias("id"), F.max("degree").alias("degree"))


def main_component(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.max_by("component", F.struct("size", (-F.col("first_pos")).alias("p"))).alias("component"))


def singletons(components: DataFrame, degrees: DataFrame) -> DataFrame:
    """Nodes alone in their component and without any connection."""
    one = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("component")
    return components.join(one, "component", "left_semi").join(degrees.where("degree = 0").select("id"), "id", "left_semi").select("id")


def tree_components(components: DataFrame, edges: DataFrame, positions: DataFrame, smallest: int = 3) -> DataFrame:
    """Per component of at least ``smallest`` nodes: is it a tree, and its root (highest degree, ties to the earliest)."""
    deg = adjacency(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return (
        components.join(positions, "id").join(deg, "id", "left")
        .withColumn("degree", F.coalesce("degree", F.lit(0)))
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / 2).cast("bigint").alias("edges"),
             F.max_by("id", F.struct("degree", (-F.col("pos")).alias("p"))).alias("root"))
        .where(F.col("nodes") >= smallest)
        .withColumn("is_tree", F.col("edges") == F.col("nodes") - 1)
    )


def breadth_first(start: DataFrame, edges: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(id, depth, parent, rank): hop counts from ``start`` (one column ``id``) and the search tree.

    A node hangs under the earliest-placed neighbour of the level before, as a
    queue would place it; ``edges`` carries ``pos``, the order edges are tried in.
    A level is ranked by a range-partitioned sort, not by one window.
    """
    adj = cut_lineage(adjacency(edges, "pos").select("src", "dst", "pos"))
    level = cut_lineage(start.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("rank")))
    levels = [level]
    for depth in range(1, max_depth + 1):
        reach = level.join(adj, level.id == adj.src).select(
            F.col("dst").alias("id"), F.struct(F.col("rank").alias("r"), F.col("pos").alias("p"), F.col("src").alias("s")).alias("via"))
        found = reach.groupBy("id").agg(F.min("via").alias("via"))
        # a neighbour of one level lies in it, in the one before or in the next
        for old in levels[-2:]:
            found = found.join(old.select("id"), "id", "left_anti")
        ranked = found.orderBy("via.r", "via.p").select(
            "id", F.lit(depth).alias("depth"), F.col("via.s").alias("parent"), F.monotonically_increasing_id().alias("rank"))
        level = cut_lineage(ranked)
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)
    raise RuntimeError("search deeper than max_depth")


def subtree_leaves(tree: DataFrame) -> DataFrame:
    """(id, leaves): leaves under each node of a search tree, one bottom-up round per level."""
    tree = cut_lineage(tree)
    kids = tree.where(F.col("parent").isNotNull()).select(F.col("parent").alias("id")).distinct()
    depth = tree.agg(F.max("depth")).first()[0] or 0
    weight = tree.join(kids, "id", "left_anti").select("id", F.lit(1).cast("bigint").alias("leaves"))
    parts = [cut_lineage(weight.join(tree.select("id", "depth"), "id"))]
    for d in range(depth - 1, -1, -1):
        below = reduce(DataFrame.unionByName, parts).where(F.col("depth") == d + 1).select("id", "leaves")
        up = tree.where(F.col("depth") == d + 1).join(below, "id").groupBy(F.col("parent").alias("id")).agg(
            F.sum("leaves").alias("leaves")).withColumn("depth", F.lit(d))
        parts.append(cut_lineage(up))
    return reduce(DataFrame.unionByName, parts).select("id", "leaves")


def leaf_clusters(edges: DataFrame, degrees: DataFrame, least: int = 2, most: int = 8) -> DataFrame:
    """(hub, member, own): hubs with 2 to 8 neighbours of degree one, and everyone in their neighbourhood.

    ``own`` marks the hub and its hangers-on; other neighbours are members only.
    """
    adj = adjacency(edges)
    ones = degrees.where("degree = 1").select(F.col("id").alias("dst"))
    leaves = keyed_join(adj, ones, ["dst"], "left_semi")
    hubs = leaves.groupBy(F.col("src").alias("hub")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most)).select("hub")
    around = adj.select(F.col("src").alias("hub"), F.col("dst").alias("member")).distinct()
    around = keyed_join(around, hubs, ["hub"], "left_semi")
    flagged = keyed_join(around, ones.select(F.col("dst").alias("member"), F.lit(True).alias("own")), ["member"], "left").select(
        "hub", "member", F.coalesce("own", F.lit(False)).alias("own"))
    return flagged.unionByName(hubs.select("hub", F.col("hub").alias("member"), F.lit(True).alias("own")))


def focus_person(edges: DataFrame, person: str) -> DataFrame:
    """The ego network: the edges of a person and everyone they lead to."""
    mine = edges.where(F.array_contains("people", person))
    return mine.select("id", F.explode("people").alias("person")).withColumn("primary", F.col("person") == person)


def focus_relationship(edges: DataFrame, relationship: str) -> DataFrame:
    return edges.where(F.col("id") == relationship).select("id", F.explode("people").alias("person"))


def ego_networks(edges: DataFrame) -> DataFrame:
    """(person, neighbour, edge) for everybody at once."""
    return adjacency(edges, "id").select(F.col("src").alias("person"), F.col("dst").alias("neighbour"), F.col("id").alias("edge"))
