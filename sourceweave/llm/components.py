"""Union-find grouping of links as Spark joins.

Alternating large-star and small-star steps: every node hooks its larger
neighbours to the least node it knows, then itself and its smaller neighbours to
the least of those. The rounds grow with the logarithm of the graph. A hub is
only ever aggregated (min) or joined to one row, on a key of its own so that
AQE can split it; no neighbourhood is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceweave.llm.common import stored


def _with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """Join (u, v) rows to the least node m of their u; the fresh key keeps both shuffles splittable."""
    right = least.select(F.struct("u").alias("__k"), "m")
    return rows.withColumn("__k", F.struct("u")).join(right, "__k").drop("__k")


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, root) of every node that an edge (a, b) touches; root is the component's least node.

    Ids are longs without nulls. An empty edge table gives an empty result.
    """
    pairs = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or state[0] == 0:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
                pairs.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
        last = state
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = _with_least(large, down).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        joined = moved.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v")
        pairs = stored(joined.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    raise RuntimeError("components did not settle")
