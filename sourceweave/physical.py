"""Physical-plan helpers shared by the operators.

Rules followed everywhere: no broadcast hint without a size check (Spark's own
threshold decides otherwise), no window over a key that may be hot, and group
values leave an aggregation as rows rather than as one ever-growing array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT = 64 * 1024 * 1024
#: for tables that grow with the input: keys and names pack so well in files that a table takes up to 30 times that in memory
LOOKUP_LIMIT = 8 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan (file sizes carried through it)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only when the estimate fits; else leave the shuffle join to AQE."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def is_small(df: DataFrame) -> bool:
    """Whether a table that grows with the input may be sent whole."""
    return estimated_bytes(df) <= LOOKUP_LIMIT


def lookup_side(df: DataFrame) -> DataFrame:
    """``small_side`` for a table that grows with the input: when it is not small it is never sent.

    Spark would send it where a plan reads few of its columns, for it takes the size from the file: millions of running numbers
    are a few MB there and hundreds in memory.
    """
    return F.broadcast(df) if is_small(df) else df.hint("merge")


def spread(df: DataFrame, per_task: int = 128 * 1024 * 1024) -> DataFrame:
    """Deal rows out to all tasks when the data is too small for its own splits to do so.

    One small file is one task, however heavy the work per row. Above the size
    where the scan fills the cluster by itself the frame is returned as it is,
    so large data is never shuffled for this.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if estimated_bytes(df) < tasks * per_task else df


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """One row per key, the least by ``order``.

    A ``min`` over a struct combines on the map side, so a key that holds a
    third of all rows still reaches the reducer as one row per input task.
    """
    named = [o.alias(f"__o{i}") for i, o in enumerate(order)]
    packed = F.struct(*named, *[F.col(k).alias(k) for k in keep])
    return (
        df.groupBy(*keys)
        .agg(F.min(packed).alias("__first"))
        .select(*keys, *[F.col(f"__first.{k}").alias(k) for k in keep])
    )


def with_group_count(df: DataFrame, keys: Sequence[str], name: str, at_least: int = 2) -> DataFrame:
    """Rows whose key occurs ``at_least`` times, with the count.

    Count first (map-side combined), then join the short list of repeated keys
    back; AQE splits the row side when one key is hot, which a window cannot do.
    Keys compare null-safe, as they do in a GROUP BY.
    """
    safe = [F.struct(F.col(k)).alias(f"__k_{k}") for k in keys]
    counts = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) >= at_least)
        .select(*safe, name)
    )
    left = df.select("*", *safe)
    return left.join(counts, [f"__k_{k}" for k in keys]).drop(*[f"__k_{k}" for k in keys])


def keyed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join whose both sides are shuffled for it alone, so that AQE can split a hot key.

    A side that comes straight out of an aggregation on the join key would be
    read as it lies, and AQE leaves such joins whole. The key is therefore a
    column of its own on both sides. NULL keys match nothing.
    """
    whole = F.lit(True)
    for c in on:
        whole = whole & F.col(c).isNotNull()
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(on)])
    r = right.where(whole).select(key.alias("__key"), *[c for c in right.columns if c not in on])
    return left.withColumn("__key", F.when(whole, key)).join(r, "__key", how).drop("__key")


def null_last(c: Column) -> list[Column]:
    """Two sort keys that put NULL after every value inside a struct comparison."""
    return [c.isNull(), c]
