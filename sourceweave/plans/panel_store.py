"""The person panel as a stored table: built once, read by the bucket, refreshed by the bucket.

Layout under the store's path: ``data/generation=<g>/bucket=<b>/`` holds rows,
``schema/`` their columns (a table without rows), and ``index/`` holds one row (bucket, generation, rows) for every bucket that a
build or refresh wrote. The last generation of a bucket is the current one, so
a refresh writes new folders and becomes visible with its index rows, which
come last: readers never see half a refresh, and a job that loses its executors
leaves the old state.

A person's bucket is a hash of the id. Rows are dealt by bucket with a
rebalance that Spark splits where a bucket is large, so a person who holds a
third of all rows fills several files and no single task; inside a file rows
are sorted by person, and Parquet's statistics skip what a filter excludes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


def bucket_of(person: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(person), F.lit(buckets)).cast("int")


class PanelStore:
    """A panel on disk; ``buckets`` must be the same for the life of the store."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # ------------------------------------------------------------------ writing
    def build(self, panel: DataFrame) -> PanelStore:
        """Store ``panel`` (any columns, ``person`` among them) as the first generation."""
        panel.limit(0).coalesce(1).write.parquet(f"{self.path}/schema")
        self._write(panel, 0, None)
        return self

    def refresh(self, changed: DataFrame, persons: DataFrame) -> list[int]:
        """Replace all rows of ``persons`` (a column ``person``) by ``changed``; returns the buckets rewritten.

        Rows of other persons in the same buckets are copied from the store; no
        other bucket is read or written. A person without rows in ``changed``
        disappears.
        """
        who = persons.select("person").distinct()
        touched = sorted(r[0] for r in who.select(bucket_of(F.col("person"), self.buckets)).distinct().collect())  # at most the number of buckets
        if not touched:
            return []
        rest = self.table().where(F.col("bucket").isin(touched)).drop("bucket", "generation").join(who, "person", "left_anti")
        new = changed.join(who, "person", "left_semi").select(*rest.columns)
        self._write(rest.unionByName(new), 1 + max(g for g, _ in self.current().values()), touched)
        return touched

    def _write(self, rows: DataFrame, generation: int, touched: list[int] | None) -> None:
        data = f"{self.path}/data/generation={generation}"
        dealt = rows.withColumn("bucket", bucket_of(F.col("person"), self.buckets)).hint("rebalance", F.col("bucket"))
        dealt.sortWithinPartitions("bucket", "person").write.partitionBy("bucket").parquet(data)
        counts = {b: n for b, n in self._read(data).groupBy("bucket").count().collect()}
        lines = [(b, generation, counts.get(b, 0)) for b in (touched if touched is not None else range(self.buckets))]
        self.spark.createDataFrame(lines, "bucket int, generation int, rows long").coalesce(1).write.mode("append").parquet(f"{self.path}/index")

    # ------------------------------------------------------------------ reading
    def current(self) -> dict[int, tuple[int, int]]:
        """(generation, rows) of every bucket: a table of ``buckets`` rows."""
        last = self.spark.read.parquet(f"{self.path}/index").groupBy("bucket").agg(F.max(F.struct("generation", "rows")).alias("at"))
        return {r["bucket"]: tuple(r["at"]) for r in last.collect()}

    def table(self) -> DataFrame:
        """All current rows, with their ``bucket`` and ``generation``."""
        at = {b: g for b, (g, n) in self.current().items() if n}
        paths = [f"{self.path}/data/generation={g}/bucket={b}" for b, g in sorted(at.items())]
        return self._read(*paths) if paths else self._read(f"{self.path}/data").where(F.lit(False))

    def _read(self, *paths: str) -> DataFrame:
        columns = self.spark.read.parquet(f"{self.path}/schema").schema
        return self.spark.read.schema(StructType([*columns, *StructType.fromDDL("generation int, bucket int")])).option("basePath", f"{self.path}/data").parquet(*paths)

    def panel(self) -> DataFrame:
        return self.table().drop("bucket", "generation")

    def person(self, person: str) -> DataFrame:
        """One person's rows: the scan reads that person's bucket and no other."""
        b = self.spark.range(1).select(bucket_of(F.lit(person), self.buckets)).first()[0]
        return self.table().where((F.col("bucket") == b) & (F.col("person") == person)).drop("bucket", "generation")

    def drop_superseded(self) -> int:
        """Delete the folders that a later generation replaced; returns how many. Not while older readers run."""
        live = {(b, g) for b, (g, n) in self.current().items()}
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = 0
        for b, g in self.spark.read.parquet(f"{self.path}/index").select("bucket", "generation").distinct().collect():
            old = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/generation={g}/bucket={b}")
            if (b, g) not in live and fs.exists(old):
                gone += bool(fs.delete(old, True))
        return gone
