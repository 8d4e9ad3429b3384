"""Heading extraction as a resumable stream.

The checkpoint records which files are done, so a restart neither repeats nor
skips any; each batch is written before the next is planned.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from sourceweave import schemas
from sourceweave.operators import headings
from sourceweave.session import shared_path


def heading_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON heading records as a file stream."""
    return spark.readStream.schema(schemas.HEADING).option("maxFilesPerTrigger", files_per_batch).option(
        "multiLine", True).json(path)


def order_heading_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Headings derived from the orders table, read as a stream of its files."""
    from sourceweave.catalog import text_queries

    schema = spark.read.parquet(f"{sf}/orders.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    return text_queries.headings_of(stream)


def run_headings(stream: DataFrame, aliases: DataFrame, target: str | None = None, state: str | None = None) -> DataFrame:
    """Process everything available, append the results to ``target`` and return them.

    Parsed and quarantined records go to one table with a status column. A batch
    that is replayed after a failure overwrites its own folder, so it counts once.
    """
    spark = stream.sparkSession
    target = target or shared_path(spark, "headings")
    state = state or shared_path(spark, "headings-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        results, _ = headings.extract(batch, aliases)
        results.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    try:
        return spark.read.parquet(target)
    except AnalysisException:  # no file has arrived yet
        return headings.extract(spark.createDataFrame([], stream.schema), aliases)[0]
