"""The corpus pipeline: documents through five of the operators, each stage on all that the one before it kept.

Quality rules reject documents; near-duplicates leave one document of each
group; documents with a notable share of benchmark words go; personal data gets
pseudonyms; and the rest is encoded into piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave.llm import feistel, fertility, piece_lattice, superminhash, wu_manber
from sourceweave.llm.common import read, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: no SQL: subword measures, keyed permutations and piece ids are outside it
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return fertility.quality(docs, carry=COLUMNS, bands=fertility.spread_bands(docs)).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return superminhash.deduplicated(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a notable share of benchmark words."""
    found = wu_manber.contamination(docs, read(spark, sf_dir, "benchmark"), carry=COLUMNS)
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    out = feistel.pseudonyms(docs, carry=COLUMNS, counts=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their pieces."""
    coded = piece_lattice.encode(docs, carry=COLUMNS)
    return coded.select(*COLUMNS, "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pseudonyms", pseudonyms), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
