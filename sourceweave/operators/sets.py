"""Unions and differences of holders, letters and places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceweave.operators.projections import source_letter_ids


def holders(edge_sources: DataFrame, own_sources: DataFrame) -> DataFrame:
    return edge_sources.unionByName(own_sources, allowMissingColumns=True)


def cited_letters(sources: DataFrame) -> DataFrame:
    """Every letter any source names, by the single field or by the list."""
    return sources.select(F.explode(source_letter_ids()).alias("letter_id")).distinct()


def unused(all_ids: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return all_ids.select(key).join(used.select(key).distinct(), key, "left_anti")


def waiting(held: DataFrame, cited: DataFrame) -> DataFrame:
    """Letters held only as the edition prints them, and cited by nothing."""
    letters = held.groupBy("letter_id").agg(F.bool_or(F.col("transcribed_from") == "facsimile").alias("fac"))
    return letters.where(~F.col("fac")).select("letter_id").join(cited, "letter_id", "left_anti")
