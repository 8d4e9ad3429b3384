"""Rules as columns.

A rule is a condition that is true for a bad record. All rules of an entity are
evaluated in one pass over it: an array of findings per record, exploded.
Rules that compare records with each other are joins of their own and are
unioned to the same findings table.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "struct<rule:string,severity:string,path:string,message:string>"


@dataclass(frozen=True)
class Rule:
    id: str
    bad: Column
    message: str
    severity: str = "error"
    path: Column | str = ""


def finding(r: Rule, path: Column | None = None) -> Column:
    at = path if path is not None else (F.lit(r.path) if isinstance(r.path, str) else r.path)
    return F.when(r.bad, F.struct(
        F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), at.alias("path"), F.lit(r.message).alias("message")))


def findings(rules: Iterable[Rule], path: Column | None = None) -> Column:
    return F.array_compact(F.array(*[finding(r, path) for r in rules]))


def evaluate(df: DataFrame, entity: str, record: Column, *groups: Column) -> DataFrame:
    """(rule, severity, entity, record, path, message), one row per finding."""
    return df.select(record.alias("record"), F.inline(F.concat(*groups))).select(
        "rule", "severity", F.lit(entity).alias("entity"), "record", "path", "message")


def as_findings(df: DataFrame, rule: str, entity: str, record: Column, message: str, severity: str = "error", path: Column | None = None) -> DataFrame:
    """Turn the rows of a relational check into findings."""
    return df.select(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(entity).alias("entity"), record.cast("string").alias("record"),
        (path if path is not None else F.lit("")).alias("path"), F.lit(message).alias("message"))


def union(parts: Iterable[DataFrame]) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out
