"""Gates and published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sourceweave.operators import filters


class GateClosed(RuntimeError):
    """Publication refused."""


def report(violations: DataFrame) -> DataFrame:
    """Findings per rule and severity."""
    return violations.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"), F.min("record").alias("first_record"))


def write_findings(violations: DataFrame, path: str) -> dict[str, int]:
    """Store the findings and return their number by severity, counted while they are written.

    The gate's verdict costs no scan of its own. The counts are taken in the
    stage that writes, where a task that is run again counts once.
    """
    seen = Observation("findings")
    severity = F.col("severity")
    violations.observe(seen, F.count_if(severity == "error").alias("errors"), F.count_if(severity == "warning").alias("warnings")).write.parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def gate_counts(counts: dict[str, int]) -> None:
    """``gate`` on the counts of ``write_findings``."""
    if counts["errors"]:
        raise GateClosed(f"the corpus has {counts['errors']} errors; see the findings table")


def gate(violations: DataFrame) -> None:
    """Raise when any error is left. One action, stopping at the first error found."""
    if not violations.where(F.col("severity") == "error").isEmpty():
        raise GateClosed("the corpus has errors; see the violations table")


def publishable(transcriptions: DataFrame, cited: DataFrame) -> DataFrame:
    """Cited letters only, without the column that says where the file lives."""
    return transcriptions.join(cited.select("letter_id").distinct(), "letter_id", "left_semi").drop("at")


def leaks(public: DataFrame, cited: DataFrame) -> DataFrame:
    """Texts of the printed edition that nothing cites."""
    return public.where(F.col("transcribed_from") == "printed").join(cited.select("letter_id").distinct(), "letter_id", "left_anti")


def assert_no_leaks(public: DataFrame, cited: DataFrame) -> None:
    if not leaks(public, cited).isEmpty():
        raise GateClosed("an uncited transcription of the printed edition would be published")


def publish_transcriptions(transcriptions: DataFrame, cited: DataFrame, path: str) -> None:
    public = publishable(transcriptions, cited)
    assert_no_leaks(public, cited)
    public.write.mode("overwrite").parquet(path)


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """One nested parquet table per entity under ``path``; records that could not be read stay out."""
    for name, df in tables.items():
        out = filters.loadable(df).drop("load_error", "raw", "file") if "load_error" in df.columns else df
        out.write.mode("overwrite").parquet(f"{path}/{name}")


def bundle_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """The same as (entity, json) rows, for readers that want JSON; nested values stay nested."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.lit(name).alias("entity"), F.to_json(F.struct("*")).alias("json"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_bundle(spark, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def ledger(relationships: DataFrame, sources: DataFrame, works: DataFrame) -> DataFrame:
    """One row per source in relationship order: opening words, citation and reading mark."""
    first = F.substring(F.replace(F.coalesce("quote", F.lit("")), F.lit("\n"), F.lit(" ")), 1, 60)
    opening = F.when(first != "", F.concat(first, F.lit(" …"))).otherwise(
        F.concat(F.lit("[POINTER] "), F.substring(F.coalesce("supports", F.lit("")), 1, 60)))
    cite = F.concat(
        F.coalesce("short_cite", "work", F.lit("—")),
        F.when(F.coalesce("locator", F.lit("")) != "", F.concat(F.lit(", "), "locator")).otherwise(""))
    mark = F.when(F.col("verified"), "read at the page").when(~F.col("verified"), "pending").otherwise("?")
    src = sources.join(works.select("work", "short_cite"), "work", "left")
    return relationships.select("id", "certainty").join(src.withColumnRenamed("owner_id", "id"), "id").select(
        "id", "certainty", "source_pos", "source_id" if "source_id" in sources.columns else F.lit(None).alias("source_id"),
        opening.alias("opening"), cite.alias("cite"), mark.alias("mark")).orderBy("id", "source_pos")


def compare_metrics(now: DataFrame, then: DataFrame, neutral: tuple[str, ...] = ("seed drift (median)",)) -> DataFrame:
    """(metric, was, now, verdict): fewer is better; neutral metrics never count as a regression."""
    n = now.select("metric", F.col("n").alias("now"))
    t = then.select("metric", F.col("n").alias("was"))
    df = n.join(t, "metric", "full").select("metric", F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"))
    verdict = F.when(F.col("was") == F.col("now"), "same").when(F.col("now") < F.col("was"), "better").otherwise("worse")
    return df.withColumn("verdict", verdict).withColumn("regressed", (F.col("verdict") == "worse") & ~F.col("metric").isin(list(neutral)))
