"""Which held documents are cited, and what is left to transcribe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceweave import vocab
from sourceweave.functions import text
from sourceweave.operators.projections import source_letter_ids
from sourceweave.physical import keyed_join


def citing_records(sources: DataFrame, record: Column) -> DataFrame:
    """Distinct (letter_id, record) pairs: a letter cited by a third of all records stays rows."""
    return sources.select(F.explode(source_letter_ids()).alias("letter_id"), record.alias("record")).distinct()


def coverage(matches: DataFrame, citing: DataFrame) -> DataFrame:
    """Every identified document with its state, page span and number of citing records."""
    counts = citing.groupBy("letter_id").agg(F.count(F.lit(1)).alias("citers"))
    pages = F.col("pages")
    span = F.when(F.size(pages) > 0, F.concat(
        F.lit("pp."), F.element_at(pages, 1).cast("string"), F.lit("-"), F.element_at(pages, -1).cast("string"))).otherwise("")
    state = F.coalesce(F.when(F.col("letter_id") != "", F.col("letter_id")),
                       F.when(F.coalesce(F.col("person"), F.lit("")) != "", "folder, not per letter"), F.lit("no id"))
    return keyed_join(matches, counts, ["letter_id"], "left").select(
        "archive", span.alias("span"), "letter_id", state.alias("state"), F.coalesce("citers", F.lit(0)).alias("citers"),
        F.coalesce(F.when(F.col("what") != "", F.col("what")), F.col("title"), F.lit("")).alias("label"), "person")


def uncited(covered: DataFrame) -> DataFrame:
    return covered.where(F.col("citers") == 0)


def linked_counts(covered: DataFrame) -> DataFrame:
    return covered.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("citers") > 0).alias("linked"),
                       F.count_if(F.col("citers") == 0).alias("unlinked"))


def same_folio_other_letter(citing: DataFrame, held: DataFrame) -> DataFrame:
    """Folios where a letter is cited that we do not hold while we hold another: (stem, letter_id, role).

    Cited and held letters are listed once each under their folio, not paired,
    so a folio with very many letters stays linear.
    """
    have = held.select("letter_id").distinct()
    missing = citing.select("letter_id").distinct().join(have, "letter_id", "left_anti").withColumn("stem", text.stem(F.col("letter_id")))
    near = have.withColumn("stem", text.stem(F.col("letter_id")))
    cited = missing.join(near.select("stem").distinct(), "stem", "left_semi").select("stem", "letter_id", F.lit("cited").alias("role"))
    ours = near.join(missing.select("stem").distinct(), "stem", "left_semi").select("stem", "letter_id", F.lit("held").alias("role"))
    return cited.unionByName(ours)


def tier(
    archive: Column, item: Column, what: Column, letter_id: Column, subject_pattern: str,
    incoming: list[str] | None = None, third_party: list[str] | None = None, excluded: list[str] | None = None,
    printed_prefix: str = vocab.PRINTED_PREFIX,
) -> Column:
    """The tier of a held document; the first rule that applies decides.

    ``subject_pattern`` recognises a note that the letter was written TO the person the corpus is about.
    """
    incoming = vocab.INCOMING_ITEMS if incoming is None else incoming
    third_party = vocab.THIRD_PARTY_ITEMS if third_party is None else third_party
    excluded = vocab.EXCLUDED_ARCHIVES if excluded is None else excluded
    note, lid = F.coalesce(what, F.lit("")), F.coalesce(letter_id, F.lit(""))
    return (
        F.when(archive.isin(excluded), "excluded")
        .when(note.rlike(vocab.NOT_A_DOCUMENT), "not-a-document")
        .when(note.rlike(vocab.TYPESCRIPT_NOTE), "typescript")
        .when(note.rlike(vocab.PHOTOSTAT_NOTE), "photostat")
        .when(item.isin(third_party), "third-party")
        .when(F.startswith(lid, F.lit(printed_prefix)), "autograph-printed")
        .when(item.isin(incoming) | note.rlike(subject_pattern), "autograph-incoming")
        .otherwise("autograph-unprinted")
    )


def backlog(matches: DataFrame, transcribed: DataFrame, subject_pattern: str, **rules) -> DataFrame:
    """Manifest matches with tier and whether a transcription carries their letter id."""
    done = transcribed.select("letter_id").where(F.coalesce("letter_id", F.lit("")) != "").distinct().withColumn("done", F.lit(True))
    what = F.coalesce(F.when(F.col("what") != "", F.col("what")), F.col("title"), F.lit(""))
    return matches.join(done, "letter_id", "left").select(
        "archive", "item", "pages", what.alias("what"), "letter_id", F.coalesce("box_folder", F.lit("")).alias("box_folder"),
        tier(F.col("archive"), F.col("item"), what, F.col("letter_id"), subject_pattern, **rules).alias("tier"),
        F.coalesce("done", F.lit(False)).alias("done"))


def backlog_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("total"), F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("left"))


def skipped_rollup(rows: DataFrame) -> DataFrame:
    """Counts per (tier, archive, item, folder) of the tiers not worth transcribing, with the tier's subtotal."""
    return (
        rows.where(F.col("tier").isin(vocab.SKIPPED_TIERS))
        .groupingSets([["tier"], ["tier", "archive", "item", "box_folder"]], "tier", "archive", "item", "box_folder")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cited_pages(records: DataFrame, raw: str = "raw", citer: str = "record", pattern: str = text.PAGE_CITATION) -> DataFrame:
    """Distinct (page, citer) pairs named in provenance text, ranges expanded."""
    ranges = records.select(F.col(citer).alias("citer"), F.explode(text.cited_page_ranges(F.col(raw), pattern)).alias("r"))
    ok = ranges.where(F.col("r.last") >= F.col("r.first"))
    return ok.select(F.explode(F.sequence("r.first", "r.last")).alias("page"), "citer").distinct()
