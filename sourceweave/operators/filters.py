"""Visibility, search and facet predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceweave.functions import text


def loadable(df: DataFrame) -> DataFrame:
    """Records that could be read."""
    return df.where(F.col("load_error").isNull())


def complete_edges(relationships: DataFrame, people: DataFrame) -> DataFrame:
    """Edges whose two endpoints exist."""
    ids = people.select("id").distinct()
    out = relationships
    for i in (0, 1):
        out = out.join(ids.select(F.col("id").alias("__end")), F.col("people")[i] == F.col("__end"), "left_semi")
    return out


def map_edges(relationships: DataFrame) -> DataFrame:
    return relationships.where(F.col("certainty") != "platonic")


def excluded(value: Column, off: Sequence[str]) -> Column:
    """A missing value is the real member "" and can be excluded like any other."""
    return F.coalesce(value, F.lit("")).isin(list(off)) if off else F.lit(False)


def person_hidden(group: Column, gender: Column, off_groups: Sequence[str], off_genders: Sequence[str]) -> Column:
    """Excluded by group or by gender; an unrecorded gender is never excluded."""
    g = group.isin(list(off_groups)) if off_groups else F.lit(False)
    s = F.coalesce(gender.isin(list(off_genders)), F.lit(False)) if off_genders else F.lit(False)
    return F.coalesce(g, F.lit(False)) | s


def edge_visibility(
    edges: DataFrame, people: DataFrame, off_classes: Sequence[str] = (), search: bool = False
) -> DataFrame:
    """``hidden`` by class; ``dimmed`` by either end hidden, or under a search by neither end matching.

    ``people`` carries ``id, hidden`` and, for a search, ``matches``.
    """
    flags = people.select("id", "hidden", *(["matches"] if search else []))
    a = flags.select(*[F.col(c).alias(f"a_{c}") for c in flags.columns])
    b = flags.select(*[F.col(c).alias(f"b_{c}") for c in flags.columns])
    df = edges.join(a, F.col("people")[0] == F.col("a_id")).join(b, F.col("people")[1] == F.col("b_id"))
    dim = ~(F.col("a_matches") | F.col("b_matches")) if search else F.col("a_hidden") | F.col("b_hidden")
    return df.withColumn("hidden", F.col("certainty").isin(list(off_classes)) if off_classes else F.lit(False)).withColumn(
        "dimmed", dim).drop(*a.columns, *b.columns)


def all_connections_excluded(edges: DataFrame, people: DataFrame, off_classes: Sequence[str]) -> DataFrame:
    """Per person: has connections, and every one is of an excluded class."""
    off = F.col("certainty").isin(list(off_classes)) if off_classes else F.lit(False)
    per = edges.select(F.explode("people").alias("id"), off.alias("off")).groupBy("id").agg(F.every("off").alias("every_off"))
    return people.select("id").join(per, "id", "left").select("id", F.coalesce("every_off", F.lit(False)).alias("lead_only"))


def hit_kind(scope: str, name_hit: Column, quote_hit: Column, note_hit: Column) -> Column:
    """name before quote before note, within the scope; NULL when nothing matches."""
    kind = F.lit(None).cast("string")
    if scope == "all":
        kind = F.when(note_hit, "note").otherwise(kind)
    if scope != "names":
        kind = F.when(quote_hit, "quote").otherwise(kind)
    if scope != "quotes":
        kind = F.when(name_hit, "name").otherwise(kind)
    return kind


def filter_sources(
    rows: DataFrame,
    term: str = "",
    scope: str = "all",
    off: dict[str, Sequence[str]] | None = None,
    years: tuple[int | None, int | None] = (None, None),
    names: DataFrame | None = None,
) -> DataFrame:
    """Adds ``shown`` and ``undated_hidden``.

    ``rows`` carries ``hay_names, hay_quotes, hay_all``, a ``year`` and the facet
    columns. Years given backwards are read as the range they span. An undated
    row is hidden, and counted as such, only when a year is asked for and it
    passes everything else. ``names`` (person, card_order, name) holds all names of
    a card, one per row; a search among names also finds a card by any of them.
    Rows that carry ``found`` have had the term looked for already.
    """
    ok = F.col("found") if "found" in rows.columns else F.contains(F.col(f"hay_{scope}"), F.lit(term.strip().lower())) if term.strip() else F.lit(True)
    named = names is not None and scope == "names" and bool(term.strip())
    if named:
        found = names.where(F.contains(F.lower("name"), F.lit(term.strip().lower()))).select(F.struct("person", "card_order").alias("__card")).distinct().withColumn("__named", F.lit(True))
        rows = rows.withColumn("__card", F.struct("person", "card_order")).join(found, "__card", "left").drop("__card")
        ok = ok | F.col("__named").isNotNull()
    for facet, members in (off or {}).items():
        if members:
            ok = ok & ~excluded(F.col(facet), members)
    lo, hi = years
    if lo is not None and hi is not None and lo > hi:
        lo, hi = hi, lo
    y = F.col("year")
    undated = F.lit(False)
    in_range = F.lit(True)
    if lo is not None or hi is not None:
        undated = y.isNull()
        in_range = F.lit(True)
        if lo is not None:
            in_range = in_range & (y >= lo)
        if hi is not None:
            in_range = in_range & (y <= hi)
        in_range = F.coalesce(in_range, F.lit(False))
    return rows.withColumn("shown", ok & in_range).withColumn("undated_hidden", ok & undated).drop("__named")


def served_archives(archives: DataFrame) -> DataFrame:
    """Archives with an image service; the rest are not published."""
    return archives.where(F.trim(F.coalesce(F.col("iiif_url"), F.lit(""))) != "")


def pointers(sources: DataFrame) -> DataFrame:
    return sources.where(text.blank(F.col("quote")))


def quotations(sources: DataFrame) -> DataFrame:
    return sources.where(~text.blank(F.col("quote")))
