"""Counts and summaries. Every one is a hash or sort aggregation with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceweave import vocab
from sourceweave.functions import text


def dashboard(people: DataFrame, relationships: DataFrame, sources: DataFrame) -> DataFrame:
    """(metric, member, n): people, edges by class, verified and pending, pointers, voices.

    Only sources on relationships count here; pass other sources for the wider count.
    """
    one = lambda df, m: df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(m).alias("metric"), F.lit("").alias("member"), "n")
    empty = text.blank(F.col("quote"))
    per_source = sources.select(
        F.explode(F.array(
            F.struct(F.lit("quotes").alias("metric"), F.lit("").alias("member")),
            F.struct(F.when(F.coalesce("verified", F.lit(False)), "verified").otherwise("pending").alias("metric"), F.lit("").alias("member")),
            F.struct(F.when(empty, "pointers").otherwise("voice").alias("metric"),
                     F.when(empty, "").otherwise(F.coalesce("voice", F.lit("none"))).alias("member")),
        )).alias("x")).groupBy("x.metric", "x.member").agg(F.count(F.lit(1)).alias("n"))
    by_class = relationships.groupBy(F.coalesce("certainty", F.lit("none")).alias("member")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("certainty").alias("metric"), "member", "n")
    return one(people, "people").unionByName(one(relationships, "relationships")).unionByName(by_class).unionByName(per_source)


def verification_totals(sources: DataFrame) -> DataFrame:
    ok = F.coalesce(F.col("verified"), F.lit(False))
    return sources.agg(
        F.count_if(ok).alias("ok"), F.count_if(~ok).alias("pending"),
        F.count_if(F.coalesce(F.col("quote"), F.lit("")) == "").alias("pointers"), F.count(F.lit(1)).alias("total"))


def degrees(edges: DataFrame, people: DataFrame, name: str = "degree") -> DataFrame:
    """Edges per person, zero for those without."""
    per = edges.select(F.explode("people").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias(name))
    return people.select("id").join(per, "id", "left").select("id", F.coalesce(name, F.lit(0)).alias(name))


def with_edge_verification(relationships: DataFrame, sources: DataFrame) -> DataFrame:
    """The relationships with ``ok`` and ``pending``, their verified sources and the others."""
    ok = F.coalesce(F.col("verified"), F.lit(False))
    per = sources.groupBy(F.col("owner_id").alias("id")).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("pending"))
    return relationships.join(per, "id", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("ok", "pending")})


def edge_verification(relationships: DataFrame, sources: DataFrame) -> DataFrame:
    return with_edge_verification(relationships.select("id"), sources)


def facet_counts(rows: DataFrame, facets: Sequence[str]) -> DataFrame:
    """(facet, member, n) for all facets in one pass; a missing value is the member "".

    The facets are unpivoted before one aggregation, so a hot member combines on
    the map side like any other.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.coalesce(F.col(f), F.lit("")).alias("member")) for f in facets])
    return rows.select(F.inline(pairs)).groupBy("facet", "member").agg(F.count(F.lit(1)).alias("n"))


def facet_summary(counts: DataFrame) -> DataFrame:
    """Total per facet, and whether it has any member beyond the blank."""
    return counts.groupBy("facet").agg(F.sum("n").alias("total"), F.bool_or(F.col("member") != "").alias("live"))


def year_range(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def filter_counts(filtered: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return filtered.groupBy(*keys).agg(
        F.count_if("shown").alias("shown"), F.count(F.lit(1)).alias("total"),
        F.count_if("undated_hidden").alias("undated_hidden"))


def hit_counts(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("kind").isNotNull()).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def single_match(hits: DataFrame) -> DataFrame:
    """The only person matched by name, else the only person matched at all, else NULL."""
    named = F.count_if(F.col("kind") == "name")
    any_hit = F.count_if(F.col("kind").isNotNull())
    return hits.agg(
        F.when(named == 1, F.min(F.when(F.col("kind") == "name", F.col("id"))))
        .when(any_hit == 1, F.min(F.when(F.col("kind").isNotNull(), F.col("id")))).alias("pick"))


def label_clashes(people: DataFrame) -> DataFrame:
    """Shortened surnames that are also somebody else's surname as written."""
    own = people.select(
        "id", "name", F.coalesce("name_is_descriptor", F.lit(False)).alias("descriptor"),
        text.surname_of(F.col("name"), F.col("sort_name")).alias("surname"),
    ).withColumn("label", text.trimmed_surname(F.col("surname")))
    raw = own.groupBy(F.col("surname").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return own.join(raw, "label", "left").withColumn(
        "clash", F.coalesce(F.col("n"), F.lit(0)) - (F.col("surname") == F.col("label")).cast("int") > 0).drop("n")


def display_labels(people: DataFrame) -> DataFrame:
    c = label_clashes(people)
    return c.select("id", text.display_label(F.col("name"), F.col("label"), F.col("clash"), F.col("descriptor")).alias("label"))


def venue_words() -> Column:
    """The words of a venue, sorted."""
    return F.array_join(F.array_sort(F.filter(F.split(F.replace(F.lower("venue"), F.lit("."), F.lit("")), r"\s+"), lambda w: w != "")), " ")


def same_word_venues(places: DataFrame) -> DataFrame:
    """Venues of one city made of the same words in another order."""
    return (
        places.where(F.coalesce("venue", F.lit("")) != "").groupBy("city", venue_words().alias("words"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("place_id").alias("first_id"), F.max("place_id").alias("last_id"))
        .where(F.col("n") > 1))


def identical_places(places: DataFrame) -> DataFrame:
    return (
        places.groupBy(*vocab.PLACE_FIELDS)
        .agg(F.count(F.lit(1)).alias("n"), F.min("place_id").alias("first_id"), F.max("place_id").alias("last_id"))
        .where(F.col("n") > 1))


def unmapped_places(raw: DataFrame) -> DataFrame:
    """Raw place text that resolves to nothing: files carrying it, and one of them."""
    return raw.groupBy("place_text").agg(F.countDistinct("file").alias("files"), F.min("file").alias("example"))


def extraction_summary(results: DataFrame) -> DataFrame:
    s = F.col("status")
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "parsed").alias("parsed"),
        F.count_if(s == "flagged").alias("flagged"), F.count_if(s == "skipped").alias("skipped"))


def publication_summary(pages: DataFrame, located: DataFrame, held: DataFrame, cited: DataFrame) -> DataFrame:
    """(metric, n): pages indexed, facsimiles shown, documents located, letters held, held twice, waiting."""
    def metric(df: DataFrame, name: str, agg) -> DataFrame:
        return df.agg(agg.alias("n")).select(F.lit(name).alias("metric"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))

    derived = [v[0] for v in vocab.DERIVED_LOCATION.values()]
    letters = held.groupBy("letter_id").agg(
        F.count(F.lit(1)).alias("readings"), F.bool_or(F.col("transcribed_from") == "facsimile").alias("fac"))
    waiting = letters.where(~F.col("fac")).join(cited.select("letter_id").distinct(), "letter_id", "left_anti")
    return (
        metric(pages, "pages indexed", F.count(F.lit(1)))
        .unionByName(metric(located, "documents located", F.count_if(~F.col("location")["short"].isin(derived))))
        .unionByName(metric(held, "held", F.count(F.lit(1))))
        .unionByName(metric(held, "from the edition", F.count_if(F.col("transcribed_from") == "printed")))
        .unionByName(metric(letters, "held twice", F.sum(F.col("readings") - 1)))
        .unionByName(metric(waiting, "waiting", F.count(F.lit(1))))
    )
