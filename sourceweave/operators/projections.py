"""Projections over relationships, engagements and their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceweave import schemas, vocab
from sourceweave.functions import records, text
from sourceweave.physical import keyed_join, lookup_side, small_side


# ------------------------------------------------------------------ flattening
def explode_sources(relationships: DataFrame) -> DataFrame:
    """One row per source of a relationship, position kept; a relationship without any keeps one empty row."""
    return relationships.select(
        F.lit("relationship").alias("owner_kind"), F.col("id").alias("owner_id"), "people",
        F.lit(None).cast("bigint").alias("engagement_pos"), F.lit(None).cast("string").alias("subject"),
        F.posexplode_outer("sources").alias("source_pos", "source"),
    ).select("owner_kind", "owner_id", "people", "engagement_pos", "subject",
             F.col("source_pos").cast("bigint").alias("source_pos"), "source.*")


def explode_engagements(people: DataFrame) -> DataFrame:
    """One row per context engagement of a person."""
    return people.select(
        F.col("id").alias("owner_id"), F.posexplode_outer("sexuality_sources").alias("engagement_pos", "engagement")
    ).select("owner_id", F.col("engagement_pos").cast("bigint").alias("engagement_pos"), "engagement.*")


def explode_engagement_sources(people: DataFrame) -> DataFrame:
    """Two levels down: person, engagement, source."""
    return (
        explode_engagements(people)
        .select("owner_id", "engagement_pos", "subject", F.posexplode_outer("sources").alias("source_pos", "source"))
        .select(F.lit("person").alias("owner_kind"), "owner_id", F.array("owner_id").alias("people"), "engagement_pos",
                "subject", F.col("source_pos").cast("bigint").alias("source_pos"), "source.*")
    )


def all_sources(relationships: DataFrame, people: DataFrame) -> DataFrame:
    """Every source, whoever holds it; rows without a source are dropped here."""
    return explode_sources(relationships).unionByName(explode_engagement_sources(people)).where(
        F.col("source_pos").isNotNull())


# ------------------------------------------------------------------ dates and places of a source
def act_date(act: Column) -> Column:
    return act["date"]


def source_dates(sources: DataFrame, keys: list[str]) -> DataFrame:
    """Every date a source carries, as (act, date) rows."""
    pairs = F.array(*[
        F.struct(F.lit(a).alias("act"), F.col(a)["date"].alias("date")) for a in [*vocab.ACTS, "occurred"]])
    return sources.select(*keys, F.inline(F.filter(pairs, lambda p: p["date"].isNotNull())))


def effective_date() -> Column:
    """The event's date first, then the document's own, in the order a letter goes through its acts."""
    return F.coalesce(*[F.col(a)["date"] for a in vocab.DATED_ORDER])


def source_year() -> Column:
    return F.coalesce(effective_date()["y"], F.col("order_hint")["y"])


def with_effective_place(sources: DataFrame, places: DataFrame) -> DataFrame:
    """The gazetteer row of the first act whose place resolves, as ``place`` struct.

    One lookup per act, so a gazetteer that fits is broadcast five times and no
    row moves; a larger one falls back to shuffled joins.
    """
    entry = F.struct("place_id", *vocab.PLACE_FIELDS)
    dim = small_side(places.select(F.col("place_id").alias("__key"), entry.alias("__entry")))
    out = sources
    for a in vocab.DATED_ORDER:
        out = out.join(dim.select(F.col("__key").alias(f"__k_{a}"), F.col("__entry").alias(f"__p_{a}")),
                       F.col(a)["place"] == F.col(f"__k_{a}"), "left").drop(f"__k_{a}")
    return out.withColumn("place", F.coalesce(*[F.col(f"__p_{a}") for a in vocab.DATED_ORDER])).drop(
        *[f"__p_{a}" for a in vocab.DATED_ORDER])


def counterpart(people: Column, person: Column, of: Column | None = None) -> Column:
    """The other of two people, or what ``of`` holds in their place."""
    of = people if of is None else of
    return F.when(people[0] == person, of[1]).otherwise(of[0])


# ------------------------------------------------------------------ where a document is
def work_availability(kind: Column | None = None, publisher: Column | None = None, scan: Column | None = None) -> Column:
    """Whether a copy of the work can be had, from its joined kind, publisher and scan id."""
    kind, publisher, scan = (F.coalesce(F.col(n) if c is None else c, F.lit("")) for n, c in (("kind", kind), ("publisher", publisher), ("ia_id", scan)))
    return F.when(F.endswith(kind, F.lit("-web")), "online").when((publisher != "") | (scan != ""), "published").otherwise("unknown")


def with_location(sources: DataFrame, works: DataFrame | None, archives: DataFrame | None = None) -> DataFrame:
    """Adds ``location``: the archive of the facsimile, else the manuscript's repository, else a derived answer.

    ``sources`` needs ``work, document, manuscript`` and, with archives, ``facsimile``. Without ``works`` they carry
    ``w_available``, the work's availability, already.
    """
    if works is None:
        df = sources.withColumns({"__work": F.col("work"), "__avail": F.col("w_available")})
    else:
        dim = lookup_side(works.select(F.col("work").alias("__work"), work_availability().alias("__avail")))
        df = sources.join(dim, F.col("work") == F.col("__work"), "left")
    m = F.col("manuscript")
    short = F.create_map(*[F.lit(x) for kv in vocab.REPOSITORY_SHORT.items() for x in kv])
    empty = F.lit(None).cast("string")
    held = F.lit(None).cast("struct<short:string,full:string>")
    if archives is not None:
        arc = small_side(archives.select(F.col("archive").alias("__archive"), F.coalesce("name", F.lit("")).alias("__full"),
                                         F.col("short_name").alias("__short")))
        df = df.join(arc, F.col("facsimile")["archive"] == F.col("__archive"), "left")
        full = F.coalesce(F.col("__full"), F.lit(""))
        name = F.coalesce(F.try_element_at(short, full), F.when(F.col("__short") != "", F.col("__short")),
                          F.when(full != "", text.short_repository(full)))
        held = F.when(F.col("facsimile").isNotNull() & name.isNotNull(), F.struct(name.alias("short"), full.alias("full")))
    tail = ["archived_as", "as_of", "recorded_by", "owner"]
    rep = F.trim(m["repository"])
    avail = F.when(F.col("document").isin(vocab.UNIQUE_KINDS), F.lit("unknown")).otherwise(
        F.coalesce(F.col("__avail"), F.lit("unknown")))
    derived_short = F.create_map(*[F.lit(x) for k, v in vocab.DERIVED_LOCATION.items() for x in (k, v[0])])
    derived_full = F.create_map(*[F.lit(x) for k, v in vocab.DERIVED_LOCATION.items() for x in (k, v[1])])
    location = (
        F.when(held.isNotNull(), F.struct(held["short"].alias("short"), held["full"].alias("full"),
                                          *[empty.alias(t) for t in tail]))
        .when(F.coalesce(rep, F.lit("")) != "",
              F.struct(text.short_repository(rep).alias("short"), rep.alias("full"),
                       *[F.when(m[t] != "", m[t]).alias(t) for t in tail]))
        .otherwise(F.struct(derived_short[avail].alias("short"), derived_full[avail].alias("full"),
                            *[empty.alias(t) for t in tail]))
    )
    return df.withColumn("location", location).drop("__work", "__avail", "__archive", "__full", "__short")


def last_recorded(works: DataFrame, located: DataFrame) -> DataFrame:
    """Who says the document is there, and in which words the statement is made.

    Adds ``recorded_by`` (the named recorder, else the work's editors with its
    citation, else the citation) and ``held_statement``.
    """
    dim = lookup_side(works.select(F.col("work").alias("__work"), "editors", "short_cite"))
    loc = F.col("location")
    eds = F.trim(F.regexp_replace(F.substring_index(F.col("editors"), ";", 1), r"\s*\([^)]*\)", ""))
    by = F.coalesce(
        F.when(loc["recorded_by"] != "", loc["recorded_by"]),
        F.when(eds != "", F.concat(eds, F.lit(", in "), F.col("short_cite"))),
        F.when(F.col("short_cite") != "", F.col("short_cite")),
    )
    said = F.coalesce(F.concat(F.lit("Last recorded by "), by), F.lit("Last recorded"))
    statement = (
        F.when(loc["full"] == "Private collection",
               F.concat(said, F.lit(" as belonging to "), F.coalesce(loc["owner"], F.lit("a private owner it does not name"))))
        .when(loc["full"].isin([v[1] for v in vocab.DERIVED_LOCATION.values()]), loc["full"])
        .when(loc["as_of"].isNotNull(), F.concat(F.lit("Last known at "), loc["full"], F.lit(", "), loc["as_of"]))
        .when(loc["archived_as"] == "typescript", F.concat(said, F.lit(" as a typescript at "), loc["full"]))
        .when(loc["archived_as"] == "autograph", F.concat(said, F.lit(" as surviving in manuscript at "), loc["full"]))
        .when(F.col("manuscript").isNotNull(), F.concat(said, F.lit(" at "), loc["full"]))
        .otherwise(F.concat(F.lit("Held at "), loc["full"]))
    )
    return located.join(dim, F.col("work") == F.col("__work"), "left").withColumn("recorded_by", by).withColumn(
        "held_statement", statement).drop("__work", "editors", "short_cite")


# ------------------------------------------------------------------ facsimiles
def resolve_facsimiles(sources: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """The cited pages that exist, in cited order; sources without any lose their facsimile.

    Returns rows ``keys, archive, item, page_pos, page, caption``: a folder of any
    size stays a set of rows.
    """
    f = F.col("facsimile")
    cited = sources.where(f.isNotNull()).select(
        *keys, f["archive"].alias("archive"), f["item"].alias("item"),
        F.when(F.trim(f["caption"]) != "", F.trim(f["caption"])).alias("caption"),
        F.posexplode(f["pages"]).alias("page_pos", "page"))
    return keyed_join(cited, pages.select("archive", "item", "page").distinct(), ["archive", "item", "page"], "left_semi")


def facsimile_strip(cited_pages: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """The letter's own pages first, then the rest of its folder flagged ``rest``."""
    own = cited_pages.select(*keys, "archive", "item", "page", F.lit(True).alias("own")).distinct()
    folders = own.select(*keys, "archive", "item").distinct()
    every = folders.join(pages.select("archive", "item", "page"), ["archive", "item"])
    return every.join(own, [*keys, "archive", "item", "page"], "left").select(
        *keys, "archive", "item", "page", F.col("own").isNull().alias("rest"))


def image_address(template: Column, pointer: Column, page: Column, size: str = "full") -> Column:
    """Fill ``{pointer}`` and ``{page}``; percent-encode them the way a URI component is."""
    enc = lambda c: F.replace(F.url_encode(F.coalesce(c, F.lit(""))), F.lit("+"), F.lit("%20"))
    base = F.replace(F.replace(template, F.lit("{pointer}"), enc(pointer)), F.lit("{page}"), enc(page.cast("string")))
    return F.when(F.coalesce(template, F.lit("")) != "", F.concat(base, F.lit(f"/full/{size}/0/default.jpg"))).otherwise("")


# ------------------------------------------------------------------ reading flags
def with_reading_flags(sources: DataFrame, published: DataFrame) -> DataFrame:
    """``full_text``: the single letter id has a published text. ``is_cut``: the quotation is elided."""
    ids = published.select("letter_id").distinct().withColumn("__held", F.lit(True))
    return (
        keyed_join(sources, ids, ["letter_id"], "left")
        .withColumn("full_text", F.col("__held").isNotNull())
        .withColumn("is_cut", F.contains(F.coalesce(F.col("quote"), F.lit("")), F.lit("…")))
        .drop("__held")
    )


def is_pointer() -> Column:
    """A source that quotes nothing yet."""
    return text.blank(F.col("quote"))


def source_letter_ids() -> Column:
    return records.letter_ids(F.col("letter_id"), F.col("letter_ids"))


SOURCE_FIELDS = [f.name for f in schemas.SOURCE]
