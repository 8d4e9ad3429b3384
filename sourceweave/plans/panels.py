"""The read views: person, pair, relationship, list and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceweave.functions import dates, text
from sourceweave.operators import aggregates, dedup, filters, joins, ordering
from sourceweave.operators import projections as prj
from sourceweave.physical import lookup_side

_DATE = "struct<y:bigint,m:bigint,d:bigint>"


# what a card keeps when nobody names the columns
CARD_COLUMNS = [
    "source_id", "route", "label", "label_id", "owner_id", "quote", "translation", "translation_note", "context", "speaker",
    "addressee", "voice", "supports", "verified", "verified_with", "document", "citation_provenance", "order_hint",
    "occurred", "written", "sent", "postmarked", "received",
]


def person_cards(panel: DataFrame, columns: list[str] | None = None, told: dict[str, Column] | None = None) -> DataFrame:
    """One card per excerpt on a person's panel, in reading order columns."""
    df = ordering.with_source_order(panel)
    return dedup.merge_cards(df, [*(columns or ["work", "locator", *CARD_COLUMNS]), *ordering.SOURCE_ORDER], told=told)


def person_timeline(people: DataFrame, relationships: DataFrame, engagements: DataFrame) -> DataFrame:
    """Birth, edges and engagements by date, the undated after them, death always last.

    Sort by ``person, is_death, timeline_key (nulls last), kind, pos``.
    """
    key = lambda d: dates.timeline_key(d)
    none = F.lit(None).cast("string")
    born = people.where(F.col("born").isNotNull()).select(
        F.col("id").alias("person"), F.lit(False).alias("is_death"), key(F.col("born")["date"]).alias("timeline_key"),
        F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("pos"), none.alias("what"),
        F.coalesce(dates.date_label(F.col("born")["date"]), F.lit("date unknown")).alias("when"))
    died = people.where(F.col("died").isNotNull()).select(
        F.col("id").alias("person"), F.lit(True), key(F.col("died")["date"]), F.lit(3), F.lit(0).cast("bigint"), none,
        F.coalesce(dates.date_label(F.col("died")["date"]), F.lit("date unknown")))
    edges = relationships.select(
        F.explode("people").alias("person"), F.lit(False), key(F.col("start")["date"]), F.lit(1), F.col("pos").cast("bigint"),
        F.col("id"), dates.relationship_label(F.col("date_label"), F.col("start")["date"], F.col("end")["date"]))
    eng = engagements.select(
        F.col("owner_id"), F.lit(False), key(F.col("start")["date"]), F.lit(2), F.col("engagement_pos").cast("bigint"),
        F.col("subject"), dates.relationship_label(F.lit(""), F.col("start")["date"], F.col("end")["date"]))
    return born.union(edges).union(eng).union(died)


def relationship_list(relationships: DataFrame, sources: DataFrame, people: DataFrame) -> DataFrame:
    """All relationships with names, label and verification counts; sort by ``timeline_key`` nulls last, ``pos``."""
    # dates become a key and a label first: their structs would travel through every join
    told = relationships.select(
        "id", "pos", "people", "certainty", dates.timeline_key(F.col("start")["date"]).alias("timeline_key"),
        dates.relationship_label(F.col("date_label"), F.col("start")["date"], F.col("end")["date"]).alias("when"))
    counted = aggregates.with_edge_verification(told, sources)
    return joins.endpoint_attributes(counted, people, ["name"]).select(
        "id", "pos", "a_name", "b_name", "certainty", "ok", "pending", "timeline_key", "when")


def relationship_detail(relationships: DataFrame, sources: DataFrame, people: DataFrame) -> DataFrame:
    """Relationship head joined to its sources, with the source order as columns."""
    told = relationships.select(
        "id", "people", "certainty", dates.relationship_label(F.col("date_label"), F.col("start")["date"], F.col("end")["date"]).alias("when"))
    head = joins.endpoint_attributes(told, people, ["name"]).select(F.col("id").alias("owner_id"), "a_name", "b_name", "certainty", "when")
    src = ordering.with_source_order(sources)
    return head.join(src, "owner_id", "left")


def source_rows(cards: DataFrame, works: DataFrame | None, places: DataFrame) -> DataFrame:
    """What a panel filter looks at: three haystacks, a year and the seven facets.

    Without ``works`` the cards carry what is asked of their work already: ``w_author, w_editors, w_title, w_year, w_available``.
    """
    df = prj.with_effective_place(prj.with_location(cards, works), places)
    if works is not None:
        dim = lookup_side(works.select(F.col("work").alias("__w"), F.col("author").alias("w_author"),
                                      F.col("editors").alias("w_editors"), F.col("title").alias("w_title"),
                                      F.col("year").cast("string").alias("w_year")))
        df = df.join(dim, F.col("work") == F.col("__w"), "left")
    col = F.col
    said = [F.array_join(F.transform("turns", lambda t, k=k: t[k]), "  ") for k in ("who", "text")] if "turns" in df.columns else [F.lit(None).cast("string")] * 2
    names = text.haystack(col("speaker"), col("addressee"), col("w_author"), col("w_editors"), col("label"), said[0])
    quotes = text.haystack(col("quote"), col("translation"), col("translation_note"), said[1])
    everything = text.haystack(
        col("quote"), col("translation"), col("translation_note"), col("context"), col("speaker"), col("addressee"),
        col("supports"), col("locator"), col("citation_provenance"), col("verified_with"), col("w_title"), col("w_author"),
        col("w_editors"), col("w_year"), F.when(col("route") == 0, col("label")), col("order_hint")["why"], *said)
    return df.select(
        "person", "source_id", "route", "label", *[c for c in ("card_order", "card") if c in df.columns], names.alias("hay_names"), quotes.alias("hay_quotes"), everything.alias("hay_all"),
        prj.source_year().alias("year"), col("document"), col("location")["short"].alias("location"),
        col("place")["place_id"].alias("place_id"), *[col("place")[p].alias(p) for p in ("country", "region", "city", "street", "venue")])


def found_cards(rows: DataFrame, term: str, scope: str = "all", columns: list[str] | None = None, told: dict[str, Column] | None = None) -> DataFrame:
    """Cards of ``source_rows`` with ``found``, whether the card's first row holds the term, and ``columns`` of that row.

    A search among names finds a card by the name on any row folded into it.
    """
    t = F.lit(term.strip().lower())
    held = {"named": F.contains(F.lower("label"), t)} if scope == "names" else {}
    cards = dedup.merge_cards(rows.withColumn("found", F.contains(F.col(f"hay_{scope}"), t)), [*(columns or []), "found"], held=held, told=told)
    return cards.withColumn("found", F.col("found") | F.coalesce("named", F.lit(False))).drop("named") if held else cards


def folded_names(panel: DataFrame) -> DataFrame:
    """(person, card_order, name): every name a card's header can show, those of the rows folded into it included."""
    return dedup.card_names(dedup.merge_duplicates(panel)).select("person", F.col("primary").alias("card_order"), F.col("label").alias("name"))


FACETS = ["document", "location", "country", "region", "city", "street", "venue"]


def search_hits(people: DataFrame, relationships: DataFrame, sources: DataFrame, engagements: DataFrame, term: str, scope: str = "all") -> DataFrame:
    """(id, kind) for every person: which text of theirs holds the term.

    Texts are tested record by record and the answers OR-ed per person, so a
    hub's texts are never glued together. A term cannot match across two records.
    """
    t = F.lit(term.strip().lower())

    def has(*cols):
        return F.contains(text.haystack(*cols), t)

    opt = lambda df, n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    aka = F.array_join(F.coalesce("aka", F.array().cast("array<string>")), " ")
    name_text = F.lower(F.concat_ws(" ", "name", aka, F.coalesce("sort_name", F.lit(""))))
    own = people.select(
        "id", F.contains(name_text, t).alias("n"), has(F.col("bio")).alias("q"),
        has(opt(people, "bio_note"), opt(people, "roster_note")).alias("o"))
    src = sources.groupBy(F.col("owner_id").alias("rid")).agg(
        F.bool_or(has(F.col("quote"), F.col("translation"), F.col("context"), F.col("supports"))).alias("q"),
        F.bool_or(has(F.col("citation_provenance"), F.col("translation_note"), F.col("locator"), F.col("order_hint")["why"])).alias("o"))
    note = has(*[opt(relationships, c) for c in ("certainty_reasoning", "date_label", "sources_order_note", "prior_class")])
    if "disputed" in relationships.columns:
        d = F.col("disputed")
        note = note | has(d["claim"], d["asserted_by"], d["disputed_by"], d["grounds"])
    if "null_findings" in relationships.columns:
        note = note | has(F.to_json("null_findings"))
    rel = relationships.join(src, F.col("id") == F.col("rid"), "left").select(
        F.explode("people").alias("id"), F.lit(False).alias("n"),
        (has(opt(relationships, "summary")) | F.coalesce("q", F.lit(False))).alias("q"), (note | F.coalesce("o", F.lit(False))).alias("o"))
    eng = engagements.select(
        F.col("owner_id").alias("id"), F.lit(False).alias("n"), F.lit(False).alias("q"),
        has(F.col("subject"), *[opt(engagements, c) for c in ("note", "date_label", "period")]).alias("o"))
    hits = own.unionByName(rel).unionByName(eng).groupBy("id").agg(
        F.bool_or("n").alias("n"), F.bool_or("q").alias("q"), F.bool_or("o").alias("o"))
    return people.select("id").join(hits, "id", "left").select("id", filters.hit_kind(scope, F.col("n"), F.col("q"), F.col("o")).alias("kind"))
