"""Reference checks, name resolution and the panel unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceweave import vocab
from sourceweave.functions import text
from sourceweave.operators import projections as prj
from sourceweave.physical import first_row, keyed_join, small_side


# ------------------------------------------------------------------ reference checks
def unknown_people(relationships: DataFrame, people: DataFrame) -> DataFrame:
    """(id, person) for every endpoint that is not a person."""
    ends = relationships.select("id", F.explode("people").alias("person"))
    return ends.join(people.select(F.col("id").alias("person")), "person", "left_anti").select("id", "person")


def people_without_relationship(relationships: DataFrame, people: DataFrame) -> DataFrame:
    ends = relationships.select(F.explode("people").alias("id")).distinct()
    return people.select("id").join(ends, "id", "left_anti")


def unknown_works(sources: DataFrame, works: DataFrame) -> DataFrame:
    return sources.where(F.coalesce(F.col("work"), F.lit("")) != "").join(works.select("work"), "work", "left_anti")


def place_references(df: DataFrame, keys: list[str], acts: list[str], lists: list[str] | None = None) -> DataFrame:
    """Every place a record names, as ``keys, path, place`` rows."""
    refs = [F.array(F.struct(F.lit(a).alias("path"), F.col(a)["place"].alias("place"))) for a in acts]
    for name in lists or []:
        refs.append(F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")),
                                lambda p, n=name: F.struct(F.lit(n).alias("path"), p.alias("place"))))
    return df.select(*keys, F.inline(F.concat(*refs))).where(F.col("place").isNotNull())


def unknown_places(references: DataFrame, places: DataFrame) -> DataFrame:
    return references.join(places.select(F.col("place_id").alias("place")), "place", "left_anti")


def unused_places(references: DataFrame, places: DataFrame) -> DataFrame:
    used = references.select(F.col("place").alias("place_id")).distinct()
    return places.select("place_id").join(used, "place_id", "left_anti")


def raw_place_references(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Place ids found by shape in raw JSON text: the value of any "place", any member of a "places" list."""
    one = F.regexp_extract_all(F.col(column), F.lit(r'"place"\s*:\s*"([^"]*)"'), F.lit(1))
    many = F.flatten(F.transform(
        F.regexp_extract_all(F.col(column), F.lit(r'"places"\s*:\s*\[([^\]]*)\]'), F.lit(1)),
        lambda body: F.regexp_extract_all(body, F.lit(r'"([^"]*)"'), F.lit(1))))
    return raw.select(F.explode(F.concat(one, many)).alias("place")).distinct()


# ------------------------------------------------------------------ names
def name_keys(people: DataFrame) -> DataFrame:
    """(key, id) for every spelling of a person: name, sort name, sort name turned round, each alias."""
    sn = F.col("sort_name")
    turned = F.when(F.contains(sn, F.lit(",")), F.concat(
        F.trim(F.split_part(sn, F.lit(","), F.lit(2))), F.lit(" "), F.trim(F.split_part(sn, F.lit(","), F.lit(1)))))
    spellings = F.concat(F.array(F.col("name"), sn, turned), F.coalesce(F.col("aka"), F.array().cast("array<string>")))
    return people.select(F.explode(spellings).alias("spelling"), "id").select(
        text.name_key(F.col("spelling")).alias("key"), "id").where(F.col("key") != "")


def unique_name_index(people: DataFrame) -> DataFrame:
    """key → id for keys that name exactly one person; an ambiguous key resolves to nobody."""
    return (
        name_keys(people).groupBy("key").agg(F.min("id").alias("id"), F.max("id").alias("__last"))
        .where(F.col("id") == F.col("__last")).select("key", "id")
    )


def resolve_names(df: DataFrame, column: str, index: DataFrame, out: str) -> DataFrame:
    """Left join on the name key. The distinct names are resolved first, so a
    subject that fills a third of the rows is folded once."""
    names = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("__key", text.name_key(F.col(column)))
    found = names.join(index.select(F.col("key").alias("__key"), F.col("id").alias(out)), "__key").select(column, out)
    return df.join(found, column, "left")


def surname_candidates(people: DataFrame) -> DataFrame:
    """(surname, name): the last word of every spelling, with the person's own name."""
    spellings = F.concat(F.array("name"), F.coalesce(F.col("aka"), F.array().cast("array<string>")))
    return people.select(F.explode(spellings).alias("s"), "name").where(F.coalesce(F.col("s"), F.lit("")) != "").select(
        F.lower(F.element_at(F.split(F.trim("s"), r"\s+"), -1)).alias("surname"), "name").distinct()


def bare_surnames(letters: DataFrame, people: DataFrame, column: str, record: str = "letter_id") -> DataFrame:
    """Correspondents given as a surname only, with how many people it could be.

    Who they are is one row per person in ``surname_candidates``; a common
    surname is not multiplied by the letters that carry it.
    """
    known = people.select(F.explode(F.concat(F.array("name"), F.coalesce(F.col("aka"), F.array().cast("array<string>")))).alias("n")).select(
        F.lower("n").alias("__v")).distinct()
    bearers = surname_candidates(people).groupBy(F.col("surname").alias("__v")).agg(F.count(F.lit(1)).alias("candidates"))
    who = letters.select(record, F.trim(F.col(column)).alias("value")).withColumn("__v", F.lower("value")).where(F.col("__v") != "")
    return who.join(known, "__v", "left_anti").join(bearers, "__v").select(record, "value", "candidates")


# ------------------------------------------------------------------ excerpts
def excerpt_columns() -> list:
    return [F.col("work"), F.col("locator"), text.excerpt_key(F.col("quote")).alias("excerpt")]


def excerpt_on_engagement_and_edge(edge_sources: DataFrame, own_sources: DataFrame) -> DataFrame:
    """An excerpt on a person's engagement and also on an edge they are party to: (person, source, first edge)."""
    edges = edge_sources.select(F.explode("people").alias("person"), *excerpt_columns(), "owner_id").where(F.col("excerpt") != "")
    first = edges.groupBy("person", "work", "locator", "excerpt").agg(F.min("owner_id").alias("edge"))
    own = own_sources.select(F.col("owner_id").alias("person"), *excerpt_columns(), "source_id").where(F.col("excerpt") != "").alias("o")
    f = first.alias("f")
    same = (
        (F.col("o.person") == F.col("f.person")) & (F.col("o.excerpt") == F.col("f.excerpt"))
        & F.col("o.work").eqNullSafe(F.col("f.work")) & F.col("o.locator").eqNullSafe(F.col("f.locator"))
    )
    return own.join(f, same).select("o.person", "o.source_id", "o.work", "o.locator", "f.edge")


# ------------------------------------------------------------------ panels
ROUTE_EDGE, ROUTE_OWN, ROUTE_NAMED = 0, 1, 2


def person_panel(edge_sources: DataFrame, own_sources: DataFrame, people: DataFrame) -> DataFrame:
    """Every source attached to a person, by three routes, before merging.

    The routes: sources of their edges, sources of their own engagements, and
    sources of other people's engagements that name them. ``card_order`` is the
    order they are met in. ``edge_sources`` needs ``owner_pos`` (edge position)
    and ``own_sources`` needs ``owner_pos`` (person position).
    """
    index = unique_name_index(people)
    ids = people.select("id", "name")
    by_edge = edge_sources.select(
        F.explode("people").alias("person"), "*").withColumn("counterpart", prj.counterpart(F.col("people"), F.col("person")))
    by_edge = by_edge.join(ids.select(F.col("id").alias("counterpart"), F.col("name").alias("label")), "counterpart", "left").drop("counterpart")
    own = resolve_names(own_sources, "subject", index, "subject_id").join(
        ids.select(F.col("id").alias("owner_id"), F.col("name").alias("owner_name")), "owner_id", "left")
    return _panel(by_edge, own)


def named_panel(edge_sources: DataFrame, own_sources: DataFrame) -> DataFrame:
    """``person_panel`` of sources that carry their names: a projection, so nothing is shuffled and only what is asked for is read.

    ``edge_sources`` has ``names`` beside ``people``; ``own_sources`` has ``owner_name`` and ``subject_id``, the person its subject names.
    """
    label = prj.counterpart(F.col("people"), F.col("person"), F.col("names"))
    return _panel(edge_sources.select(F.explode("people").alias("person"), "*").withColumn("label", label).drop("names"), own_sources)


def _panel(by_edge: DataFrame, own: DataFrame) -> DataFrame:
    by_edge = by_edge.withColumns({"route": F.lit(ROUTE_EDGE), "label_id": prj.counterpart(F.col("people"), F.col("person"))})
    # one pass over the engagements gives both their rows: the owner's and the named person's
    owner, subject = F.col("owner_id"), F.col("subject_id")
    other = F.when(subject != owner, subject)
    row = lambda person, route, label, label_id: F.struct(
        person.alias("person"), F.lit(route).alias("route"), label.alias("label"), label_id.alias("label_id"))
    rows = F.array_compact(F.array(
        row(owner, ROUTE_OWN, F.col("subject"), other),
        F.when(other.isNotNull(), row(other, ROUTE_NAMED, F.col("owner_name"), owner))))
    by_engagement = own.select("*", F.inline(rows)).drop("subject_id", "owner_name")
    flat = by_edge.unionByName(by_engagement)
    order = F.struct("route", "owner_pos", F.coalesce("engagement_pos", F.lit(0)).alias("engagement_pos"), "source_pos", "source_id")
    return flat.withColumn("card_order", order)


def pair_panel(edge_sources: DataFrame, own_sources: DataFrame, people: DataFrame, x: str, y: str) -> DataFrame:
    """The sources that put two people in one frame: their edge's, then x's engagements naming y, then y's naming x."""
    edge = edge_sources.where(F.array_sort(F.array(F.lit(x), F.lit(y))) == F.array_sort("people")).withColumn("route", F.lit(0))
    own = resolve_names(own_sources.where(F.col("owner_id").isin(x, y)), "subject", unique_name_index(people), "__subject_id")
    named = own.where(
        ((F.col("owner_id") == x) & (F.col("__subject_id") == y)) | ((F.col("owner_id") == y) & (F.col("__subject_id") == x))
    ).withColumn("route", F.when(F.col("owner_id") == x, 1).otherwise(2)).drop("__subject_id")
    flat = edge.unionByName(named)
    order = F.struct("route", "owner_pos", F.coalesce("engagement_pos", F.lit(0)).alias("engagement_pos"), "source_pos", "source_id")
    return flat.withColumn("person", F.lit(f"{x}|{y}")).withColumn("card_order", order)


def pair_panels_of(panel: DataFrame) -> DataFrame:
    """``all_pair_panels`` out of a person panel: one pass, no join.

    An edge's source stands on both persons' panels and is taken from the first;
    an engagement that names somebody is taken from its owner's.
    """
    first = F.array_min("people")
    kept = panel.where(((F.col("route") == ROUTE_EDGE) & (F.col("person") == first)) | ((F.col("route") == ROUTE_OWN) & F.col("label_id").isNotNull()))
    pair = F.when(F.col("route") == ROUTE_EDGE, F.col("people")).otherwise(F.array("owner_id", "label_id"))
    route = F.when(F.col("route") == ROUTE_EDGE, 0).when(F.col("owner_id") < F.col("label_id"), 1).otherwise(2)
    order = F.struct("route", "owner_pos", F.coalesce("engagement_pos", F.lit(0)).alias("engagement_pos"), "source_pos", "source_id")
    return kept.withColumns({"person": F.array_join(F.array_sort(pair), "--"), "route": route}).withColumn("card_order", order)


def all_pair_panels(edge_sources: DataFrame, own_sources: DataFrame, people: DataFrame) -> DataFrame:
    """The pair view for every pair at once, keyed by the sorted pair."""
    named = resolve_names(own_sources, "subject", unique_name_index(people), "__subject_id").where(
        F.col("__subject_id") != F.col("owner_id"))
    pair = F.array_join(F.array_sort(F.array(F.col("owner_id"), F.col("__subject_id"))), "--")
    from_own = named.withColumn("person", pair).withColumn(
        "route", F.when(F.col("owner_id") < F.col("__subject_id"), 1).otherwise(2)).drop("__subject_id")
    from_edge = edge_sources.withColumn("person", F.array_join(F.array_sort("people"), "--")).withColumn("route", F.lit(0))
    order = F.struct("route", "owner_pos", F.coalesce("engagement_pos", F.lit(0)).alias("engagement_pos"), "source_pos", "source_id")
    return from_edge.unionByName(from_own).withColumn("card_order", order)


def endpoint_attributes(edges: DataFrame, people: DataFrame, columns: list[str]) -> DataFrame:
    """Attributes of both endpoints as ``a_*`` and ``b_*``."""
    out = edges
    for i, p in enumerate(("a", "b")):
        dim = people.select(F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in columns])
        out = out.join(dim, F.col("people")[i] == F.col(f"{p}_id"), "left")
    return out


def credited_portraits(credits: DataFrame, files: DataFrame) -> DataFrame:
    """Portrait credits whose file is really there. ``files`` lists relative paths as ``file``."""
    return credits.join(files.select("file"), "file", "left_semi")


def page_citation(pages: DataFrame, cited_pages: DataFrame, source_key: str) -> DataFrame:
    """Each scanned page with the first source that cites it, or with none."""
    first = first_row(cited_pages, ["archive", "item", "page"], [F.col(source_key)], [source_key])
    return pages.join(first, ["archive", "item", "page"], "left")


# ------------------------------------------------------------------ addresses
def longest_prefix(df: DataFrame, column: str, addresses: DataFrame) -> DataFrame:
    """The longest known address a text starts with, as ``address``; NULL when none does.

    Each different text is cut at the lengths that addresses have (a short list)
    and the cuts meet whole addresses in an equi-join, so a key holds one
    address and a text that a third of the rows share is looked up once.
    """
    known = addresses.select(F.col("address").alias("__k")).where("__k <> ''").distinct()
    lengths = [r[0] for r in known.select(F.length("__k")).distinct().collect()]  # no more than the longest address has characters
    at = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length(column))
    probes = df.select(column).distinct().select(column, F.explode(at).alias("__n")).withColumn("__k", F.substring(F.col(column), F.lit(1), F.col("__n")))
    best = probes.join(small_side(known), "__k").groupBy(column).agg(F.max("__n").alias("__n"))
    return keyed_join(df, best, [column], "left").withColumn("address", F.substring(F.col(column), F.lit(1), F.col("__n"))).drop("__n")


ALL_ACTS = [*vocab.ACTS, "occurred"]
