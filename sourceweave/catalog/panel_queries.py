"""Panels, merging, ordering, facets and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceweave.catalog import corpus
from sourceweave.catalog.corpus import PRELUDE
from sourceweave.catalog.registry import query
from sourceweave.catalog.shared import PANEL, panel, search_index, told_by_card
from sourceweave.functions import dates, text
from sourceweave.operators import aggregates, dedup, filters, joins, ordering, sets
from sourceweave.operators import projections as prj
from sourceweave.physical import small_side, spread, with_group_count
from sourceweave.plans import panels

_TIMEKEY = "{y} + (coalesce({m}, 6.5) - 1) / 12.0 + coalesce({d}, 15) / 372.0"


# ------------------------------------------------------------------ documents: key, merge, chronology
@query("document_panel", r"""
WITH k AS (SELECT doc_id, source, lang, lower(trim(regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g'))) AS key FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY key) - 1 AS also FROM k)
SELECT CAST(doc_id AS BIGINT) AS doc_id, source, lang, CAST(also AS BIGINT) AS also FROM r WHERE rn = 1 AND key <> ''
UNION ALL SELECT doc_id, source, lang, 0 FROM k WHERE key = ''""")
def document_panel(spark, sf):
    """Documents merged by their words: the first is kept, later copies are counted."""
    df = spread(corpus.table(spark, sf, "documents")).select(
        F.lit("all").alias("person"), F.lit("").alias("work"), F.lit("").alias("locator"), F.col("text").alias("quote"),
        "doc_id", "source", "lang", F.struct("doc_id").alias("card_order"))
    # a text may be long: compare its words by a 256-bit digest, not by shuffling them
    df = df.withColumn("quote", F.when(text.excerpt_key(F.col("quote")) != "", F.sha2(text.excerpt_key(F.col("quote")), 256)).otherwise(""))
    return dedup.merge_cards(df, ["doc_id", "source", "lang"]).select("doc_id", "source", "lang", "also").orderBy("doc_id")


@query("excerpt_copies", r"""
WITH k AS (SELECT doc_id, lower(trim(regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g'))) AS key FROM documents)
SELECT doc_id, copies FROM (SELECT doc_id, key, CAST(count(*) OVER (PARTITION BY key) AS BIGINT) AS copies FROM k WHERE key <> '') WHERE copies > 1""")
def excerpt_copies(spark, sf):
    """Every document whose words occur more than once."""
    k = corpus.table(spark, sf, "documents").select("doc_id", text.excerpt_key(F.col("text")).alias("key")).where("key <> ''")
    return with_group_count(k.select("doc_id", F.sha2("key", 256).alias("key")), ["key"], "copies").select("doc_id", "copies")


# ------------------------------------------------------------------ person panel
@query("person_panel_rows", PANEL + "SELECT person, route, CAST(count(*) AS BIGINT) AS n, CAST(count(label_id) AS BIGINT) AS linked, CAST(sum(source_id) AS BIGINT) AS ids FROM panel GROUP BY ALL")
def person_panel_rows(spark, sf):
    return panel(spark, sf).groupBy("person", "route").agg(
        F.count(F.lit(1)).alias("n"), F.count("label_id").alias("linked"), F.sum("source_id").alias("ids"))


@query("person_panel_cards", PANEL + """
SELECT person, route, source_id, CAST(also AS BIGINT) AS also, label, date_y IS NULL AND hint_y IS NULL AS undated,
  CAST(coalesce(date_y, hint_y, 0) AS BIGINT) AS order_y, CAST(coalesce(date_m, 0) AS BIGINT) AS order_m, CAST(coalesce(date_d, 0) AS BIGINT) AS order_d FROM cards""")
def person_panel_cards(spark, sf):
    """Merged cards of every person in reading order."""
    dated = ordering.with_source_order(panel(spark, sf))
    # the parts of the date travel as one number, through the merge and the sort
    rows = dated.withColumn("day", F.col("order_y") * 10000 + F.col("order_m") * 100 + F.col("order_d"))
    cards = dedup.merge_cards(rows, ["route", "source_id", "label", "undated", "day"], told=told_by_card()).orderBy("person", "undated", "day", "source_id")
    day = F.col("day")
    return cards.select("person", "route", "source_id", "also", "label", "undated", F.floor(day / 10000).alias("order_y"),
                        F.floor(day / 100 % 100).alias("order_m"), (day % 100).alias("order_d"))


@query("busiest_person_panel", PANEL + """,
busiest AS (SELECT person FROM panel GROUP BY person ORDER BY count(*) DESC, person LIMIT 1)
SELECT person, route, source_id, label, work, locator FROM panel JOIN busiest USING (person)""")
def busiest_person_panel(spark, sf):
    """The whole panel of the person with most sources."""
    rows = panel(spark, sf)
    who = rows.groupBy("person").count().orderBy(F.desc("count"), "person").select("person").first()
    return rows.where(F.col("person") == who[0] if who else F.lit(False)).select("person", "route", "source_id", "label", "work", "locator")


@query("panel_duplicates", PANEL + """
SELECT person, work, locator, excerpt, CAST(count(*) AS BIGINT) AS copies, CAST(count(*) FILTER (route = 0) AS BIGINT) AS by_edge,
  CAST(count(*) FILTER (route = 1) AS BIGINT) AS by_own, CAST(count(*) FILTER (route = 2) AS BIGINT) AS by_named
FROM kpanel WHERE excerpt <> '' GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""")
def panel_duplicates(spark, sf):
    return dedup.repeated_on_panels(panel(spark, sf))


@query("card_header_names", PANEL + """,
ident AS (SELECT *, CASE WHEN route = 0 THEN 'r:' || owner_id ELSE 'l:' || coalesce(label_id, label) END AS identity,
  CASE WHEN excerpt = '' THEN CAST(route AS VARCHAR) || '/' || owner_pos || '/' || epos || '/' || source_id END AS own FROM kpanel),
g AS (SELECT person, work, locator, excerpt, own, identity FROM ident WHERE identity IS NOT NULL GROUP BY ALL)
SELECT person, CAST(count(*) AS BIGINT) AS names, CAST(count(DISTINCT identity) AS BIGINT) AS identities FROM g GROUP BY person""")
def card_header_names(spark, sf):
    """Counterparties named on each person's cards, each once per card."""
    rows = panel(spark, sf)
    # an edge of a known person is known by its other end
    other = corpus.person_number(F.col("label_id"))
    words = F.when(F.col("label_id").isNull(), F.col("label"))
    who = F.when((F.col("route") == 0) | other.isNotNull() | words.isNotNull(), F.struct((F.col("route") == 0).alias("edge"), other.alias("number"), words.alias("words")))
    named = rows.select(F.col("card")["person"].alias("person"), who.alias("identity"), F.col("card")["line"].alias("card"), "card_order")
    return dedup.names_on_cards(named).withColumn("person", corpus.person_id(F.col("person")))


@query("pair_panel", PANEL + """,
pp AS (
  SELECT cid || '--' || sid AS pair, 0 AS route, owner_pos, 0 AS epos, source_id, work, locator, quote FROM src2
  UNION ALL SELECT CASE WHEN owner_id < subject_id THEN owner_id || '--' || subject_id ELSE subject_id || '--' || owner_id END,
    CASE WHEN owner_id < subject_id THEN 1 ELSE 2 END, owner_pos, source_id, source_id, work, locator, quote FROM eng2 WHERE subject_id <> owner_id),
pk AS (SELECT *, lower(trim(regexp_replace(quote, '[^\\p{L}\\p{N}_]+', ' ', 'g'))) AS excerpt FROM pp),
pr2 AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY pair, work, locator, excerpt) - 1 AS also FROM pk
  WINDOW w AS (PARTITION BY pair, work, locator, excerpt ORDER BY route, owner_pos, epos, source_id))
SELECT pair, route, source_id, CAST(CASE WHEN excerpt = '' THEN 0 ELSE also END AS BIGINT) AS also,
  coalesce(r.certainty, 'no connection recorded') AS connection
FROM pr2 LEFT JOIN rels r ON r.id = pair WHERE rn = 1 OR excerpt = ''""".replace("\\\\p", "\\p"))
def pair_panel(spark, sf):
    """Every pair's shared sources, merged, with the class of their edge when there is one."""
    rels = corpus.relationships(spark, sf)
    rows = joins.pair_panels_of(panel(spark, sf).withColumn("o_orderkey", F.col("card_order")["o_orderkey"]))
    ends = [F.split_part("person", F.lit("--"), F.lit(i)) for i in (1, 2)]
    card = F.struct(*[corpus.person_number(e).alias(n) for e, n in zip(ends, "ab")], F.col("card")["line"].alias("line"))
    pair = F.concat_ws("--", *[corpus.person_id(F.col("card")[n]) for n in "ab"])
    order = F.struct("route", "owner_pos", "o_orderkey")
    cards = dedup.merge_cards(rows.withColumns({"card": card, "card_order": order}), ["route", "source_id"], told=told_by_card() | {"person": pair})
    return cards.join(rels.select(F.col("id").alias("person"), "certainty"), "person", "left").select(
        F.col("person").alias("pair"), "route", "source_id", "also",
        F.coalesce("certainty", F.lit("no connection recorded")).alias("connection"))


@query("person_timeline", PRELUDE + f""",
rows AS (
  SELECT id AS person, FALSE AS is_death, {_TIMEKEY.format(y='born_y', m='born_m', d='NULL')} AS k, 0 AS kind, 0 AS pos FROM people WHERE born_y IS NOT NULL
  UNION ALL SELECT a, FALSE, {_TIMEKEY.format(y='start_y', m='start_m', d='start_d')}, 1, pos FROM rels
  UNION ALL SELECT b, FALSE, {_TIMEKEY.format(y='start_y', m='start_m', d='start_d')}, 1, pos FROM rels
  UNION ALL SELECT owner_id, FALSE, date_y + 5.5 / 12 + 15 / 372.0, 2, source_id FROM eng
  UNION ALL SELECT id, TRUE, {_TIMEKEY.format(y='died_y', m='NULL', d='NULL')}, 3, 0 FROM people WHERE died_y IS NOT NULL)
SELECT person, is_death, CAST(round(k, 6) AS DOUBLE) AS timeline_key, kind, CAST(pos AS BIGINT) AS pos FROM rows""")
def person_timeline(spark, sf):
    """Dated life of every person: births, edges, engagements, undated rows, deaths."""
    eng = corpus.engagement_sources(spark, sf).select(
        "owner_id", "engagement_pos", "subject",
        F.struct(corpus.year_only(prj.effective_date()["y"]).alias("date")).alias("start"),
        F.struct(F.lit(None).cast(prj.schemas.PARTIAL_DATE).alias("date")).alias("end"))
    t = panels.person_timeline(corpus.people(spark, sf), corpus.relationships(spark, sf), eng)
    return t.select("person", "is_death", F.round("timeline_key", 6).alias("timeline_key"), "kind", "pos").orderBy(
        "person", "is_death", F.col("timeline_key").asc_nulls_last(), "kind", "pos")


@query("relationship_list", PRELUDE + f"""
SELECT r.id, pa.name AS a_name, pb.name AS b_name, r.certainty, CAST(round({_TIMEKEY.format(y='start_y', m='start_m', d='start_d')}, 6) AS DOUBLE) AS timeline_key,
  CAST(count(*) FILTER (s.verified) AS BIGINT) AS ok, CAST(count(*) FILTER (NOT s.verified) AS BIGINT) AS pending
FROM rels r JOIN people pa ON r.a = pa.id JOIN people pb ON r.b = pb.id LEFT JOIN src s ON s.owner_id = r.id
GROUP BY r.id, pa.name, pb.name, r.certainty, start_y, start_m, start_d""")
def relationship_list(spark, sf):
    out = panels.relationship_list(corpus.relationships(spark, sf), corpus.sources(spark, sf), corpus.people(spark, sf))
    return out.select("id", "a_name", "b_name", "certainty", F.round("timeline_key", 6).alias("timeline_key"), "ok", "pending").orderBy(
        F.col("timeline_key").asc_nulls_last(), "id")


@query("relationship_detail", PRELUDE + """
SELECT r.id AS owner_id, pa.name AS a_name, pb.name AS b_name, s.source_id, s.date_y IS NULL AND s.hint_y IS NULL AS undated,
  CAST(coalesce(s.date_y, s.hint_y, 0) AS BIGINT) AS order_y FROM rels r JOIN people pa ON r.a = pa.id JOIN people pb ON r.b = pb.id
LEFT JOIN src s ON s.owner_id = r.id""")
def relationship_detail(spark, sf):
    d = panels.relationship_detail(corpus.relationships(spark, sf), corpus.sources(spark, sf), corpus.people(spark, sf))
    return d.select("owner_id", "a_name", "b_name", "source_id", "undated", "order_y").orderBy("owner_id", "undated", "order_y", "source_id")


_LABEL = """CASE WHEN {y} IS NULL THEN 'date unknown' ELSE CASE WHEN {circa} THEN 'c. ' ELSE '' END ||
  CASE WHEN {d} IS NOT NULL AND {m} IS NOT NULL THEN {d} || ' ' || monthname(make_date(2000, CAST({m} AS INT), 1)) || ' ' || {y}
       WHEN {m} IS NOT NULL THEN monthname(make_date(2000, CAST({m} AS INT), 1)) || ' ' || {y} ELSE CAST({y} AS VARCHAR) END END"""


@query("relationship_labels", PRELUDE + f""",
l AS (SELECT id, date_label, {_LABEL.format(y='start_y', m='start_m', d='start_d', circa='start_circa')} AS a,
  {_LABEL.format(y='end_y', m='NULL', d='NULL', circa='FALSE')} AS b, end_y FROM rels)
SELECT id, CASE WHEN date_label IS NOT NULL THEN date_label WHEN end_y IS NULL OR a = b THEN a ELSE a || ' – ' || b END AS label FROM l""")
def relationship_labels(spark, sf):
    return corpus.relationships(spark, sf).select(
        "id", dates.relationship_label(F.col("date_label"), F.col("start")["date"], F.col("end")["date"]).alias("label"))


@query("source_when_labels", PRELUDE + f"""
SELECT source_id, CASE WHEN date_y IS NOT NULL THEN {_LABEL.format(y='date_y', m='date_m', d='date_d', circa='FALSE')}
  WHEN hint_y IS NOT NULL THEN 'undated' ELSE '' END AS label FROM src""")
def source_when_labels(spark, sf):
    return corpus.sources(spark, sf).select("source_id", dates.when_label(prj.effective_date(), F.col("order_hint")).alias("label"))


@query("lifespans", PRELUDE + "SELECT id, coalesce(CAST(born_y AS VARCHAR), '?') || '–' || coalesce(CAST(died_y AS VARCHAR), '?') AS life FROM people")
def lifespans(spark, sf):
    return corpus.people(spark, sf).select("id", dates.lifespan(F.col("born")["date"], F.col("died")["date"]).alias("life"))


@query("letter_dating_labels", PRELUDE + """
SELECT source_id, concat_ws(' · ',
  CASE WHEN st = 'F' AND pr <> '3-MEDIUM' THEN 'written ' || coalesce(CASE WHEN date_m IS NULL THEN CAST(date_y AS VARCHAR)
    ELSE CASE WHEN date_d IS NULL THEN '' ELSE date_d || ' ' END || monthname(make_date(2000, CAST(date_m AS INT), 1)) || ' ' || date_y END, '') END,
  CASE WHEN st = 'F' AND pr = '2-HIGH' THEN 'sent Monday ' || day(ship) || ' ' || monthname(ship) || ' ' || (year(ship) - 100) END) AS dating FROM src""")
def letter_dating_labels(spark, sf):
    acts = {a: F.col(a) for a in ("written", "sent")}
    return corpus.sources(spark, sf).select("source_id", dates.letter_dating(acts).alias("dating"))


@query("weekday_clashes", PRELUDE + """
SELECT source_id, lower(dayname(CAST((year(ship) - 100) || '-' || month(ship) || '-' || day(ship) AS DATE))) AS real_day FROM src
WHERE st = 'F' AND pr = '2-HIGH' AND NOT (month(ship) = 2 AND day(ship) = 29 AND (year(ship) - 100) % 4 <> 0 OR (year(ship) = 2000 AND month(ship) = 2 AND day(ship) = 29))
  AND dayname(CAST((year(ship) - 100) || '-' || month(ship) || '-' || day(ship) AS DATE)) <> 'Monday'""")
def weekday_clashes(spark, sf):
    """Complete dates whose stated weekday the calendar contradicts; impossible dates are no clash."""
    d = F.col("sent")["date"]
    real = dates.calendar_weekday(d)
    return corpus.sources(spark, sf).select("source_id", d["weekday"].alias("said"), real.alias("real_day")).where(
        F.col("real_day") != F.col("said")).select("source_id", "real_day")


# ------------------------------------------------------------------ facets and filters
_ROWS = PANEL + """,
loc AS (
  SELECT c.*, w.author AS w_author, w.editors AS w_editors, w.title AS w_title, w.year AS w_year, p.venue, p.street, p.city, p.region, p.country, coalesce(date_y, hint_y) AS yr,
    CASE WHEN repository IS NOT NULL THEN CASE repository WHEN 'Bodleian Library, Oxford' THEN 'Bodleian' ELSE 'Old House' END
      WHEN document IN ('letter', 'telegram', 'diary', 'typescript') THEN 'Unknown'
      WHEN w.kind LIKE '%-web' THEN 'Online' WHEN w.publisher IS NOT NULL OR w.ia_id IS NOT NULL THEN 'Published' ELSE 'Unknown' END AS location
  FROM cards c LEFT JOIN works w USING (work) LEFT JOIN places p ON c.place = p.place_id),
hay AS (SELECT *, lower(concat_ws('  ', nullif(speaker, ''), nullif(addressee, ''), w_author, w_editors, label)) AS hay_names,
  lower(concat_ws('  ', nullif(quote, ''))) AS hay_quotes,
  lower(concat_ws('  ', nullif(quote, ''), context, speaker, addressee, supports, locator, citation_provenance, verified_with, w_title, w_author, w_editors,
    CAST(w_year AS VARCHAR), CASE WHEN route = 0 THEN label END, CASE WHEN hint_y IS NOT NULL THEN 'by hand' END)) AS hay_all FROM loc)
"""
_FACETS = ["document", "location", "country", "region", "city", "street", "venue"]


def _source_rows(spark, sf):
    """What the filters look at, per row of the panel; whoever asks for a column or two reads no more than these."""
    m = F.when(F.col("repository").isNotNull(), F.struct(
        F.col("repository"), *[F.lit(None).cast("string").alias(x) for x in ("archived_as", "as_of", "recorded_by", "owner")]))
    return panels.source_rows(dedup.with_card(panel(spark, sf)).withColumn("manuscript", m), None, corpus.places(spark, sf))


def _rows(spark, sf, *columns):
    """The cards with ``columns`` of what the filters look at: no others travel to the merge."""
    return dedup.merge_cards(_source_rows(spark, sf), list(columns), told=told_by_card())


def _faceted(spark, sf):
    """The cards with all facets: a place travels as its id and is looked up once the cards are merged."""
    # a facet that is missing and one that is blank are one member, so three short texts travel as one
    parts = ["document", "location", "place_id"]
    rows = _source_rows(spark, sf).withColumn("parts", F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in parts]))
    cards = dedup.merge_cards(rows, ["parts"], told=told_by_card()).withColumns({c: F.split_part("parts", F.lit("\n"), F.lit(i + 1)) for i, c in enumerate(parts)})
    found = small_side(corpus.places(spark, sf).select("place_id", *[f for f in panels.FACETS if f not in ("document", "location")]))
    return cards.join(found, "place_id", "left")


@query("facet_counts", _ROWS + "SELECT facet, member, CAST(count(*) AS BIGINT) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS facet, coalesce({f}, '') AS member FROM hay" for f in _FACETS) + ") GROUP BY ALL")
def facet_counts(spark, sf):
    """All seven facets over all cards, in option order."""
    counts = aggregates.facet_counts(_faceted(spark, sf), panels.FACETS)
    return ordering.facet_options(counts).select("facet", "member", "n")


@query("facet_totals", _ROWS + "SELECT facet, CAST(count(*) AS BIGINT) AS total, bool_or(member <> '') AS live FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS facet, coalesce({f}, '') AS member FROM hay" for f in _FACETS) + ") GROUP BY ALL")
def facet_totals(spark, sf):
    return aggregates.facet_summary(aggregates.facet_counts(_faceted(spark, sf), panels.FACETS))


@query("panel_year_range", _ROWS + "SELECT person, CAST(min(yr) AS BIGINT) AS first_year, CAST(max(yr) AS BIGINT) AS last_year FROM hay GROUP BY person")
def panel_year_range(spark, sf):
    return aggregates.year_range(_rows(spark, sf, "year"), ["person"])


@query("source_filter", _ROWS + """
SELECT person, CAST(count(*) FILTER (t AND f AND yr BETWEEN 1896 AND 1899) AS BIGINT) AS shown, CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (t AND f AND yr IS NULL) AS BIGINT) AS undated_hidden
FROM (SELECT *, contains(hay_all, 'ring') AS t, coalesce(document, '') NOT IN ('letter', '') AND coalesce(city, '') NOT IN ('NATION_3') AS f FROM hay)
GROUP BY person""")
def source_filter(spark, sf):
    """Term, facet exclusions (the blank is a member) and years typed backwards, per panel."""
    cards = panels.found_cards(_source_rows(spark, sf), " Ring ", "all", ["document", "city", "year"], told_by_card())
    rows = filters.filter_sources(cards, off={"document": ["letter", ""], "city": ["NATION_3"]}, years=(1899, 1896))
    return aggregates.filter_counts(rows, ["person"])


@query("source_filter_names", _ROWS + """
SELECT person, CAST(count(*) FILTER (contains(hay_names, '#00000000') OR coalesce(hit, FALSE)) AS BIGINT) AS shown, CAST(count(*) AS BIGINT) AS total, CAST(0 AS BIGINT) AS undated_hidden
FROM hay LEFT JOIN (SELECT person, work, locator, excerpt, bool_or(contains(lower(label), '#00000000')) AS hit FROM kpanel WHERE excerpt <> '' GROUP BY ALL) USING (person, work, locator, excerpt)
GROUP BY person""")
def source_filter_names(spark, sf):
    """A search among names, per panel: also by names that only folded rows of a card carry."""
    rows = panels.found_cards(_source_rows(spark, sf), "#00000000", "names", ["year"], told_by_card())
    return aggregates.filter_counts(filters.filter_sources(rows), ["person"])


@query("source_filter_quotes", _ROWS + """
SELECT CAST(count(*) FILTER (contains(hay_quotes, 'economy!')) AS BIGINT) AS shown, CAST(count(*) AS BIGINT) AS total, CAST(0 AS BIGINT) AS undated_hidden FROM hay""")
def source_filter_quotes(spark, sf):
    return aggregates.filter_counts(filters.filter_sources(panels.found_cards(_source_rows(spark, sf), "economy!", "quotes", ["year"], told_by_card())))


# ------------------------------------------------------------------ locations and places
@query("source_locations", PRELUDE + """
SELECT source_id, CASE WHEN repository IS NOT NULL THEN CASE repository WHEN 'Bodleian Library, Oxford' THEN 'Bodleian' ELSE 'Old House' END
  WHEN document IN ('letter', 'telegram', 'diary', 'typescript') THEN 'Unknown' WHEN w.kind LIKE '%-web' THEN 'Online'
  WHEN w.publisher IS NOT NULL OR w.ia_id IS NOT NULL THEN 'Published' ELSE 'Unknown' END AS short,
  CASE WHEN repository IS NOT NULL THEN repository WHEN document IN ('letter', 'telegram', 'diary', 'typescript') THEN 'Location unknown'
  WHEN w.kind LIKE '%-web' THEN 'Published on the web' WHEN w.publisher IS NOT NULL OR w.ia_id IS NOT NULL THEN 'Published work' ELSE 'Location unknown' END AS full_name
FROM src LEFT JOIN works w USING (work)""")
def source_locations(spark, sf):
    m = F.when(F.col("repository").isNotNull(), F.struct(
        F.col("repository"), *[F.lit(None).cast("string").alias(x) for x in ("archived_as", "as_of", "recorded_by", "owner")]))
    df = prj.with_location(corpus.sources(spark, sf).withColumn("manuscript", m), corpus.works(spark, sf))
    return df.select("source_id", F.col("location")["short"].alias("short"), F.col("location")["full"].alias("full_name"))


@query("last_recorded_by", PRELUDE + """
SELECT source_id, CASE WHEN w.editors IS NOT NULL THEN split_part(w.editors, ' (', 1) || ', in ' || w.short_cite ELSE w.short_cite END AS recorded_by
FROM src LEFT JOIN works w USING (work)""")
def last_recorded_by(spark, sf):
    m = F.when(F.col("repository").isNotNull(), F.struct(
        F.col("repository"), *[F.lit(None).cast("string").alias(x) for x in ("archived_as", "as_of", "recorded_by", "owner")]))
    works = corpus.works(spark, sf)
    located = prj.with_location(corpus.sources(spark, sf).withColumn("manuscript", m), works)
    return prj.last_recorded(works, located).select("source_id", "recorded_by")


@query("work_availability", PRELUDE + """
SELECT work, CASE WHEN kind LIKE '%-web' THEN 'online' WHEN publisher IS NOT NULL OR ia_id IS NOT NULL THEN 'published' ELSE 'unknown' END AS available FROM works""")
def work_availability(spark, sf):
    return corpus.works(spark, sf).select("work", prj.work_availability().alias("available"))


@query("effective_places", PRELUDE + """
SELECT source_id, p.place_id, concat_ws(', ', venue, street, city, region) AS label FROM src LEFT JOIN places p ON src.place = p.place_id""")
def effective_places(spark, sf):
    df = prj.with_effective_place(corpus.sources(spark, sf), corpus.places(spark, sf))
    return df.select("source_id", F.col("place")["place_id"].alias("place_id"),
                     F.coalesce(dates.place_label(F.col("place")), F.lit("")).alias("label"))


@query("source_dates", PRELUDE + """
SELECT source_id, act, CAST(y AS BIGINT) AS y FROM (
  SELECT source_id, CASE WHEN st = 'O' THEN 'occurred' ELSE 'written' END AS act, date_y AS y FROM src WHERE date_y IS NOT NULL
  UNION ALL SELECT source_id, 'sent', year(ship) - 100 FROM src WHERE st = 'F' AND pr = '2-HIGH')""")
def source_dates(spark, sf):
    d = prj.source_dates(corpus.sources(spark, sf), ["source_id"])
    return d.select("source_id", "act", F.col("date")["y"].alias("y"))


@query("source_years", PRELUDE + "SELECT source_id, CAST(coalesce(date_y, hint_y) AS BIGINT) AS year FROM src")
def source_years(spark, sf):
    return corpus.sources(spark, sf).select("source_id", prj.source_year().alias("year"))


@query("source_chronology", PRELUDE + """
SELECT source_id, CASE WHEN coalesce(date_y, hint_y) IS NULL THEN 1 ELSE 0 END = 1 AS undated, CAST(coalesce(date_y, hint_y, 0) AS BIGINT) AS order_y,
  CAST(coalesce(date_m, 0) AS BIGINT) AS order_m, CAST(coalesce(date_d, 0) AS BIGINT) AS order_d FROM src""")
def source_chronology(spark, sf):
    return ordering.chronological(corpus.sources(spark, sf), "source_id").select("source_id", *ordering.SOURCE_ORDER)


# ------------------------------------------------------------------ search
_SEARCH = PRELUDE + """,
h AS (
  SELECT id, contains(lower(name || ' ' || aka || ' ' || sort_name), '{t}') AS n, contains(lower(bio), '{t}') AS q, contains(lower(coalesce(bio_note, '')), '{t}') AS o FROM people
  UNION ALL SELECT unnest([cid, sid]), FALSE, contains(lower(concat_ws('  ', nullif(quote, ''), context, supports)), '{t}'),
    contains(lower(concat_ws('  ', citation_provenance, locator, CASE WHEN hint_y IS NOT NULL THEN 'by hand' END)), '{t}') FROM src
  UNION ALL SELECT unnest([a, b]), FALSE, FALSE, contains(lower(coalesce(date_label, '')), '{t}') FROM rels
  UNION ALL SELECT owner_id, FALSE, FALSE, contains(lower(subject), '{t}') FROM eng),
hit AS (SELECT id, CASE WHEN {n} AND bool_or(n) THEN 'name' WHEN {q} AND bool_or(q) THEN 'quote' WHEN {o} AND bool_or(o) THEN 'note' END AS kind FROM h GROUP BY id)
"""


def _hits(spark, sf, term, scope):
    eng = corpus.engagement_sources(spark, sf).select("owner_id", "subject")
    return panels.search_hits(corpus.people(spark, sf), corpus.relationships(spark, sf), corpus.sources(spark, sf), eng, term, scope)


@query("search_all", _SEARCH.format(t="nobody", n="TRUE", q="TRUE", o="TRUE") + "SELECT id, kind FROM hit")
def search_all(spark, sf):
    return _hits(spark, sf, "Nobody", "all")


@query("search_quotes", _SEARCH.format(t="red", n="FALSE", q="TRUE", o="FALSE") + "SELECT id, kind FROM hit WHERE kind IS NOT NULL")
def search_quotes(spark, sf):
    return _hits(spark, sf, "red", "quotes").where("kind IS NOT NULL")


@query("search_counts", _SEARCH.format(t="nation_1", n="TRUE", q="TRUE", o="TRUE") + "SELECT kind, CAST(count(*) AS BIGINT) AS n FROM hit WHERE kind IS NOT NULL GROUP BY kind")
def search_counts(spark, sf):
    return aggregates.hit_counts(_hits(spark, sf, "nation_1", "all"))


@query("search_single_pick", _SEARCH.format(t="customer#000000007", n="TRUE", q="FALSE", o="FALSE") +
       "SELECT CASE WHEN count(*) FILTER (kind = 'name') = 1 THEN min(id) FILTER (kind = 'name') END AS pick FROM hit")
def search_single_pick(spark, sf):
    return aggregates.single_match(_hits(spark, sf, "Customer#000000007", "names"))


#: a whole name, a word, a note, a term without a trigram, one that nothing holds
_TERMS = ["Customer#000000007", "red", "nation_1", "ed", "zqzqzq"]
_BY_TERM = " UNION ALL ".join(
    f"SELECT '{t}' AS term, id, CASE WHEN bool_or(n) THEN 'name' WHEN bool_or(q) THEN 'quote' WHEN bool_or(o) THEN 'note' END AS kind FROM h{i} GROUP BY id HAVING bool_or(n OR q OR o)"
    for i, t in enumerate(_TERMS))
_TEXTS = """,
txt AS (
  SELECT id, 'n' AS k, lower(name || ' ' || aka || ' ' || sort_name) AS hay FROM people UNION ALL SELECT id, 'q', lower(bio) FROM people
  UNION ALL SELECT id, 'o', lower(coalesce(bio_note, '')) FROM people
  UNION ALL SELECT unnest([cid, sid]), 'q', lower(concat_ws('  ', nullif(quote, ''), context, supports)) FROM src
  UNION ALL SELECT unnest([cid, sid]), 'o', lower(concat_ws('  ', citation_provenance, locator, CASE WHEN hint_y IS NOT NULL THEN 'by hand' END)) FROM src
  UNION ALL SELECT unnest([a, b]), 'o', lower(coalesce(date_label, '')) FROM rels UNION ALL SELECT owner_id, 'o', lower(subject) FROM eng)"""


@query("search_indexed", PRELUDE + _TEXTS + "".join(
    f", h{i} AS (SELECT id, k = 'n' AND c AS n, k = 'q' AND c AS q, k = 'o' AND c AS o FROM (SELECT id, k, contains(hay, '{t.lower()}') AS c FROM txt))"
    for i, t in enumerate(_TERMS)) + " " + _BY_TERM)
def search_indexed(spark, sf):
    """Several terms answered from the stored trigram index."""
    index, people, out = search_index(spark, sf), corpus.people(spark, sf), None
    for t in _TERMS:
        found = index.hits(people, t).where("kind IS NOT NULL").select(F.lit(t).alias("term"), "id", "kind")
        out = found if out is None else out.unionByName(found)
    return out


# ------------------------------------------------------------------ unions
@query("holder_union", PRELUDE + "SELECT owner_kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(source_id) AS BIGINT) AS ids FROM (SELECT owner_kind, source_id FROM src UNION ALL SELECT owner_kind, source_id FROM eng) GROUP BY 1")
def holder_union(spark, sf):
    both = sets.holders(corpus.sources(spark, sf), corpus.engagement_sources(spark, sf))
    return both.groupBy("owner_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("source_id").alias("ids"))
