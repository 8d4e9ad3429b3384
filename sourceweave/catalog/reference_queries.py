"""Reference checks, names, counts, coverage, precedence and the publication gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceweave import vocab
from sourceweave.catalog import corpus
from sourceweave.catalog.corpus import PRELUDE, table
from sourceweave.catalog.registry import query
from sourceweave.catalog.shared import PANEL
from sourceweave.functions import text
from sourceweave.operators import aggregates, citations, coverage, dedup, filters, joins, ordering, sets
from sourceweave.operators import projections as prj
from sourceweave.physical import spread
from sourceweave.plans import publish


# ------------------------------------------------------------------ reference checks
@query("unknown_people", PRELUDE + "SELECT id, person FROM (SELECT id, unnest([a, b]) AS person FROM rels) WHERE person NOT IN (SELECT id FROM people WHERE born_y IS NOT NULL)")
def unknown_people(spark, sf):
    """Ends of edges missing from a people table (here: the people with a birth)."""
    return joins.unknown_people(corpus.relationships(spark, sf), corpus.people(spark, sf).where("born IS NOT NULL"))


@query("people_without_relationship", PRELUDE + "SELECT id FROM people WHERE id NOT IN (SELECT unnest([a, b]) FROM rels WHERE certainty <> 'platonic')")
def people_without_relationship(spark, sf):
    """People with no relationship but platonic ones."""
    return joins.people_without_relationship(filters.map_edges(corpus.relationships(spark, sf)), corpus.people(spark, sf))


@query("unknown_works", PRELUDE + "SELECT work, source_id FROM src WHERE work NOT IN (SELECT work FROM works)")
def unknown_works(spark, sf):
    return joins.unknown_works(corpus.sources(spark, sf), corpus.works(spark, sf)).select("work", "source_id")


def _place_refs(spark, sf):
    src = joins.place_references(corpus.sources(spark, sf), ["source_id"], joins.ALL_ACTS)
    ppl = joins.place_references(corpus.people(spark, sf), ["id"], ["born", "died"])
    return src, ppl


@query("unknown_places", PRELUDE + "SELECT source_id, CASE WHEN st = 'O' THEN 'occurred' ELSE 'written' END AS path, place FROM src WHERE place NOT IN (SELECT place_id FROM places)")
def unknown_places(spark, sf):
    src, _ = _place_refs(spark, sf)
    return joins.unknown_places(src, corpus.places(spark, sf)).select("source_id", "path", "place")


@query("unused_places", PRELUDE + "SELECT place_id FROM places WHERE place_id NOT IN (SELECT born_place FROM people WHERE born_place IS NOT NULL AND gender = 'm')")
def unused_places(spark, sf):
    """Gazetteer entries no man of the roster was born in."""
    refs = joins.place_references(corpus.people(spark, sf).where("gender = 'm'"), ["id"], ["born", "died"])
    return joins.unused_places(refs, corpus.places(spark, sf))


@query("complete_edges", PRELUDE + "SELECT id FROM rels WHERE a IN (SELECT id FROM people WHERE died_y IS NOT NULL) AND b IN (SELECT id FROM people WHERE died_y IS NOT NULL)")
def complete_edges(spark, sf):
    return filters.complete_edges(corpus.relationships(spark, sf), corpus.people(spark, sf).where("died IS NOT NULL")).select("id")


@query("map_edges", PRELUDE + "SELECT id, certainty FROM rels WHERE certainty <> 'platonic'")
def map_edges(spark, sf):
    return filters.map_edges(corpus.relationships(spark, sf)).select("id", "certainty")


@query("endpoint_attributes", PRELUDE + "SELECT r.id, p.name AS a_name, p.grp AS a_group, q.name AS b_name, q.grp AS b_group FROM rels r JOIN people p ON r.a = p.id JOIN people q ON r.b = q.id")
def endpoint_attributes(spark, sf):
    return joins.endpoint_attributes(corpus.relationships(spark, sf), corpus.people(spark, sf), ["name", "group"]).select(
        "id", "a_name", "a_group", "b_name", "b_group")


@query("counterparts", PRELUDE + "SELECT id, a AS person, b AS other FROM rels UNION ALL SELECT id, b, a FROM rels")
def counterparts(spark, sf):
    e = corpus.relationships(spark, sf).select("id", "people", F.explode("people").alias("person"))
    return e.select("id", "person", prj.counterpart(F.col("people"), F.col("person")).alias("other"))


# ------------------------------------------------------------------ visibility
_HID = "(grp IN ('liaisons') OR coalesce(gender IN ('f'), FALSE))"


@query("person_visibility", PRELUDE + f"SELECT id, {_HID} AS hidden FROM people")
def person_visibility(spark, sf):
    return corpus.people(spark, sf).select(
        "id", filters.person_hidden(F.col("group"), F.col("gender"), vocab.DEFAULT_OFF_GROUPS, ["f"]).alias("hidden"))


@query("edge_visibility", PRELUDE + f""", v AS (SELECT id, {_HID} AS hidden FROM people)
SELECT r.id, r.certainty IN ('platonic') AS hidden, p.hidden OR q.hidden AS dimmed FROM rels r JOIN v p ON r.a = p.id JOIN v q ON r.b = q.id""")
def edge_visibility(spark, sf):
    return filters.edge_visibility(corpus.relationships(spark, sf), person_visibility(spark, sf), ["platonic"]).select("id", "hidden", "dimmed")


@query("edge_visibility_in_search", PRELUDE + """, v AS (SELECT id, contains(lower(name), '0001') AS m FROM people)
SELECT r.id, NOT (p.m OR q.m) AS dimmed FROM rels r JOIN v p ON r.a = p.id JOIN v q ON r.b = q.id""")
def edge_visibility_in_search(spark, sf):
    v = person_visibility(spark, sf).join(corpus.people(spark, sf).select("id", F.contains(F.lower("name"), F.lit("0001")).alias("matches")), "id")
    return filters.edge_visibility(corpus.relationships(spark, sf), v, search=True).select("id", "dimmed")


@query("all_connections_excluded", PRELUDE + """
SELECT p.id, coalesce(e.off, FALSE) AS lead_only FROM people p LEFT JOIN (SELECT id, bool_and(certainty = 'platonic') AS off FROM (
  SELECT unnest([a, b]) AS id, certainty FROM rels) GROUP BY 1) e ON e.id = p.id""")
def all_connections_excluded(spark, sf):
    return filters.all_connections_excluded(corpus.relationships(spark, sf), corpus.people(spark, sf), ["platonic"])


# ------------------------------------------------------------------ names
@query("unique_name_index", PANEL + "SELECT key, id FROM idx")
def unique_name_index(spark, sf):
    return joins.unique_name_index(corpus.people(spark, sf))


@query("subject_resolution", PANEL + "SELECT source_id, owner_id, subject, subject_id FROM eng2")
def subject_resolution(spark, sf):
    e = corpus.engagement_sources(spark, sf).select("source_id", "owner_id", "subject")
    return joins.resolve_names(e, "subject", joins.unique_name_index(corpus.people(spark, sf)), "subject_id")


@query("display_labels", PRELUDE + """, l AS (SELECT id, name, name_is_descriptor AS d, split_part(sort_name, ',', 1) AS s FROM people)
SELECT id, CASE WHEN d THEN '“' ELSE '' END || s || CASE WHEN (SELECT count(*) FROM l o WHERE o.s = l.s) > 1 THEN ' ' || name[1] || '.' ELSE '' END || CASE WHEN d THEN '”' ELSE '' END AS label FROM l""")
def display_labels(spark, sf):
    return aggregates.display_labels(corpus.people(spark, sf))


@query("bare_surnames", """
WITH ppl AS (SELECT p_name AS name, p_type || ' ' || p_brand AS aka FROM part),
sp AS (SELECT name, unnest([name, aka]) AS s FROM ppl),
cand AS (SELECT DISTINCT lower(regexp_extract(s, '(\\S+)$', 1)) AS surname, name FROM sp),
letters AS (SELECT p_partkey AS letter_id, CASE WHEN p_size % 3 = 0 THEN split_part(p_name, ' ', 2) WHEN p_size % 3 = 1 THEN p_name ELSE p_brand END AS value FROM part)
SELECT letter_id, value, CAST(count(*) AS BIGINT) AS candidates FROM letters JOIN cand ON lower(value) = surname WHERE lower(value) NOT IN (SELECT lower(s) FROM sp) GROUP BY 1, 2""")
def bare_surnames(spark, sf):
    """Correspondents named by a surname, with the number of people who bear it."""
    p, size = table(spark, sf, "part"), F.col("p_size")
    people = p.select(F.col("p_name").alias("name"), F.array(F.concat("p_type", F.lit(" "), "p_brand")).alias("aka"))
    letters = p.select(F.col("p_partkey").alias("letter_id"), F.when(size % 3 == 0, F.split_part("p_name", F.lit(" "), F.lit(2)))
                       .when(size % 3 == 1, F.col("p_name")).otherwise(F.col("p_brand")).alias("sender"))
    return joins.bare_surnames(letters, people, "sender")


@query("known_address_prefix", """
WITH t AS (SELECT p_partkey, p_name || ' ' || p_type AS head FROM part),
a AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS address FROM part UNION SELECT DISTINCT p_name || ' ' || p_type[1:3] FROM part WHERE p_size > 40)
SELECT p_partkey, head, (SELECT arg_max(address, length(address)) FROM a WHERE starts_with(head, address)) AS address FROM t""")
def known_address_prefix(spark, sf):
    p = table(spark, sf, "part")
    heads = p.select("p_partkey", F.concat("p_name", F.lit(" "), "p_type").alias("head"))
    known = p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("address")).union(
        p.where("p_size > 40").select(F.concat("p_name", F.lit(" "), F.substring("p_type", 1, 3))))
    return joins.longest_prefix(heads, "head", known).select("p_partkey", "head", "address")


# ------------------------------------------------------------------ duplicates
@query("repeated_excerpts", PRELUDE + """, k AS (SELECT sid AS holder, source_id, work, locator, lower(trim(regexp_replace(quote, '[^\\p{L}\\p{N}_]+', ' ', 'g'))) AS e FROM src)
SELECT source_id, copies FROM (SELECT *, CAST(count(*) OVER (PARTITION BY holder, work, locator, e) AS BIGINT) AS copies FROM k WHERE e <> '') WHERE copies > 1""".replace("\\\\", "\\"))
def repeated_excerpts(spark, sf):
    """Excerpts quoted more than once among the sources of one supplier."""
    s = corpus.sources(spark, sf).withColumn("holder", F.col("people")[1])
    return dedup.repeated_excerpts(s, ["holder"]).select("source_id", "copies")


@query("excerpt_on_engagement_and_edge", PRELUDE + """,
ek AS (SELECT unnest([cid, sid]) AS person, owner_id, work, locator, lower(trim(regexp_replace(quote, '[^\\p{L}\\p{N}_]+', ' ', 'g'))) AS e FROM src),
ok AS (SELECT owner_id AS person, source_id, work, locator, lower(trim(regexp_replace(quote, '[^\\p{L}\\p{N}_]+', ' ', 'g'))) AS e FROM eng)
SELECT o.person, o.source_id, o.work, o.locator, min(k.owner_id) AS edge FROM ok o JOIN ek k ON o.person = k.person AND o.e = k.e AND o.work IS NOT DISTINCT FROM k.work
  AND o.locator IS NOT DISTINCT FROM k.locator WHERE o.e <> '' GROUP BY ALL""".replace("\\\\", "\\"))
def excerpt_on_engagement_and_edge(spark, sf):
    return joins.excerpt_on_engagement_and_edge(corpus.sources(spark, sf), corpus.engagement_sources(spark, sf))


@query("repeated_ids", "SELECT p_name AS id, CAST(count(*) AS BIGINT) AS copies FROM part GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark, sf):
    return dedup.repeated_ids(table(spark, sf, "part").select(F.col("p_name").alias("id")))


@query("repeated_readings", PRELUDE + """SELECT "at", letter_id, transcribed_from, first_at FROM (SELECT *, min("at") OVER (PARTITION BY letter_id, transcribed_from) AS first_at FROM (SELECT * FROM held UNION ALL SELECT letter_id, transcribed_from, 'z/' || "at", quote FROM held WHERE quote LIKE '%ring%')) WHERE "at" <> first_at""")
def repeated_readings(spark, sf):
    """Second transcriptions of one letter from one kind of source; the first path wins."""
    held = corpus.transcriptions(spark, sf)
    again = held.where(F.contains("quote", F.lit("ring"))).withColumn("at", F.concat(F.lit("z/"), "at"))
    _, later = dedup.one_reading_each(held.unionByName(again))
    return later.select("at", "letter_id", "transcribed_from", "first_at")


@query("preferred_readings", PRELUDE + """SELECT letter_id, transcribed_from, "at" FROM (SELECT *, row_number() OVER (PARTITION BY letter_id ORDER BY CASE transcribed_from WHEN 'facsimile' THEN 0 ELSE 1 END, "at") AS rn FROM held) WHERE rn = 1""")
def preferred_readings(spark, sf):
    return dedup.preferred_reading(corpus.transcriptions(spark, sf), ["letter_id", "transcribed_from", "at"])


# ------------------------------------------------------------------ counts
@query("dashboard", PRELUDE + """
SELECT 'people' AS metric, '' AS member, CAST(count(*) AS BIGINT) AS n FROM people UNION ALL SELECT 'relationships', '', count(*) FROM rels
UNION ALL SELECT 'certainty', certainty, count(*) FROM rels GROUP BY certainty UNION ALL SELECT 'quotes', '', count(*) FROM src
UNION ALL SELECT CASE WHEN verified THEN 'verified' ELSE 'pending' END, '', count(*) FROM src GROUP BY 1
UNION ALL SELECT 'pointers', '', count(*) FROM src WHERE trim(quote) = '' UNION ALL SELECT 'voice', coalesce(voice, 'none'), count(*) FROM src WHERE trim(quote) <> '' GROUP BY 2""")
def dashboard(spark, sf):
    return aggregates.dashboard(corpus.people(spark, sf), corpus.relationships(spark, sf), corpus.sources(spark, sf))


@query("verification_totals", PRELUDE + "SELECT CAST(count(*) FILTER (verified) AS BIGINT) AS ok, CAST(count(*) FILTER (NOT verified) AS BIGINT) AS pending, CAST(count(*) FILTER (quote = '') AS BIGINT) AS pointers, CAST(count(*) AS BIGINT) AS total FROM src")
def verification_totals(spark, sf):
    return aggregates.verification_totals(corpus.sources(spark, sf))


@query("verification_from_labels", """
SELECT CAST(count(*) FILTER (quality = 1) AS BIGINT) AS ok, CAST(count(*) FILTER (coalesce(quality, 0) <> 1) AS BIGINT) AS pending,
  CAST(count(*) FILTER (text = '') AS BIGINT) AS pointers, CAST(count(*) AS BIGINT) AS total FROM documents LEFT JOIN labels USING (doc_id)""")
def verification_from_labels(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return aggregates.verification_totals(d.select(F.col("text").alias("quote"), (F.col("quality") == 1).alias("verified")))


@query("degrees", PRELUDE + """, e AS (SELECT unnest([a, b]) AS id, certainty FROM rels)
SELECT p.id, CAST(count(e.id) AS BIGINT) AS degree, CAST(count(e.id) FILTER (e.certainty <> 'platonic') AS BIGINT) AS map_degree FROM people p LEFT JOIN e ON e.id = p.id GROUP BY p.id""")
def degrees(spark, sf):
    people, rels = corpus.people(spark, sf), corpus.relationships(spark, sf)
    d = aggregates.degrees(rels, people)
    m = aggregates.degrees(filters.map_edges(rels), people, "map_degree")
    return d.join(m, "id")


@query("edge_verification", PRELUDE + "SELECT r.id, CAST(count(*) FILTER (s.verified) AS BIGINT) AS ok, CAST(count(*) FILTER (NOT s.verified) AS BIGINT) AS pending FROM rels r LEFT JOIN src s ON s.owner_id = r.id GROUP BY r.id")
def edge_verification(spark, sf):
    return aggregates.edge_verification(corpus.relationships(spark, sf), corpus.sources(spark, sf))


@query("vocabulary_present", PRELUDE + "SELECT DISTINCT certainty AS word, 'class' AS kind FROM rels UNION SELECT DISTINCT grp, 'group' FROM people WHERE grp <> 'engineers'")
def vocabulary_present(spark, sf):
    c = ordering.in_vocabulary_order(corpus.relationships(spark, sf).select(F.col("certainty").alias("word")), "word", vocab.CERTAINTY_ORDER)
    g = ordering.in_vocabulary_order(corpus.people(spark, sf).select(F.col("group").alias("word")), "word", vocab.GROUP_ORDER)
    return c.select("word", F.lit("class").alias("kind")).union(g.select("word", F.lit("group")))


@query("same_word_venues", """
WITH v AS (SELECT p_brand AS city, 'v' || p_partkey AS place_id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) END AS venue FROM part)
SELECT city, array_to_string(list_sort(string_split(lower(venue), ' ')), ' ') AS words, CAST(count(*) AS BIGINT) AS n, min(place_id) AS first_id, max(place_id) AS last_id FROM v GROUP BY 1, 2 HAVING count(*) > 1""")
def same_word_venues(spark, sf):
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    v = table(spark, sf, "part").select(
        F.col("p_brand").alias("city"), F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("place_id"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat(second, F.lit(" "), first)).alias("venue"))
    return aggregates.same_word_venues(v)


@query("identical_places", """
SELECT p_name AS venue, p_type AS street, p_brand AS city, NULL AS region, NULL AS country, CAST(count(*) AS BIGINT) AS n, min('v' || p_partkey) AS first_id, max('v' || p_partkey) AS last_id
FROM part GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def identical_places(spark, sf):
    none = F.lit(None).cast("string")
    v = table(spark, sf, "part").select(
        F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("place_id"), F.col("p_name").alias("venue"),
        F.col("p_type").alias("street"), F.col("p_brand").alias("city"), none.alias("region"), none.alias("country"))
    return aggregates.identical_places(v)


# ------------------------------------------------------------------ letters, coverage, gate
def _record():
    return F.concat("owner_id", F.lit("["), F.col("source_id").cast("string"), F.lit("]"))


_CITED = PRELUDE + """,
alls AS (SELECT owner_id, source_id, pk, letter_id, two_letters FROM src UNION ALL SELECT owner_id, source_id, pk, letter_id, two_letters FROM eng),
cit AS (SELECT DISTINCT letter_id, owner_id || '[' || source_id || ']' AS record FROM alls WHERE letter_id IS NOT NULL
  UNION SELECT DISTINCT unnest(['lett/' || pk || '#1', 'lett/' || pk || '#2']), owner_id || '[' || source_id || ']' FROM alls WHERE two_letters),
matches AS (
  SELECT p_type AS archive, split_part(p_brand, '#', 2) AS item, CASE WHEN p_size % 4 <> 0 THEN 'lett/' || p_partkey || '#' || (1 + p_size % 3) END AS letter_id,
    p_size AS p1, p_size + p_partkey % 3 AS p2, CASE WHEN p_size % 7 = 0 THEN 'Person' END AS person,
    CASE p_size % 10 WHEN 0 THEN 'Envelope ' || p_name WHEN 1 THEN 'typed copy of ' || p_name WHEN 2 THEN 'Photostat' WHEN 3 THEN 'letter to Hub' ELSE p_name END AS what,
    p_type || ' folder' AS title, CASE WHEN p_size % 2 = 0 THEN 'box ' || p_size % 8 ELSE '' END AS box_folder FROM part)
"""


def _citing(spark, sf):
    return coverage.citing_records(sets.holders(corpus.sources(spark, sf), corpus.engagement_sources(spark, sf)), _record())


def _matches(spark, sf):
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.col("p_type").alias("archive"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("item"),
        F.when(size % 4 != 0, F.concat(F.lit("lett/"), key.cast("string"), F.lit("#"), (1 + size % 3).cast("string"))).alias("letter_id"),
        F.array(size.cast("bigint"), (size + key % 3).cast("bigint")).alias("pages"), F.when(size % 7 == 0, "Person").alias("person"),
        F.when(size % 10 == 0, F.concat(F.lit("Envelope "), "p_name")).when(size % 10 == 1, F.concat(F.lit("typed copy of "), "p_name"))
        .when(size % 10 == 2, "Photostat").when(size % 10 == 3, "letter to Hub").otherwise(F.col("p_name")).alias("what"),
        F.concat("p_type", F.lit(" folder")).alias("title"),
        F.when(size % 2 == 0, F.concat(F.lit("box "), (size % 8).cast("string"))).otherwise("").alias("box_folder"))


@query("cited_letters", _CITED + "SELECT DISTINCT letter_id FROM cit")
def cited_letters(spark, sf):
    return sets.cited_letters(sets.holders(corpus.sources(spark, sf), corpus.engagement_sources(spark, sf)))


@query("citing_records", _CITED + "SELECT letter_id, CAST(count(*) AS BIGINT) AS citers, min(record) AS first_record, max(record) AS last_record FROM cit GROUP BY 1")
def citing_records(spark, sf):
    return _citing(spark, sf).groupBy("letter_id").agg(
        F.count(F.lit(1)).alias("citers"), F.min("record").alias("first_record"), F.max("record").alias("last_record"))


@query("citation_coverage", _CITED + """
SELECT archive, 'pp.' || p1 || '-' || p2 AS span, m.letter_id, coalesce(m.letter_id, CASE WHEN person IS NOT NULL THEN 'folder, not per letter' ELSE 'no id' END) AS state,
  CAST(coalesce(c.n, 0) AS BIGINT) AS citers, what AS label FROM matches m LEFT JOIN (SELECT letter_id, count(*) AS n FROM cit GROUP BY 1) c ON m.letter_id = c.letter_id""")
def citation_coverage(spark, sf):
    return coverage.coverage(_matches(spark, sf), _citing(spark, sf)).select("archive", "span", "letter_id", "state", "citers", "label")


@query("uncited_documents", _CITED + "SELECT letter_id, what AS label FROM matches WHERE letter_id IS NULL OR letter_id NOT IN (SELECT letter_id FROM cit)")
def uncited_documents(spark, sf):
    return coverage.uncited(coverage.coverage(_matches(spark, sf), _citing(spark, sf))).select("letter_id", "label")


@query("linked_documents", _CITED + """
SELECT CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (letter_id IN (SELECT letter_id FROM cit)) AS BIGINT) AS linked,
  CAST(count(*) FILTER (coalesce(letter_id NOT IN (SELECT letter_id FROM cit), TRUE)) AS BIGINT) AS unlinked FROM matches""")
def linked_documents(spark, sf):
    return coverage.linked_counts(coverage.coverage(_matches(spark, sf), _citing(spark, sf)))


@query("same_folio_other_letter", _CITED + """, h AS (SELECT DISTINCT letter_id FROM matches WHERE letter_id IS NOT NULL)
, mi AS (SELECT DISTINCT letter_id, split_part(letter_id, '#', 1) AS stem FROM cit WHERE letter_id NOT IN (SELECT letter_id FROM h)), ne AS (SELECT letter_id, split_part(letter_id, '#', 1) AS stem FROM h)
SELECT stem, letter_id, 'cited' AS role FROM mi WHERE stem IN (SELECT stem FROM ne) UNION ALL SELECT stem, letter_id, 'held' FROM ne WHERE stem IN (SELECT stem FROM mi)""")
def same_folio_other_letter(spark, sf):
    held = _matches(spark, sf).where("letter_id IS NOT NULL")
    return coverage.same_folio_other_letter(_citing(spark, sf), held)


_TIER = """CASE WHEN archive IN ('PROMO') THEN 'excluded' WHEN what LIKE 'Envelope%' THEN 'not-a-document' WHEN what LIKE 'typed cop%' THEN 'typescript'
  WHEN what = 'Photostat' THEN 'photostat' WHEN item IN ('3', '4') THEN 'third-party' WHEN starts_with(coalesce(letter_id, ''), 'lett/1') THEN 'autograph-printed'
  WHEN item IN ('7') OR what = 'letter to Hub' THEN 'autograph-incoming' ELSE 'autograph-unprinted' END"""
_RULES = dict(subject_pattern=r"(?i)\bto (?:Big )?Hub\b", incoming=["7"], third_party=["3", "4"], excluded=["PROMO"], printed_prefix="lett/1")


def _backlog(spark, sf):
    return coverage.backlog(_matches(spark, sf), corpus.transcriptions(spark, sf), **_RULES)


@query("transcription_backlog", _CITED + f"""
SELECT archive, item, letter_id, CAST(p1 AS BIGINT) AS first_page, what, {_TIER} AS tier, coalesce(letter_id IN (SELECT letter_id FROM held), FALSE) AS done FROM matches""")
def transcription_backlog(spark, sf):
    return ordering.backlog_order(_backlog(spark, sf)).select("archive", "item", "letter_id", F.col("pages")[0].alias("first_page"), "what", "tier", "done")


@query("backlog_totals", _CITED + f"""
SELECT tier, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (done) AS BIGINT) AS done, CAST(count(*) FILTER (NOT done) AS BIGINT) AS left
FROM (SELECT {_TIER} AS tier, coalesce(letter_id IN (SELECT letter_id FROM held), FALSE) AS done FROM matches) GROUP BY 1""".replace("AS left", 'AS "left"'))
def backlog_totals(spark, sf):
    return coverage.backlog_totals(_backlog(spark, sf))


@query("backlog_skipped_rollup", _CITED + f"""
SELECT tier, archive, item, box_folder, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, {_TIER} AS tier FROM matches) WHERE tier IN ('typescript', 'third-party', 'excluded')
GROUP BY GROUPING SETS ((tier), (tier, archive, item, box_folder))""")
def backlog_skipped_rollup(spark, sf):
    return coverage.skipped_rollup(_backlog(spark, sf))


@query("published_transcriptions", _CITED + """
SELECT letter_id, transcribed_from FROM (SELECT *, row_number() OVER (PARTITION BY letter_id ORDER BY CASE transcribed_from WHEN 'facsimile' THEN 0 ELSE 1 END, "at") AS rn FROM held)
WHERE rn = 1 AND letter_id IN (SELECT letter_id FROM cit)""")
def published_transcriptions(spark, sf):
    """Only cited letters cross the gate, without the internal path column."""
    held = dedup.preferred_reading(corpus.transcriptions(spark, sf), ["letter_id", "transcribed_from", "at", "quote"])
    cited = cited_letters(spark, sf)
    return publish.publishable(held, cited).select("letter_id", "transcribed_from")


@query("leaked_transcriptions", _CITED + """SELECT letter_id, "at" FROM held WHERE transcribed_from = 'printed' AND letter_id NOT IN (SELECT letter_id FROM cit)""")
def leaked_transcriptions(spark, sf):
    """What publishing everything held would leak."""
    return publish.leaks(corpus.transcriptions(spark, sf), cited_letters(spark, sf)).select("letter_id", "at")


@query("waiting_letters", _CITED + "SELECT letter_id FROM held GROUP BY 1 HAVING bool_and(transcribed_from = 'printed') AND letter_id NOT IN (SELECT letter_id FROM cit)")
def waiting_letters(spark, sf):
    return sets.waiting(corpus.transcriptions(spark, sf), cited_letters(spark, sf))


@query("reading_flags", _CITED + "SELECT source_id, coalesce(letter_id IN (SELECT letter_id FROM held), FALSE) AS full_text, contains(quote, '…') AS is_cut FROM src")
def reading_flags(spark, sf):
    return prj.with_reading_flags(corpus.sources(spark, sf), corpus.transcriptions(spark, sf)).select("source_id", "full_text", "is_cut")


@query("letter_id_arrays", PRELUDE + "SELECT source_id, CASE WHEN letter_id IS NOT NULL THEN letter_id WHEN two_letters THEN 'lett/' || pk || '#1,lett/' || pk || '#2' ELSE '' END AS ids FROM src")
def letter_id_arrays(spark, sf):
    return corpus.sources(spark, sf).select("source_id", F.array_join(prj.source_letter_ids(), ",").alias("ids"))


@query("publication_summary", _CITED + """, loc AS (SELECT count(*) AS n FROM src WHERE repository IS NOT NULL),
l AS (SELECT letter_id, count(*) AS n, bool_or(transcribed_from = 'facsimile') AS fac FROM held GROUP BY 1)
SELECT 'pages indexed' AS metric, (SELECT count(*) FROM lineitem) AS n UNION ALL SELECT 'documents located', n FROM loc UNION ALL SELECT 'held', (SELECT count(*) FROM held)
UNION ALL SELECT 'from the edition', (SELECT count(*) FROM held WHERE transcribed_from = 'printed') UNION ALL SELECT 'held twice', CAST(sum(n - 1) AS BIGINT) FROM l
UNION ALL SELECT 'waiting', count(*) FROM l WHERE NOT fac AND letter_id NOT IN (SELECT letter_id FROM cit)""")
def publication_summary(spark, sf):
    m = F.when(F.col("repository").isNotNull(), F.struct(
        F.col("repository"), *[F.lit(None).cast("string").alias(x) for x in ("archived_as", "as_of", "recorded_by", "owner")]))
    located = prj.with_location(corpus.sources(spark, sf).withColumn("manuscript", m), corpus.works(spark, sf))
    return aggregates.publication_summary(table(spark, sf, "lineitem").select("l_orderkey"), located, corpus.transcriptions(spark, sf), cited_letters(spark, sf))


@query("audit_ledger", PRELUDE + """
SELECT owner_id AS id, source_id, CASE WHEN quote = '' THEN '[POINTER] ' || supports[1:60] ELSE quote[1:60] || ' …' END AS opening,
  coalesce(w.short_cite, src.work) || ', ' || locator AS cite, CASE WHEN verified THEN 'read at the page' ELSE 'pending' END AS mark FROM src LEFT JOIN works w USING (work)""")
def audit_ledger(spark, sf):
    return publish.ledger(corpus.relationships(spark, sf), corpus.sources(spark, sf), corpus.works(spark, sf)).select(
        "id", "source_id", "opening", "cite", "mark")


@query("cited_pages", PRELUDE + """
SELECT page, CAST(count(DISTINCT owner_id) AS BIGINT) AS citers FROM (SELECT owner_id, unnest(range(n, n + p_size % 3 + 1)) AS page FROM src WHERE citation_provenance IS NOT NULL) GROUP BY 1""")
def cited_pages(spark, sf):
    pairs = coverage.cited_pages(corpus.sources(spark, sf), "citation_provenance", "owner_id")
    return pairs.groupBy("page").agg(F.count(F.lit(1)).alias("citers")).orderBy("page")


@query("page_numbers_in_urls", r"""
SELECT DISTINCT CAST(regexp_extract(url, '/(\d+)', 1) AS BIGINT) AS page, regexp_extract(url, '^https?://([^/]+)', 1) AS citer FROM pages WHERE regexp_extract(url, '/(\d+)', 1) <> ''""")
def page_numbers_in_urls(spark, sf):
    """The page-citation job on addresses: their first numeric path part counts as a cited page."""
    p = table(spark, sf, "pages").withColumn("host", F.regexp_extract("url", r"^https?://([^/]+)", 1))
    return coverage.cited_pages(p, "url", "host", r"(?<=[a-z])/(\d+)(-\d+)?")


# ------------------------------------------------------------------ scanned pages
def _pages(spark, sf):
    li = table(spark, sf, "lineitem").where("l_linestatus = 'F'")
    return li.select(F.concat(F.lit("arc"), F.col("l_suppkey").cast("string")).alias("archive"),
                     F.col("l_partkey").cast("string").alias("item"), F.col("l_linenumber").cast("bigint").alias("page")).distinct()


def _facsimiles(spark, sf):
    li = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return li.select(
        F.col("l_orderkey").alias("source_id"),
        F.struct(F.concat(F.lit("arc"), F.col("l_suppkey").cast("string")).alias("archive"), F.col("l_partkey").cast("string").alias("item"),
                 F.array(F.lit(1).cast("bigint"), F.col("l_linenumber").cast("bigint")).alias("pages"), F.lit("  a sheet ").alias("caption")).alias("facsimile"))


_PAGES = """WITH pg AS (SELECT DISTINCT 'arc' || l_suppkey AS archive, CAST(l_partkey AS VARCHAR) AS item, CAST(l_linenumber AS BIGINT) AS page FROM lineitem WHERE l_linestatus = 'F'),
fac AS (SELECT l_orderkey AS source_id, 'arc' || l_suppkey AS archive, CAST(l_partkey AS VARCHAR) AS item, unnest([CAST(1 AS BIGINT), CAST(l_linenumber AS BIGINT)]) AS page, unnest([0, 1]) AS page_pos FROM lineitem WHERE l_returnflag = 'R'),
ok AS (SELECT fac.* FROM fac JOIN pg USING (archive, item, page))
"""


@query("facsimile_pages", _PAGES + "SELECT source_id, archive, item, page_pos, page, 'a sheet' AS caption FROM ok")
def facsimile_pages(spark, sf):
    """Cited pages that the archive's index really has."""
    return prj.resolve_facsimiles(_facsimiles(spark, sf), _pages(spark, sf), ["source_id"]).select(
        "source_id", "archive", "item", "page_pos", "page", "caption")


@query("facsimile_strip", _PAGES + """, own AS (SELECT DISTINCT source_id, archive, item, page FROM ok), fol AS (SELECT DISTINCT source_id, archive, item FROM ok)
SELECT f.source_id, f.archive, f.item, pg.page, own.page IS NULL AS rest FROM fol f JOIN pg USING (archive, item) LEFT JOIN own ON own.source_id = f.source_id AND own.archive = f.archive AND own.item = f.item AND own.page = pg.page""")
def facsimile_strip(spark, sf):
    """The cited pages, then the rest of their folder."""
    cited = prj.resolve_facsimiles(_facsimiles(spark, sf), _pages(spark, sf), ["source_id"])
    return prj.facsimile_strip(cited, _pages(spark, sf), ["source_id"]).orderBy("source_id", "archive", "item", "rest", "page")


@query("page_first_citation", _PAGES + "SELECT archive, item, page, s.source_id FROM pg LEFT JOIN (SELECT archive, item, page, min(source_id) AS source_id FROM ok GROUP BY ALL) s USING (archive, item, page)")
def page_first_citation(spark, sf):
    cited = prj.resolve_facsimiles(_facsimiles(spark, sf), _pages(spark, sf), ["source_id"])
    return joins.page_citation(_pages(spark, sf), cited, "source_id").select("archive", "item", "page", "source_id")


@query("image_addresses", """
SELECT p_partkey, 'https://iiif.example.org/' || replace(replace(p_name, ' ', '%20'), '#', '%23') || '/' || p_size || '/full/240,/0/default.jpg' AS address FROM part""")
def image_addresses(spark, sf):
    return table(spark, sf, "part").select("p_partkey", prj.image_address(
        F.lit("https://iiif.example.org/{pointer}/{page}"), F.col("p_name"), F.col("p_size"), "240,").alias("address"))


@query("credited_portraits", "SELECT p_partkey, 'img/' || p_partkey AS file FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45)")
def credited_portraits(spark, sf):
    credits = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("img/"), F.col("p_partkey").cast("string")).alias("file"))
    files = table(spark, sf, "lineitem").where("l_returnflag = 'A' AND l_quantity > 45").select(F.concat(F.lit("img/"), F.col("l_partkey").cast("string")).alias("file"))
    return joins.credited_portraits(credits, files).select("p_partkey", "file")


# ------------------------------------------------------------------ citations against texts
@query("passages_in_documents", r"""
WITH b AS (SELECT item_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS t FROM benchmark),
r AS (SELECT item_id, array_to_string(list_slice(string_split(t, ' '), 1, 14), ' ') AS run FROM b WHERE len(string_split(t, ' ')) >= 6),
d AS (SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents)
SELECT DISTINCT item_id, doc_id FROM r JOIN d ON contains(d.t, r.run)""")
def passages_in_documents(spark, sf):
    """Benchmark passages contained in documents, found through shared word runs."""
    return citations.contained_passages(table(spark, sf, "benchmark"), table(spark, sf, "documents"))


def _doc_citations(spark, sf):
    """Each document cites the first document opening with the same three words."""
    d = spread(table(spark, sf, "documents")).select("doc_id", "text", F.array_join(F.slice(text.words(F.col("text")), 1, 3), " ").alias("opening"))
    first = d.groupBy("opening").agg(F.min("doc_id").alias("first_doc"))
    src = d.join(first, "opening").where("doc_id <> first_doc").select(
        "doc_id", F.lit("").alias("locator"), F.col("text").alias("quote"), F.concat(F.lit("d/"), F.col("first_doc").cast("string")).alias("letter_id"),
        F.lit(None).cast("array<string>").alias("letter_ids"))
    letters = table(spark, sf, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("letter_id"), F.col("text").alias("quote"))
    return citations.citations_with_letters(src, letters, ["doc_id"])


@query("citation_check_exact", r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS t,
  array_to_string(list_slice(list_filter(string_split(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''), 1, 3), ' ') AS opening FROM documents),
f AS (SELECT opening, min(doc_id) AS first_doc FROM d GROUP BY 1)
SELECT d.doc_id, 'd/' || f.first_doc AS letter_id, contains(l.t, array_to_string(list_slice(string_split(d.t, ' '), 1, 14), ' ')) AS found
FROM d JOIN f USING (opening) JOIN d l ON l.doc_id = f.first_doc WHERE d.doc_id <> f.first_doc AND len(string_split(d.t, ' ')) >= 6""")
def citation_check_exact(spark, sf):
    return citations.check_citations(_doc_citations(spark, sf), fuzzy=False).select("doc_id", "letter_id", "found")


@query("citation_check_fuzzy")
def citation_check_fuzzy(spark, sf):
    """The same with the tolerant comparison on what is not found exactly."""
    return citations.check_citations(_doc_citations(spark, sf)).select("doc_id", "letter_id", "exact", "found")
