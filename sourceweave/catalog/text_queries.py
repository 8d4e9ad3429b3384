"""Text, label and heading jobs over documents, pages, conversations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceweave import vocab
from sourceweave.catalog import corpus
from sourceweave.catalog.corpus import PRELUDE, table
from sourceweave.catalog.registry import query
from sourceweave.functions import dates, text
from sourceweave.operators import aggregates, citations, headings
from sourceweave.physical import spread
from sourceweave.streaming import resumable

_FOLD = "trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'))"


# ------------------------------------------------------------------ keys
@query("excerpt_keys", r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g')))) AS key FROM documents")
def excerpt_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.excerpt_key(F.col("text"))).alias("key"))


@query("name_keys", "SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[.''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))) AS key FROM conversations")
def name_keys(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(text.name_key(F.col("text"))).alias("key"))


@query("word_bags", f"SELECT doc_id, CAST(len(list_filter(string_split({_FOLD.format(c='text')}, ' '), lambda x: x <> '')) AS BIGINT) AS words, md5({_FOLD.format(c='text')}) AS key FROM documents")
def word_bags(spark, sf):
    w = text.words(F.col("text"))
    return spread(table(spark, sf, "documents")).select("doc_id", w.alias("w")).select(
        "doc_id", F.size("w").cast("bigint").alias("words"), F.md5(F.array_join("w", " ")).alias("key"))


@query("unelided_runs", f"""
WITH p AS (SELECT conv_id, turn, unnest(string_split(text || ' … ' || role || ' said so', '…')) AS part FROM conversations),
w AS (SELECT conv_id, turn, list_filter(string_split({_FOLD.format(c='part')}, ' '), lambda x: x <> '') AS ws FROM p)
SELECT conv_id, turn, CAST(count(*) AS BIGINT) AS runs, min(array_to_string(list_slice(ws, 1, 14), ' ')) AS first_run FROM w WHERE len(ws) >= 6 GROUP BY ALL""")
def unelided_runs(spark, sf):
    q = F.concat("text", F.lit(" … "), "role", F.lit(" said so"))
    df = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(text.unelided_runs(q)).alias("run"))
    return df.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("runs"), F.min(text.run_text(F.col("run"))).alias("first_run"))


# ------------------------------------------------------------------ spans, terms
@query("marked_spans", r"""
WITH l AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS line FROM documents),
k AS (SELECT *, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) AS probe FROM l)
SELECT doc_id, CASE WHEN length(probe) >= 12 THEN CAST(length(line) - length(regexp_replace(lower(line), '^[^a-z0-9]+', '')) AS INT) END AS "start",
  CASE WHEN length(probe) >= 12 THEN CAST(length(regexp_replace(lower(line), '[^a-z0-9]+$', '')) AS INT) END AS "end" FROM k""")
def marked_spans(spark, sf):
    """Where a document's first line stands in the document."""
    d = spread(table(spark, sf, "documents"))
    spans = text.marked_spans(F.col("text"), F.substring_index("text", "\n", 1))
    return d.select("doc_id", F.try_element_at(spans, F.lit(1)).alias("s")).select("doc_id", "s.start", "s.end")


@query("quoted_spans", r"""
WITH l AS (SELECT doc_id, lower(text) AS low, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS flat, regexp_split_to_array(lower(text), '[a-z0-9]+') AS seps,
  trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g')) AS p1, trim(regexp_replace(lower(string_split(text, chr(10))[-1]), '[^a-z0-9]+', ' ', 'g')) AS p2 FROM documents),
f AS (SELECT *, CASE WHEN length(p1) >= 12 AND strpos(flat, p1) > 0 THEN strpos(flat, p1) END AS a1 FROM l),
g AS (SELECT *, coalesce(a1 + length(p1), 1) AS after1, strpos(substr(flat, coalesce(a1 + length(p1), 1)), p2) AS r2 FROM f),
s AS (
  SELECT doc_id, flat, seps, 0 AS run, a1 AS lo, a1 + length(p1) - 1 AS hi FROM g WHERE a1 IS NOT NULL
  UNION ALL SELECT doc_id, flat, seps, 1, after1 + r2 - 1, after1 + r2 + length(p2) - 2 FROM g WHERE length(p2) >= 12 AND r2 > 0),
n AS (SELECT *, length(substr(flat, 1, lo - 1)) - length(replace(substr(flat, 1, lo - 1), ' ', '')) AS s1, length(substr(flat, 1, hi - 1)) - length(replace(substr(flat, 1, hi - 1), ' ', '')) AS s2 FROM s)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS INT) AS pos,
  CAST(length(array_to_string(seps[1:s1 + 1], '')) + lo - 1 - s1 AS INT) AS "start", CAST(length(array_to_string(seps[1:s2 + 1], '')) + hi - 1 - s2 + 1 AS INT) AS "end" FROM n""")
def quoted_spans(spark, sf):
    """Where the runs of a quotation stand in its document: the first line, an elision, the last line; every span."""
    d = spread(table(spark, sf, "documents"))
    quote = F.concat(F.substring_index("text", "\n", 1), F.lit(" … "), F.substring_index("text", "\n", -1))
    return d.select("doc_id", F.posexplode(text.marked_spans(F.col("text"), quote)).alias("pos", "s")).select("doc_id", "pos", "s.start", "s.end")


@query("term_occurrences", "SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) AS n, CASE WHEN contains(lower(text), 'the') THEN CAST(strpos(lower(text), 'the') - 1 AS INT) END AS first_offset FROM documents")
def term_occurrences(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.term_count(F.col("text"), "The").alias("n"), F.try_element_at(text.term_offsets(F.col("text"), "The"), F.lit(1)).alias("first_offset"))


# ------------------------------------------------------------------ language, emphasis, controls
def _lang_sql() -> str:
    rows = ",\n".join("(%d, '%s', [%s])" % (i, k, ", ".join("'" + w + "'" for w in ws)) for i, (k, ws) in enumerate(vocab.FUNCTION_WORDS.items()))
    return rf"""
WITH lang(ord, name, ws) AS (VALUES {rows}),
t AS (SELECT doc_id, lang AS said, greatest(1, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS words, text,
  regexp_split_to_array(regexp_replace(lower(text), '(^|[^\p{{L}}\p{{N}}_])[jlndcstm][’''][\p{{L}}\p{{N}}_]+', '\1 elidedform ', 'g'), '[^\p{{L}}\p{{N}}_]+') AS tok FROM documents),
h AS (SELECT doc_id, said, words, ord, name, len(list_filter(tok, lambda x: list_contains(ws, x) OR (name = 'French' AND x = 'elidedform'))) AS hits FROM t, lang),
b AS (SELECT doc_id, said, words, first(name ORDER BY hits DESC, ord) AS name, max(hits) AS hits FROM h GROUP BY ALL)
SELECT doc_id, said, CASE WHEN hits >= 4 AND hits / words >= 0.14 THEN name END AS language, CAST(CASE WHEN hits >= 4 AND hits / words >= 0.14 THEN hits ELSE 0 END AS BIGINT) AS hits, CAST(words AS BIGINT) AS words FROM b"""


@query("foreign_guess", _lang_sql())
def foreign_guess(spark, sf):
    """Documents that read as clearly not English, by function words."""
    d = spread(table(spark, sf, "documents")).select("doc_id", F.col("lang").alias("said"), text.foreign_guess(F.col("text")).alias("g"))
    return d.select("doc_id", "said", "g.language", "g.hits", "g.words")


@query("unbalanced_emphasis", r"""
SELECT doc_id FROM documents WHERE regexp_matches(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\*\*[^*\n]+\*\*', 'x', 'g'), '\*[^*\n]+\*', 'x', 'g'),
  '__[^_\n]+__', 'x', 'g'), '_[^_\n]+_', 'x', 'g'), '~~[^~\n]+~~', 'x', 'g'), '[*_~]')""")
def unbalanced_emphasis(spark, sf):
    return spread(table(spark, sf, "documents")).where(text.unbalanced_emphasis(F.col("text"))).select("doc_id")


@query("control_characters", r"""
SELECT doc_id, CASE WHEN p > 0 THEN CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS BIGINT) END AS line, CASE WHEN p > 0 THEN CAST(length(regexp_extract(before, '[^\n]*$')) + 1 AS BIGINT) END AS col
FROM (SELECT doc_id, CASE WHEN n % 3 = 0 THEN nl + 10 ELSE 0 END AS p, CASE WHEN n % 3 = 0 THEN text[1:nl + 9] END AS before FROM (SELECT doc_id, text, n_chars AS n, length(split_part(text, chr(10), 1)) AS nl FROM documents))""")
def control_characters(spark, sf):
    """First stray control character of each text; one is planted behind the first line of some."""
    d, nl = table(spark, sf, "documents"), F.length(F.substring_index("text", "\n", 1))
    planted = F.concat(F.substring(F.col("text"), F.lit(1), nl + 9), F.lit("\u0008"), F.substring(F.col("text"), nl + 10, F.length("text")))
    # a text shorter than the planting place gets the character at its end
    planted = F.when(F.col("n_chars") % 3 == 0, planted).otherwise(F.col("text"))
    return d.select("doc_id", text.control_character(planted).alias("c")).select("doc_id", "c.line", "c.col")


# ------------------------------------------------------------------ transcripts
@query("transcript_reproduced", r"""
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(upper(role) || 'X: ' || text, '\b[A-Z][A-Z .''\-]*[A-Z]:\s*', '', 'g'), '\?\s*[—–]\s*', '? ', 'g'), '\s+', ' ', 'g')) = trim(regexp_replace(text, '\s+', ' ', 'g')) AS same FROM conversations""")
def transcript_reproduced(spark, sf):
    """A labelled quotation against its stored turn: nothing may be dropped or reworded."""
    quote = F.concat(F.upper("role"), F.lit("X: "), "text")
    turns = F.array(F.struct(F.col("role").alias("who"), F.col("text").alias("text")))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.turns_match(quote, turns).alias("same"))


@query("transcript_turns", r"""
WITH q AS (SELECT conv_id, turn, trim(upper(role) || ': ' || text || ' then SECOND VOICE: ' || text) AS raw FROM conversations),
p AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(raw, '\s*\b([A-Z][A-Z .''\-]*[A-Z]):\s*', chr(1) || '\1' || chr(2), 'g'), chr(1)), lambda x: x <> '') AS parts FROM q),
t AS (SELECT conv_id, turn, unnest(parts) AS x, unnest(range(len(parts))) AS pos FROM p WHERE len(parts) > 1)
SELECT conv_id, turn, CAST(pos AS INT) AS pos, CASE WHEN contains(x, chr(2)) THEN x[1] || lower(string_split(x, chr(2))[1][2:]) ELSE '' END AS who,
  trim(string_split(x, chr(2))[-1], chr(10) || ' ') AS said FROM t""")
def transcript_turns(spark, sf):
    """Labelled voices split back into turns, those that a text itself labels among them."""
    quote = F.concat(F.upper("role"), F.lit(": "), "text", F.lit(" then SECOND VOICE: "), "text")
    df = table(spark, sf, "conversations")
    turns = text.split_transcript(quote, F.lit(""), F.lit(""))
    return df.select("conv_id", "turn", F.posexplode(turns).alias("pos", "t")).select(
        "conv_id", "turn", "pos", "t.who", F.trim("t.text", F.lit(" \n")).alias("said"))


@query("exchange_turns", """
SELECT p_partkey, i AS pos, CASE i WHEN 0 THEN 'Asker' WHEN 1 THEN 'Witness' WHEN 2 THEN 'Asker' ELSE 'Witness' END AS who,
  CASE i WHEN 0 THEN 'Was it ' || p_name || '?' WHEN 1 THEN 'It was ' || p_type || '.' WHEN 2 THEN 'Sure?' ELSE 'Yes, Mr. ' || p_brand END AS said FROM part, (VALUES (0), (1), (2), (3)) v(i)""")
def exchange_turns(spark, sf):
    """Question and answer split on the question's dash, the next question cut off the answer."""
    quote = F.concat(F.lit("Was it "), "p_name", F.lit("?—It was "), "p_type", F.lit(". Sure?—Yes, Mr. "), "p_brand")
    turns = text.split_transcript(quote, F.lit("Lord Witness, in court"), F.lit("Mr Asker"))
    return table(spark, sf, "part").select("p_partkey", F.posexplode(turns).alias("pos", "t")).select("p_partkey", "pos", "t.who", F.col("t.text").alias("said"))


# ------------------------------------------------------------------ names and labels
@query("short_surnames", "SELECT p_partkey, split_part(p_name, ' ', 2) AS surname FROM part")
def short_surnames(spark, sf):
    who = F.concat(F.lit("Sir "), "p_name", F.lit(" (the elder), "), "p_type")
    return table(spark, sf, "part").select("p_partkey", text.short_surname(who).alias("surname"))


@query("short_repositories", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' Library' ELSE 'Bodleian' END AS short FROM nation")
def short_repositories(spark, sf):
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("The "), "n_name", F.lit(" Library, Town"))).otherwise("Bodleian Library, Oxford")
    return table(spark, sf, "nation").select("n_nationkey", text.short_repository(name).alias("short"))


@query("speaker_capacities", PRELUDE + """
SELECT source_id, CASE WHEN pr = '1-URGENT' THEN c_name WHEN pr = '2-HIGH' THEN p_brand END AS name, CASE WHEN pr = '1-URGENT' THEN '' WHEN pr = '2-HIGH' THEN CASE WHEN addressee IS NOT NULL THEN '' ELSE 'letter to ' || s_name END END AS capacity FROM src""")
def speaker_capacities(spark, sf):
    c = text.speaker_capacity(F.col("speaker"), F.col("addressee"))
    return corpus.sources(spark, sf).select("source_id", F.when(F.col("speaker").isNotNull(), c).alias("c")).select("source_id", "c.name", "c.capacity")


@query("letter_id_shapes", r"""
WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS id FROM pages)
SELECT page_id, regexp_matches(id, '^[a-z0-9][a-z0-9._-]*/[A-Za-z0-9._:-]+(?:#\d+)?$') AS ok, nullif(regexp_extract(id, '^[^/]+/(\d+)', 1), '') AS folio, regexp_replace(id, '#[^#]*$', '') AS stem FROM u""")
def letter_id_shapes(spark, sf):
    lid = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf, "pages").select("page_id", text.is_letter_id(lid).alias("ok"), text.folio(lid).alias("folio"), text.stem(lid).alias("stem"))


@query("shelfmarks", "SELECT s_suppkey, s_nationkey % 3 <> 2 AS mark FROM supplier")
def shelfmarks(spark, sf):
    n, k = F.col("s_nationkey"), F.col("s_suppkey").cast("string")
    name = F.when(n % 3 == 0, F.concat(F.lit("Library, MS "), k)).when(n % 3 == 1, F.concat(F.lit("Library (Add. MS"), k, F.lit(")"))).otherwise(F.concat(F.lit("Library of MSS No "), k))
    return table(spark, sf, "supplier").select("s_suppkey", text.has_shelfmark(name).alias("mark"))


@query("place_labels", PRELUDE + "SELECT place_id, CASE WHEN concat_ws(', ', venue, street, city) = '' THEN coalesce(country, '') ELSE concat_ws(', ', venue, street, city) END AS label FROM places")
def place_labels(spark, sf):
    """Labels of places whose region is left out, so the country can show."""
    p = corpus.places(spark, sf).withColumn("region", F.lit(None).cast("string"))
    s = F.struct(*vocab.PLACE_FIELDS)
    return p.select("place_id", dates.place_label(s).alias("label"))


@query("clock_times", "SELECT event_id, strftime(ts, '%H:%M') AS t FROM events")
def clock_times(spark, sf):
    """Printed times ("3.50 p.m.") as 24-hour times."""
    printed = F.concat(F.date_format("ts", "h"), F.lit("."), F.date_format("ts", "mm"), F.when(F.hour("ts") < 12, " a.m.").otherwise(" p.m."))
    return table(spark, sf, "events").select("event_id", dates.clock_time(printed).alias("t"))


@query("canonical_addresses", "SELECT p_partkey, '1 ' || p_name || ' Street' AS address FROM part")
def canonical_addresses(spark, sf):
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("[? I  "), "p_name", F.lit(" Street]"))).otherwise(
        F.concat(F.lit("3.30 p.m. , I "), "p_name", F.lit(" Street Private")))
    return table(spark, sf, "part").select("p_partkey", headings.canonical_address(raw).alias("address"))


@query("timeline_keys", PRELUDE + "SELECT id, CAST(round(born_y + (coalesce(born_m, 6.5) - 1) / 12.0 + 15 / 372.0, 6) AS DOUBLE) AS key FROM people")
def timeline_keys(spark, sf):
    return corpus.people(spark, sf).select("id", F.round(dates.timeline_key(F.col("born")["date"]), 6).alias("key"))


# ------------------------------------------------------------------ headings
def headings_of(orders):
    """A letter heading for every order, in one of five printed forms."""
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    d = F.col("o_orderdate") - F.expr("INTERVAL 100 YEARS")
    dm, y, wd = F.date_format(d, "d MMMM"), F.date_format(d, "yyyy"), F.date_format(d, "EEEE")
    place = F.concat(F.lit("1"), F.substring("o_orderkey", -1, 1), F.lit(" Market Street"))
    head = (
        F.when(pr == "1-URGENT", F.concat(wd, F.lit(" ["), dm, F.lit(" "), y, F.lit("]\n\n"), place))
        .when(pr == "2-HIGH", F.concat(dm, F.lit(" ["), y, F.lit("] 3.50 p.m. "), place))
        .when(pr == "3-MEDIUM", F.concat(wd, F.lit(" [Postmark "), dm, F.lit(" "), y, F.lit("]\n\n["), place, F.lit("]")))
        .when(pr == "5-LOW", F.concat(place, F.lit(" "), F.date_format(d, "MMMM"), F.lit(" "), y))
        .otherwise(F.concat(F.lit("3 or 4 "), F.date_format(d, "MMMM"), F.lit(" "), y)))
    return orders.select(
        F.col("o_orderkey").alias("file"), F.lit("Somebody").alias("addressee"),
        F.concat(head, F.lit("\n\nMy dear Friend, order "), F.col("o_orderkey").cast("string"), F.lit(" came.")).alias("quote"), (st == "P").alias("already_dated"))


def order_headings(spark, sf):
    return headings_of(table(spark, sf, "orders"))


def order_aliases(spark, sf):
    """Known addresses: those the orders' last digits 0 to 7 give."""
    k = F.substring("o_orderkey", -1, 1)
    return table(spark, sf, "orders").select(k.alias("k")).distinct().where("k < '8'").select(
        F.concat(F.lit("1"), "k", F.lit(" Market Street")).alias("address"), F.concat(F.lit("market-"), "k").alias("place_id"))


_HEAD = """WITH h AS (SELECT o_orderkey AS file, o_orderstatus AS st, o_orderpriority AS pr, CAST(o_orderdate - INTERVAL 100 YEAR AS DATE) AS d, right(CAST(o_orderkey AS VARCHAR), 1) AS k FROM orders),
r AS (SELECT *, CASE WHEN st = 'P' THEN 'skipped' WHEN pr = '4-NOT SPECIFIED' OR k >= '8' THEN 'flagged' ELSE 'parsed' END AS status FROM h)
"""


@query("heading_extraction", _HEAD + """
SELECT file, status, CASE WHEN status = 'flagged' THEN CASE WHEN pr = '4-NOT SPECIFIED' THEN 'ambiguous range or alternative' WHEN pr = '5-LOW' THEN 'heading date unreadable' ELSE 'unmapped place' END END AS reason,
  CASE WHEN st <> 'P' AND pr <> '4-NOT SPECIFIED' AND NOT (pr = '5-LOW' AND k >= '8') THEN CAST(year(d) AS BIGINT) END AS y,
  CASE WHEN st <> 'P' AND pr NOT IN ('3-MEDIUM', '4-NOT SPECIFIED') AND NOT (pr = '5-LOW' AND k >= '8') THEN CAST(month(d) AS BIGINT) END AS m,
  CASE WHEN st <> 'P' AND pr IN ('1-URGENT', '2-HIGH') THEN CAST(day(d) AS BIGINT) END AS d,
  CASE WHEN st <> 'P' AND pr IN ('1-URGENT', '3-MEDIUM') THEN lower(dayname(d)) END AS weekday,
  CASE WHEN st <> 'P' AND pr = '2-HIGH' THEN '15:50' END AS t, CASE WHEN st <> 'P' AND pr IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN TRUE END AS inferred,
  CASE WHEN st <> 'P' AND pr = '3-MEDIUM' THEN CAST(day(d) AS BIGINT) END AS post_d,
  CASE WHEN st <> 'P' AND pr <> '4-NOT SPECIFIED' AND k < '8' THEN 'market-' || k END AS place FROM r""")
def heading_extraction(spark, sf):
    """Dates and places read back out of every order's heading; ambiguous ones are quarantined."""
    res, _ = headings.extract(order_headings(spark, sf), order_aliases(spark, sf))
    w = F.when(F.col("reason").isNull() | (F.col("reason") == "unmapped place"), F.col("written"))["date"]
    return res.select("file", "status", "reason", w["y"].alias("y"), w["m"].alias("m"), w["d"].alias("d"), w["weekday"].alias("weekday"),
                      w["t"].alias("t"), w["inferred"].alias("inferred"), F.col("postmarked")["date"]["d"].alias("post_d"), F.col("written_place").alias("place"))


def more_headings(orders):
    """Ten further printed forms, by order key: French and roman days, seasons, parts, ranges, acts in brackets, many paragraphs, readings that differ."""
    k = F.col("o_orderkey") % 10
    d = F.col("o_orderdate") - F.expr("INTERVAL 100 YEARS")
    dm, my, y, wd = F.date_format(d, "d MMMM"), F.date_format(d, "MMMM yyyy"), F.date_format(d, "yyyy"), F.date_format(d, "EEEE")
    next_day = F.date_format(d + F.expr("INTERVAL 1 DAY"), "d MMMM yyyy")
    place, text, c = F.lit("12 Market Street"), F.lit, F.concat
    roman = F.when(F.day(d) % 2 == 0, "IV").otherwise("XIX")
    head = F.element_at(F.array(
        c(text("le "), F.day(d).cast("string"), text(" mai "), y, text(" "), place),
        c(roman, text(" "), my, text("\n\n"), place),
        c(text("Spring "), y, text("\n\n"), place),
        c(text("early "), my, text(" "), place),
        c(y, text("-"), (F.year(d) + 2).cast("string"), text(" "), place),
        c(dm, text(" "), y, text(" [Received "), next_day, text("]\n\n"), place),
        c(dm, text(" [Postmark "), next_day, text("] [Received "), next_day, text("]\n\n"), place),
        c(text("Private\n\nLetter - No. IV\n\n"), wd, text("\n\n[on verso]\n\n["), dm, text(" "), y, text("]\n\n"), place),
        c(text("May-June "), y, text(" "), place),
        c(dm, text(" "), y, text(" ["), next_day, text("]\n\n"), place)), (k + 1).cast("int"))
    return orders.select(F.col("o_orderkey").alias("file"), F.lit("Somebody").alias("addressee"),
                         F.concat(head, F.lit("\n\nMy dear Friend, order "), F.col("o_orderkey").cast("string"), F.lit(" came.\n\nYours ever")).alias("quote"))


@query("heading_forms", """
WITH h AS (SELECT o_orderkey AS file, o_orderkey % 10 AS k, CAST(o_orderdate - INTERVAL 100 YEAR AS DATE) AS d, CAST(o_orderdate - INTERVAL 100 YEAR AS DATE) + 1 AS e FROM orders)
SELECT file, CASE WHEN k >= 8 THEN 'flagged' ELSE 'parsed' END AS status,
  CASE k WHEN 8 THEN 'ambiguous range or alternative' WHEN 9 THEN 'a date and a bracket that differ' END AS reason,
  CASE WHEN k < 8 THEN CAST(year(CASE WHEN k = 6 THEN e ELSE d END) AS BIGINT) END AS y,
  CASE WHEN k IN (1, 3, 5, 6, 7) THEN CAST(month(d) AS BIGINT) WHEN k = 0 THEN 5 END AS m,
  CASE WHEN k IN (0, 5, 6, 7) THEN CAST(day(d) AS BIGINT) WHEN k = 1 THEN CASE WHEN day(d) % 2 = 0 THEN 4 ELSE 19 END END AS d,
  CASE WHEN k = 7 THEN lower(dayname(d)) END AS weekday, CASE WHEN k = 2 THEN 'spring' END AS season, CASE WHEN k = 3 THEN 'early' END AS part,
  CASE WHEN k = 4 THEN CAST(year(d) + 2 AS BIGINT) END AS to_y,
  CASE WHEN k = 6 THEN CAST(day(e) AS BIGINT) END AS post_d, CASE WHEN k IN (5, 6) THEN CAST(month(e) AS BIGINT) END AS received_m,
  CASE WHEN k IN (5, 6) THEN CAST(day(e) AS BIGINT) END AS received_d, CASE WHEN k < 8 THEN 'market-2' END AS place,
  'My dear Friend, order ' || file || ' came.' || chr(10) || chr(10) || 'Yours ever' AS body FROM h""")
def heading_forms(spark, sf):
    """Headings of many paragraphs, acts and kinds of dates, with the body that is left."""
    res, _ = headings.extract(more_headings(table(spark, sf, "orders")), order_aliases(spark, sf))
    w = F.when(F.col("reason").isNull(), F.col("written"))["date"]
    post, got = (F.when(F.col("reason").isNull(), F.col(x))["date"] for x in ("postmarked", "received"))
    return res.select("file", "status", "reason", *[w[x].alias(x) for x in ("y", "m", "d", "weekday", "season", "part")], w["to"]["y"].alias("to_y"),
                      post["d"].alias("post_d"), got["m"].alias("received_m"), got["d"].alias("received_d"), F.col("written_place").alias("place"), "body")


@query("heading_summary", _HEAD + "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (status = 'parsed') AS BIGINT) AS parsed, CAST(count(*) FILTER (status = 'flagged') AS BIGINT) AS flagged, CAST(count(*) FILTER (status = 'skipped') AS BIGINT) AS skipped FROM r")
def heading_summary(spark, sf):
    return aggregates.extraction_summary(headings.extract(order_headings(spark, sf), order_aliases(spark, sf))[0])


@query("unmapped_places", _HEAD + "SELECT '1' || k || ' Market Street' AS place_text, CAST(count(*) AS BIGINT) AS files, min(file) AS example FROM r WHERE st <> 'P' AND pr NOT IN ('4-NOT SPECIFIED', '5-LOW') AND k >= '8' GROUP BY 1")
def unmapped_places(spark, sf):
    _, unmapped = headings.extract(order_headings(spark, sf), order_aliases(spark, sf))
    clean = unmapped.withColumn("place_text", F.regexp_replace("place_text", r"^\[|\]$", ""))
    return aggregates.unmapped_places(clean)


@query("heading_stream", _HEAD + "SELECT status, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1")
def heading_stream(spark, sf):
    """The same extraction as a resumable file stream that stops when it has caught up."""
    out = resumable.run_headings(
        resumable.order_heading_stream(spark, sf), order_aliases(spark, sf))
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("repeated_acts_merged", """
SELECT l_orderkey, l_returnflag AS act, arg_min(l_linenumber, (l_shipdate, l_partkey, l_suppkey, l_linenumber)) FILTER (l_linenumber > 2) AS line FROM lineitem GROUP BY 1, 2""")
def repeated_acts_merged(spark, sf):
    """Acts given more than once: the first value of each field wins."""
    li = table(spark, sf, "lineitem")
    acts = li.select("l_orderkey", F.col("l_returnflag").alias("act"), F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber").alias("pos"),
                     F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("line"))
    return headings.first_of_each_act(acts, ["l_orderkey"])


@query("passage_word_runs", f"SELECT item_id, array_to_string(list_slice(string_split({_FOLD.format(c='text')}, ' '), 1, 14), ' ') AS run FROM benchmark WHERE len(string_split({_FOLD.format(c='text')}, ' ')) >= 6")
def passage_word_runs(spark, sf):
    runs = table(spark, sf, "benchmark").select("item_id", F.explode(text.unelided_runs(F.col("text"), citations.MIN_RUN)).alias("run"))
    return runs.select("item_id", text.run_text(F.col("run"), citations.RUN).alias("run"))
