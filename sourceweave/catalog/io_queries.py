"""Scans, flattening, sinks and their round trips over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceweave import schemas
from sourceweave.catalog import corpus
from sourceweave.catalog.corpus import PRELUDE, table
from sourceweave.catalog.registry import query
from sourceweave.functions import records as rec
from sourceweave.operators import filters
from sourceweave.operators import projections as prj
from sourceweave.plans import publish
from sourceweave.session import shared_path
from sourceweave.sources import records


@query("entity_scan", """
SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (o_orderpriority = '5-LOW') AS BIGINT) AS bad,
  CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS BIGINT) AS explicit_null FROM orders GROUP BY 1""")
def entity_scan(spark, sf):
    """Orders written as JSON text, some of it broken, and scanned back with bad rows kept and null told from absent."""
    path = shared_path(spark, "entities")
    o, pr = table(spark, sf, "orders"), F.col("o_orderpriority")
    body = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("name")))
    text = F.when(pr == "5-LOW", F.concat(F.lit("{{"), F.col("o_orderstatus"))).when(
        pr == "1-URGENT", F.concat(F.expr("substring(b, 1, length(b) - 1)"), F.lit(',"group":null}'))).otherwise(F.col("b"))
    o.withColumn("b", body).select(text.alias("value")).write.text(path)
    df = records.scan_entities(spark, path, schemas.PERSON, per_file=False)
    status = F.when(F.col("load_error").isNull(), F.col("name")).otherwise(F.substring("raw", 3, 1))
    return df.groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("load_error").isNotNull()).alias("bad"),
        F.count_if(rec.explicit_null(F.col("raw"), "group")).alias("explicit_null"))


@query("loadable_records", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderpriority <> '5-LOW'")
def loadable_records(spark, sf):
    o = table(spark, sf, "orders").withColumn("load_error", F.when(F.col("o_orderpriority") == "5-LOW", "broken"))
    return filters.loadable(o).agg(F.count(F.lit(1)).alias("n"))


@query("keyed_map_rows", "SELECT 'e' || event_id AS event, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def keyed_map_rows(spark, sf):
    """The properties of all events written as a keyed map in lines, and scanned back as one row per key."""
    path = shared_path(spark, "keyed-map")
    table(spark, sf, "events").select(F.concat(F.lit('{"e'), F.col("event_id").cast("string"), F.lit('": '), "props", F.lit("}")).alias("value")).write.text(path)
    return records.scan_keyed_map(spark, path, T.StructType([T.StructField("k", T.LongType())]), "event", per_file=False).select("event", "k")


@query("unknown_keys", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, 'k' AS keys FROM events GROUP BY 1")
def unknown_keys(spark, sf):
    """Keys of each event's properties outside an allowed list."""
    keys = F.array_join(rec.unknown_keys(F.col("props"), ["id"]), ",")
    return table(spark, sf, "events").groupBy("event_type", keys.alias("keys")).agg(F.count(F.lit(1)).alias("n"))


@query("exploded_sources", "SELECT doc_id AS owner, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS source_pos, md5(unnest(l)) AS quote FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def exploded_sources(spark, sf):
    """Each document as a record whose lines are its sources."""
    src = F.transform(F.split("text", "\n", -1), lambda q: F.struct(q.alias("quote")))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array("lang").alias("people"), src.alias("sources"))
    return prj.explode_sources(docs).select(F.col("owner_id").alias("owner"), "source_pos", F.md5("quote").alias("quote"))


@query("exploded_engagements", """
WITH p AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS ep, string_split(unnest(l), '. ') AS s FROM p)
SELECT doc_id AS owner, CAST(ep AS BIGINT) AS engagement_pos, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS source_pos, md5(unnest(s)) AS quote FROM e""")
def exploded_engagements(spark, sf):
    """Two levels: lines are engagements, their sentences sources."""
    sentences = lambda line: F.transform(F.split(line, r"\. ", -1), lambda q: F.struct(q.alias("quote")))
    eng = F.transform(F.split("text", "\n", -1), lambda line: F.struct(F.lit("x").alias("subject"), sentences(line).alias("sources")))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), eng.alias("sexuality_sources"))
    return prj.explode_engagement_sources(docs).select(F.col("owner_id").alias("owner"), "engagement_pos", "source_pos", F.md5("quote").alias("quote"))


@query("manifest_pages", """
SELECT 'arc' || l_suppkey AS archive, CAST(l_partkey AS VARCHAR) AS item, CAST(l_linenumber AS BIGINT) AS page, CASE l_returnflag WHEN 'A' THEN 'In Copyright' WHEN 'N' THEN 'Copyright Undetermined' ELSE 'other' END AS rights_label
FROM (SELECT DISTINCT l_suppkey, l_partkey, l_linenumber, l_returnflag FROM lineitem WHERE l_linestatus = 'F')""")
def manifest_pages(spark, sf):
    """Manifests (one page per row here) flattened to pages with their rights in words."""
    li = table(spark, sf, "lineitem").where("l_linestatus = 'F'").select("l_suppkey", "l_partkey", "l_linenumber", "l_returnflag").distinct()
    rights = F.when(F.col("l_returnflag") == "A", "http://rightsstatements.org/vocab/InC/1.0/").when(
        F.col("l_returnflag") == "N", "http://rightsstatements.org/vocab/UND/1.0/").otherwise("other")
    page = F.struct(F.col("l_linenumber").cast("bigint").alias("page"), F.lit("p").alias("pointer"), F.lit("").alias("shelfmark"), rights.alias("rights"))
    item = F.struct(F.col("l_partkey").cast("string").alias("itemId"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("boxFolder"),
                    F.array(page).alias("pages"), F.array().cast(T.ArrayType(schemas.MATCH)).alias("matches"))
    none = F.lit(None).cast("string")
    m = li.select(F.concat(F.lit("arc"), F.col("l_suppkey").cast("string")).alias("archive_key"), none.alias("load_error"), none.alias("collection"), none.alias("download_url"),
                  F.lit(None).cast(schemas.MANIFEST["archive"].dataType).alias("archive"), F.array(item).alias("items"))
    return records.flatten_manifests(m)[2].select("archive", "item", "page", "rights_label")


@query("served_archives", "SELECT s_suppkey AS archive FROM supplier WHERE s_nationkey % 5 <> 0")
def served_archives(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("archive"), F.when(F.col("s_nationkey") % 5 != 0, "https://x").otherwise(" ").alias("iiif_url"))
    return filters.served_archives(a).select("archive")


@query("text_stores_union", "SELECT 'documents' AS origin, CAST(count(*) AS BIGINT) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages")
def text_stores_union(spark, sf):
    """Two stores with different columns as one table tagged with its origin."""
    d = table(spark, sf, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    p = table(spark, sf, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), "html", "url")
    return d.unionByName(p, allowMissingColumns=True).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("bundle_round_trip", PRELUDE + "SELECT 'people' AS entity, CAST(count(*) AS BIGINT) AS n FROM people UNION ALL SELECT 'relationships', count(*) FROM rels UNION ALL SELECT 'works', count(*) FROM works UNION ALL SELECT 'places', count(*) FROM places")
def bundle_round_trip(spark, sf):
    """Nested tables written as a bundle and read back."""
    path = shared_path(spark, "bundle")
    tables = {"people": corpus.people(spark, sf), "relationships": corpus.relationships(spark, sf), "works": corpus.works(spark, sf), "places": corpus.places(spark, sf)}
    publish.write_bundle(tables, path)
    docs = publish.bundle_documents({n: publish.read_bundle(spark, path, n) for n in tables})
    return docs.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query("pointers_and_quotations", PRELUDE + "SELECT CASE WHEN trim(quote) = '' THEN 'pointer' ELSE 'quotation' END AS kind, CAST(count(*) AS BIGINT) AS n FROM src GROUP BY 1")
def pointers_and_quotations(spark, sf):
    s = corpus.sources(spark, sf)
    return filters.pointers(s).select(F.lit("pointer").alias("kind")).union(filters.quotations(s).select(F.lit("quotation"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
