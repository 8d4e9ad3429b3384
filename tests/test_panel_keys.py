"""Cards known by numbers instead of texts: the same cards, and the numbers tell person and source."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from sourceweave.catalog import corpus, shared

SF = "/root/testdata/sf0.001"


def test_numbers_part_the_panel_as_its_texts_do(spark):
    rows = shared.panel(spark, SF).withColumn("solo", F.when(F.col("excerpt") == "", F.struct("route", "source_id"))).select(
        "card", F.struct("person", "work", "locator", "excerpt", "solo").alias("text"), "person", "source_id", "card_order")
    pairs = rows.select("card", "text").distinct().cache()
    assert pairs.count() == pairs.select("card").distinct().count() == pairs.select("text").distinct().count() > 0
    told = rows.withColumn("first", F.col("card_order")).select("person", "source_id", *[c.alias(f"t_{n}") for n, c in shared.told_by_card().items()])
    assert told.where((F.col("person") != F.col("t_person")) | (F.col("source_id") != F.col("t_source_id"))).count() == 0


def test_person_numbers_go_both_ways(spark):
    ids = spark.createDataFrame([("c000000012",), ("s000000012",), (None,)], "id string")
    back = ids.select("id", corpus.person_id(corpus.person_number(F.col("id"))).alias("back"))
    assert all(r["id"] == r["back"] for r in back.collect())


def test_a_merge_moves_no_text_of_a_person(spark):
    cards = entry.queries()["person_panel_cards"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    merge = next(line for line in cards.splitlines() if "partial_min" in line)
    assert "person#" not in merge and "md5" not in cards


def test_stored_lines_tell_positions_and_names_by_their_keys(spark):
    facts = shared.panel_facts(spark, SF)
    people = corpus.people(spark, SF).select("id", "pos", "name")
    for p, key in (("c", corpus.cid(F.col("o_custkey"))), ("s", corpus.sid(F.col("sk")))):
        met = facts.select(key.alias("id"), f"{p}_pos", f"{p}_name", f"{p}_named").distinct().join(people, "id")
        assert met.count() > 0 and met.where((F.col("pos") != F.col(f"{p}_pos")) | (F.col("name") != F.col(f"{p}_name"))).count() == 0
        assert met.where(F.col(f"{p}_named") == F.col("id")).count() > 0
    first = corpus.relationships(spark, SF).select("people", F.col("pos").alias("first"))
    edges = facts.select(F.array(corpus.cid(F.col("o_custkey")), corpus.sid(F.col("sk"))).alias("people"), "edge_pos")
    assert edges.join(first, "people").where(F.col("first") != F.col("edge_pos")).count() == 0
    kept = shared.once(spark, SF, "facts", None).columns
    assert not {"c_pos", "s_pos", "edge_pos", "c_named", "s_named"} & set(kept)


def test_a_merge_moves_one_text_for_three_facets(spark):
    plan = entry.queries()["facet_totals"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    merge = next(line for line in plan.splitlines() if "partial_min" in line)
    assert "parts" in merge and "document" not in merge and "keys=[card#" not in merge
