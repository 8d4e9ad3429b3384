"""Panels without a shuffle of their own, and cards merged by a digest: the same rows, fewer bytes."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sourceweave.catalog import shared
from sourceweave.operators import dedup, filters, joins
from sourceweave.plans import panels

SF = "/root/testdata/sf0.001"
COLS = "owner_id string, owner_pos long, people array<string>, engagement_pos long, subject string, source_pos long, source_id long, work string, locator string, quote string"


def told(df):
    return sorted(map(str, df.select("person", "route", "label", "label_id", "source_id", "card_order").collect()))


def test_named_panel_is_the_person_panel(spark):
    people = spark.createDataFrame([("a", 0, "Ann A", None, None), ("b", 1, "Bea B", None, None)], "id string, pos long, name string, sort_name string, aka array<string>")
    edge = spark.createDataFrame([("b--a", 3, ["b", "a"], None, None, 0, 1, "w", "p", "q"), ("a--z", 4, ["a", "z"], None, None, 0, 2, "w", "p", "q")], COLS)
    own = spark.createDataFrame([("a", 0, ["a"], 5, "Bea B", 0, 10, "w", "p", "q"), ("b", 1, ["b"], 6, "Nobody", 0, 11, "w", "p", "q"), ("b", 1, ["b"], 7, "bea b", 0, 12, "w", "p", "q")], COLS)
    name = F.create_map(F.lit("a"), F.lit("Ann A"), F.lit("b"), F.lit("Bea B"))
    of = {"Bea B": "b", "bea b": "b"}
    subject = F.create_map(*[F.lit(x) for kv in of.items() for x in kv])
    named = joins.named_panel(edge.withColumn("names", F.transform("people", lambda p: F.try_element_at(name, p))),
                              own.withColumn("owner_name", F.try_element_at(name, "owner_id")).withColumn("subject_id", F.try_element_at(subject, "subject")))
    assert told(named) == told(joins.person_panel(edge, own, people))


def test_the_panel_of_the_tables_moves_no_row(spark):
    rows = shared.panel(spark, SF)
    assert rows.count() > 0
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def near(spark):
    """Keys that read alike when they are glued together, blanks and unknown places."""
    rows = [("a", 0, 1, "ab", "c", "q", "X"), ("a", 0, 2, "a", "bc", "q", "X"), ("a", 0, 3, "a", None, "q", "X"), ("a", 1, 4, "a", "-", "q", "X"),
            ("a", 0, 5, "a", "", "q", "X"), ("a", 0, 6, "a", None, "", "X"), ("a", 0, 7, "a", None, "", "X"), ("a", 1, 8, "a", "bc", "Q!", "Ring"), ("b", 0, 9, "a", "bc", "q", "X")]
    return spark.createDataFrame(rows, "person string, route int, source_id int, work string, locator string, quote string, label string").withColumn("card_order", F.struct("route", "source_id"))


def test_cards_are_told_apart_and_their_texts_stay(near):
    cards = dedup.merge_cards(near, ["source_id"])
    assert sorted((r["source_id"], r["also"]) for r in cards.collect()) == [(1, 0), (2, 1), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0), (9, 0)]
    plan = cards._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\(([a-z]+)#", plan)) == {"card"}


def test_a_card_is_found_by_any_of_its_names(near):
    rows = dedup.with_card(near).withColumn("hay_names", F.lower("label"))
    found = filters.filter_sources(panels.found_cards(rows, " RING ", "names", ["source_id"]).withColumn("year", F.lit(None).cast("int")))
    assert [r["source_id"] for r in found.where("shown").collect()] == [2]


def test_names_on_cards(near):
    df = near.withColumns({"owner_id": F.lit("e"), "label_id": F.lit(None).cast("string")})
    want = dedup.card_names(dedup.merge_duplicates(df)).groupBy("person").agg(F.count(F.lit(1)).alias("names"), F.countDistinct("identity").alias("identities"))
    got = dedup.names_on_cards(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_excerpt_rules_read_the_stored_lines(spark):
    plan = entry.queries()["rules_excerpts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" in plan and "l_discount" not in plan
