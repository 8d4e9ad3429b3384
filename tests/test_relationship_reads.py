"""Relationship views read their tables once each, and counts of sources come with the relationships."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from sourceweave.operators import aggregates

SF = "/root/testdata/sf0.001"


def test_a_list_makes_its_relationships_once(spark):
    plan = entry.queries()["relationship_list"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "l_orderkey" in line for line in plan.splitlines()) == 2


def test_relationships_carry_their_counts(spark):
    rels = spark.createDataFrame([("a", 1), ("b", 2)], "id string, pos long")
    src = spark.createDataFrame([("a", True), ("a", None), ("a", False), ("z", True)], "owner_id string, verified boolean")
    got = aggregates.with_edge_verification(rels, src).select("id", "pos", "ok", "pending")
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1, 2), ("b", 2, 0, 0)]
