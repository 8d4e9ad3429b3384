"""Tables that grow with the input are not sent whole, and the rows are the same when they are shuffled."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sourceweave import physical
from sourceweave.catalog import corpus, shared

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def nothing_small(monkeypatch):
    monkeypatch.setattr(physical, "LOOKUP_LIMIT", 0)
    shared._TABLES.clear()
    yield
    shared._TABLES.clear()


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", ["person_panel_rows", "source_filter", "source_filter_names", "facet_counts", "rules_sources"])
def test_same_rows_when_nothing_is_sent(spark, name, monkeypatch):
    shared._TABLES.clear()
    want = rows(entry.queries()[name](spark, SF))
    monkeypatch.setattr(physical, "LOOKUP_LIMIT", 0)
    shared._TABLES.clear()
    assert want and rows(entry.queries()[name](spark, SF)) == want
    shared._TABLES.clear()


def test_a_growing_table_is_not_sent_for_its_few_columns(spark, nothing_small):
    """Only keys are read, so Spark's own estimate would send the parts and the customers."""
    plan = corpus.line_facts(spark, SF).select("l_orderkey")._jdf.queryExecution().sparkPlan().toString()
    sent = [block for block in plan.split("BroadcastHashJoin")[1:]]
    assert not any(k in block.split("\n")[0] for block in sent for k in ("c_custkey", "s_suppkey", "p_partkey"))
    assert plan.count("SortMergeJoin") >= 3


def test_limit_follows_what_rows_take_in_memory(spark):
    """A table of running numbers packs into a few bytes a row; it is not sent beyond 8 MB in files."""
    assert physical.LOOKUP_LIMIT <= 8 << 20
    ids = spark.range(1000).withColumn("name", F.concat(F.lit("Customer#"), F.col("id")))
    assert physical.is_small(ids) and not physical.is_small(spark.range(physical.LOOKUP_LIMIT))


def test_places_are_sent_at_any_size(spark, nothing_small):
    """A place is one of a few nations, whatever the lines: panel rows are never shuffled to meet it."""
    from sourceweave.catalog import panel_queries

    plan = panel_queries._source_rows(spark, SF).select("city")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan


def test_filter_rows_look_up_no_work(spark):
    """What the filters ask of a work comes with its line: the parts are not met again."""
    from sourceweave.catalog import panel_queries

    plan = panel_queries._source_rows(spark, SF).select("hay_all", "location")._jdf.queryExecution().optimizedPlan().toString()
    assert "part.parquet" not in plan and "p_retailprice" not in plan
