"""The stored panel: one bucket for one person, a refresh of the touched buckets only, whole results with a hot person."""

import os
import re

import pytest
from pyspark.sql import functions as F

from sourceweave.operators import dedup, joins
from sourceweave.plans.panel_store import PanelStore, bucket_of

SCHEMA = "person string, source_id long, route int, quote string, at struct<y:int>"


def rows_of(n=300):
    out = [(f"p{i % 40}", i, i % 3, f"words {i}", (i,)) for i in range(n)]
    return out + [("hot", 1000 + i, 0, "same words", None) for i in range(n // 2)] + [("hot", 1000, 0, "same words", None), ("", 5000, 1, None, None)]


@pytest.fixture()
def store(spark, tmp_path):
    return PanelStore(spark, str(tmp_path / "panel"), buckets=8).build(spark.createDataFrame(rows_of(), SCHEMA).repartition(4))


def told(df):
    return sorted(map(str, df.select("person", "source_id", "route", "quote", "at").collect()))


def files(df):
    return {re.sub(r"^file:/*", "/", f) for f in df.inputFiles()}


def bucket(spark, person, n=8):
    return spark.range(1).select(bucket_of(F.lit(person), n)).first()[0]


def test_one_person_is_one_bucket(spark, store):
    everything = spark.createDataFrame(rows_of(), SCHEMA)
    assert told(store.panel()) == told(everything)
    for person in ("hot", "p7", ""):
        one = store.person(person)
        assert told(one) == told(everything.where(F.col("person") == person))
        plan = one._jdf.queryExecution().executedPlan().toString()
        b = bucket(spark, person)
        assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {b}\)", plan) and "EqualTo(person" in plan
    assert told(store.person("nobody")) == []


def test_refresh_rewrites_touched_buckets_only(spark, store):
    before = files(store.table())
    changed = spark.createDataFrame([("p7", 9001, 0, "new", (1,)), ("new one", 9002, 1, "fresh", None), ("p1", 9003, 0, "not asked for", None)], SCHEMA)
    gone = spark.createDataFrame([("p7",), ("new one",), ("hot",), ("p7",)], "person string")
    touched = store.refresh(changed, gone)
    assert touched == sorted({bucket(spark, p) for p in ("p7", "new one", "hot")})
    want = [r for r in rows_of() if r[0] not in ("p7", "hot")] + [("p7", 9001, 0, "new", (1,)), ("new one", 9002, 1, "fresh", None)]
    assert told(store.panel()) == told(spark.createDataFrame(want, SCHEMA))
    of = lambda f: int(re.search(r"bucket=(\d+)", f).group(1))
    after = files(store.table())
    assert {f for f in before if of(f) not in touched} == {f for f in after if of(f) not in touched}
    assert all("generation=1" in f for f in after if of(f) in touched)
    assert store.drop_superseded() == len(touched) and all(os.path.exists(f) for f in after)
    assert told(store.panel()) == told(spark.createDataFrame(want, SCHEMA))
    assert store.refresh(changed.limit(0), gone.limit(0)) == []


def test_store_of_nothing_and_emptied_buckets(spark, tmp_path):
    nothing = PanelStore(spark, str(tmp_path / "none"), buckets=4).build(spark.createDataFrame([("a", 1, 0, "x", None)], SCHEMA))
    nothing.refresh(nothing.panel().limit(0), spark.createDataFrame([("a",)], "person string"))
    assert nothing.panel().count() == 0 and nothing.person("a").count() == 0


def test_pairs_of_a_panel_are_the_pairs_of_its_sources(spark):
    people = spark.createDataFrame([("a", 0, "Ann A", None, None), ("b", 1, "Bea B", None, None), ("c", 2, "Cid C", None, None)],
                                   "id string, pos long, name string, sort_name string, aka array<string>")
    cols = "owner_id string, owner_pos long, people array<string>, engagement_pos long, subject string, source_pos long, source_id long, work string, locator string, quote string"
    edge = spark.createDataFrame([("b--a", 3, ["b", "a"], None, None, 0, i, "w", "p", "q") for i in range(3)], cols)
    own = spark.createDataFrame([("a", 0, ["a"], 5, "Cid C", 0, 10, "w", "p", "q"), ("c", 2, ["c"], 6, "Ann A", 0, 11, "w", "p", "q"),
                                 ("b", 1, ["b"], 7, "Nobody", 0, 12, "w", "p", "q"), ("b", 1, ["b"], 8, "Bea B", 0, 13, "w", "p", "q")], cols)
    keep = lambda df: sorted(map(str, df.select("person", "route", "source_id", "card_order").collect()))
    panel = dedup.with_excerpt(joins.person_panel(edge, own, people))
    assert keep(joins.pair_panels_of(panel)) == keep(joins.all_pair_panels(edge, own, people))
    assert "excerpt" in panel.columns and dedup.with_excerpt(panel) is panel
