"""The trigram index gives the rows of the plain search, and reads postings only."""

import pytest
from pyspark.sql import functions as F

from sourceweave.catalog import corpus
from sourceweave.plans import panels
from sourceweave.plans.search_index import SearchIndex, grams, record_texts

SRC = "owner_id string, quote string, translation string, context string, supports string, citation_provenance string, translation_note string, locator string, order_hint struct<why:string>"
TERMS = ["Ann", "red house", "zz", "  NOTE ", "ÉTÉ", "😀 b", "house  red", "x" * 300, "grounds", "absent words", " "]


@pytest.fixture(scope="module")
def tables(spark):
    people = spark.createDataFrame(
        [("p1", "Ann Smith", ["Annie", "A. S."], "Smith, Ann", "Born in été", None), ("p2", "Bea", None, None, None, "a note"), ("p3", "", [], "", "", ""),
         ("hot", "Hub", ["Zz"], "Hub", "a😀 b", None), (None, "No one", None, None, "red house", None)],
        "id string, name string, aka array<string>, sort_name string, bio string, bio_note string")
    rels = spark.createDataFrame(
        [("r1", ["p1", "hot"], "A summary", None, "1890 by hand", ("red", "house", None, "Grounds")), ("r2", ["hot", "p2"], None, "why", None, None), ("r3", ["p1", "gone"], "", "", "", None)],
        "id string, people array<string>, summary string, certainty_reasoning string, date_label string, disputed struct<claim:string,asserted_by:string,disputed_by:string,grounds:string>")
    rows = [("r1", "The red", "house", None, None, "read at", None, "p. 1", ("by hand",)), ("r2", "x" * 5000 + " tail", None, None, None, None, None, None, None), ("none", "red house", *[None] * 7), (None, "red house", *[None] * 7)]
    rows += [("r2", "The red house stood", None, None, None, None, None, f"p. {i % 7}", None) for i in range(400)]
    eng = spark.createDataFrame([("p2", "Ann"), ("p3", None), ("p1", "a subject")], "owner_id string, subject string")
    return people, rels, spark.createDataFrame(rows, SRC), eng


def told(df):
    return sorted(map(str, df.select("id", "kind").collect()))


def test_same_rows_as_the_plain_search(spark, tables, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index")).build(record_texts(*tables))
    assert index.texts().groupBy("hay").count().where("count > 1").count() == 0  # 400 copies are one text
    for term in TERMS:
        for scope in ("all", "names", "quotes"):
            if scope == "all" or term == "red house":
                assert told(index.hits(tables[0], term, scope)) == told(panels.search_hits(*tables, term, scope)), (term, scope)


def test_a_term_reads_its_postings(spark, tables, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index")).build(record_texts(*tables))
    plan = index.postings("red house")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket), ", "") and "PushedFilters: [In(gram" in plan
    assert index.postings("zz") is None and index.postings("qqqq").count() == 0
    assert index.postings("tail").count() == 1


def test_grams(spark):
    got = spark.createDataFrame([("abcabc",), ("ab",), ("",), ("a😀bc",), (None,)], "t string").select("t", grams(F.col("t")).alias("g")).collect()
    assert {r.t: r.g and sorted(r.g) for r in got} == {"abcabc": ["abc", "bca", "cab"], "ab": [], "": [], "a😀bc": ["a😀b", "😀bc"], None: got[4].g}


def test_empty(spark, tables, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index")).build(record_texts(*[t.limit(0) for t in tables]))
    assert {r.kind for r in index.hits(tables[0], "red house").collect()} == {None}


def test_postings_are_told_per_block(spark, tmp_path):
    """Postings of single texts would be many times the texts themselves."""
    rows = spark.range(6000).select(F.concat(F.lit("p"), F.col("id") % 50).alias("id"), F.lit("q").alias("kind"), F.format_string("order of customer no %05d", "id").alias("hay"))
    few = SearchIndex(spark, str(tmp_path / "few")).build(rows)
    assert few._read("grams").count() < 5 * 6000 and few.texts().count() == 6000
    people = spark.range(50).select(F.concat(F.lit("p"), F.col("id")).alias("id"))
    for per in (1, 7):  # a bucket of one block, and of several
        index = few
        if per > 1:
            index = SearchIndex(spark, str(tmp_path / "many"))
            index.BLOCK = 14
            index.build(rows)
            assert index.per() == per and index.postings("no 01234").count() < 7 * 64
        assert {r.id for r in index.hits(people, "no 01234").where("kind IS NOT NULL").collect()} == {"p34"}
        assert index.hits(people, "customer no").where("kind = 'quote'").count() == 50


def test_sources_with_people_are_not_shuffled_to_their_edge(spark, tables):
    people, rels, sources, eng = tables
    held = sources.join(rels.select(F.col("id").alias("owner_id"), "people"), "owner_id").localCheckpoint()
    with_people = record_texts(people, rels, held, eng)
    assert "Exchange" not in with_people._jdf.queryExecution().sparkPlan().toString()
    flat = lambda df: sorted(map(str, df.select(F.explode("ids").alias("id"), "kind", "hay").distinct().collect()))
    assert flat(with_people) == flat(record_texts(*tables))


def test_holders_stay_where_they_are_for_a_rare_term(spark, tables, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index")).build(record_texts(*tables))
    plan = index.hits(tables[0], "red house")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [bucket" in plan and "LeftSemi" in plan and "SortMergeJoin [bucket" not in plan


def test_edges_of_stored_lines_are_the_edges(spark):
    sf = "/root/testdata/sf0.001"
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(corpus.relationships(spark, sf, corpus.line_facts(spark, sf))) == rows(corpus.relationships(spark, sf))
