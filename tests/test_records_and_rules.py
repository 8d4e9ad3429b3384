from collections import Counter

import pytest
from pyspark.sql import functions as F

from sourceweave import schemas
from sourceweave.operators import coverage, dedup, sets
from sourceweave.operators import projections as prj
from sourceweave.plans import publish
from sourceweave.rules import checks
from sourceweave.sources import records
from tests.conftest import SOURCE


def counts(df):
    return Counter(r["rule"] for r in df.collect())


@pytest.fixture(scope="module")
def loaded(spark, tree):
    root = f"file://{tree}"
    people = records.scan_entities(spark, f"{root}/people/*.json", schemas.PERSON)
    rels = records.scan_entities(spark, f"{root}/rels/*.json", schemas.RELATIONSHIP)
    works = records.scan_keyed_map(spark, f"{root}/works.json", schemas.WORK, "work")
    places = records.scan_keyed_map(spark, f"{root}/places.json", schemas.PLACE, "place_id")
    return people, rels, works, places


def test_scan_keeps_bad_files_as_rows(loaded):
    people = loaded[0]
    assert people.where("load_error IS NOT NULL").count() == 1 and people.where("load_error IS NULL").count() == 3
    assert loaded[3].count() == 3


def test_people_rules(loaded):
    c = counts(checks.people(loaded[0]))
    assert c == {"P1": 1, "P3": 1, "P4": 1, "P5": 1, "P7": 1, "P8": 1, "A1": 2}


def test_relationship_rules(loaded):
    people, rels, _, places = loaded
    c = counts(checks.relationships(rels, people.where("load_error IS NULL"), places))
    assert c["R3"] == 1 and c["R5"] == 2 and c["R7"] == 1 and c["R8"] == 2 and c["R9"] == 1
    assert c["R1"] == 2 and c["R11"] == 2 and c["R12"] == 1 and c["R13"] == 1 and c["T3"] == 1 and "R4" not in c and "R14" not in c


def test_gazetteer_and_work_rules(loaded):
    _, _, works, places = loaded
    c = counts(checks.places(places))
    assert c == {"G2": 1, "G3": 3}
    assert counts(checks.works(works)) == {"W1": 1}
    assert counts(checks.gazetteer_missing(places.limit(0))) == {"G1": 1} and counts(checks.gazetteer_missing(places)) == {}


def source_df(spark, *overrides):
    rows = [dict(SOURCE, **o) for o in overrides]
    import json
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "n int, raw string")
    return df.select("n", "raw", F.from_json("raw", schemas.SOURCE).alias("s")).select("n", "raw", "s.*")


CASES = [
    ({}, {}),
    ({"verified": "yes"}, {"Q1": 2}),
    ({"verified_with": "pdf"}, {"Q2": 1}),
    ({"locator_type": "leaf"}, {"Q3": 1}),
    ({"voice": None}, {"Q4": 1}),
    ({"citation_provenance": " "}, {"Q5": 1}),
    ({"quote": ""}, {"Q6": 1}),
    ({"work": "zz"}, {"Q7": 1}),
    ({"order_hint": {"y": 1890, "why": ""}}, {"Q8": 1}),
    ({"voice": "period", "addressee": "Bea Smith"}, {"Q9": 1}),
    ({"voice": "period", "speaker": "Bea Smith, aside", "addressee": "Smith"}, {"Q9": 1}),
    ({"turns": [{"who": "", "text": "x"}]}, {"Q10": 1}),
    ({"voice": "court", "turns": [{"text": "Plain words here"}]}, {"Q10": 1}),
    ({"voice": "court", "turns": [{"who": "", "text": "Other words"}]}, {"Q10": 1}),
    ({"addressee": "X"}, {"Q11": 1}),
    ({"speaker": "Y, A life"}, {"Q12": 1}),
    ({"lang": "french"}, {"Q13": 1}),
    ({"lang": "fr"}, {"Q13": 1}),
    ({"translation": "x"}, {"Q13": 1}),
    ({"context": "Translation: 'x'"}, {"Q14": 1}),
    ({"quote": "les des une dans pour qui est"}, {"Q15": 1}),
    ({"quote": "a *b"}, {"Q16": 1}),
    ({"occurred": {"date": {"y": 1950}}}, {"Q17": 1}),
    ({"document": None}, {"D1": 1}),
    ({"verified_against": "original"}, {"D2": 1}),
    ({"verified_against_original": True, "verified_with": "text-layer"}, {"D3": 1}),
    ({"verified_against_original": False}, {"D3": 1}),
    ({"verified_marks": True, "verified_with": "text-layer"}, {"D4": 1}),
    ({"original_provenance": "seen"}, {"D5": 1}),
    ({"written": {"date": {"y": 1890}}}, {"S1": 1}),
    ({"document": "letter", "written": {"date": {"y": 1890}}, "occurred": {"date": {"y": 1890}}}, {"S2": 1}),
    ({"document": "letter", "written": {"date": {"y": 1898, "m": 3, "d": 21, "weekday": "tuesday"}}}, {"T4": 1}),
    ({"document": "letter", "written": {"date": {"y": 1900, "m": 2, "d": 30, "weekday": "monday"}}}, {}),
    ({"document": "letter", "written": {"date": {"y": 1900, "uncertain": False}}}, {"T6": 1}),
    ({"document": "letter", "written": {"date": {"y": 2100}}}, {"T7": 1, "Q17": 1}),
    ({"document": "letter", "written": {"date": {"y": 1900, "to": {"y": 1899}}}}, {"T1": 1}),
    ({"document": "letter", "written": {"date": {"y": 1900, "dd": 1}}}, {"T2": 1}),
    ({"document": "letter", "written": {"date": {}, "place": "paris"}}, {"A3": 1}),
    ({"document": "letter", "written": {"place": "paris", "by": 1}}, {"A1": 1}),
    ({"document": "letter", "written": {"date": {"y": 1890, "certainty": "stated"}}}, {"A3": 1}),
    ({"document": "letter", "written": {"place": "nowhere"}}, {"A2": 1}),
    ({"letter_id": "w/1", "letter_ids": ["w/1", "w/2"]}, {"L1": 1}),
    ({"letter_id": "Bad"}, {"L1": 1}),
    ({"letter_ids": ["w/1", "w/1"]}, {"L1": 1}),
    ({"manuscript": {"repository": "Library MS 12"}}, {"M1": 1}),
    ({"manuscript": {"repository": "Lib", "archived_as": "typescript", "owner": "Mr X", "url": "ftp://x"}}, {"M1": 3}),
]


def test_source_rules_one_case_each(spark, loaded):
    works = spark.createDataFrame([("w1", "Bea Smith", "A Life")], "work string, author string, title string")
    df = source_df(spark, *[c for c, _ in CASES])
    places = spark.createDataFrame([("paris",)], "place_id string")
    got = {i: Counter() for i in range(len(CASES))}
    for r in checks.sources(df, works, F.col("n").cast("string"), places).collect():
        got[int(r["record"])][r["rule"]] += 1
    for i, (case, want) in enumerate(CASES):
        assert got[i] == want, case


def test_manifest_flatten_facsimile_rules_and_strip(spark, tree):
    man = records.scan_manifests(spark, f"file://{tree}/manuscripts")
    archives, items, pages, matches = records.flatten_manifests(man)
    a = {r["archive"]: r for r in archives.collect()}
    assert a["hrc"]["short_name"] == "The Ransom" and a["loc"]["name"] == "loc"
    assert [r["rights_label"] for r in pages.orderBy("page").collect()] == ["In Copyright", ""]
    fac = lambda *f: spark.createDataFrame([(i, x) for i, x in enumerate(f)], "source_id int, facsimile struct<archive:string,item:string,pages:array<bigint>,caption:string>")
    df = fac(("hrc", "27", [1], " c "), ("hrc", "27", [2, 1, 1, 9], None), ("zz", "1", [1], None), ("loc", "1", [1], None), ("hrc", "9", [1], None), ("hrc", "27", [], None))
    got = Counter(int(r["record"]) for r in checks.facsimiles(df, F.col("source_id").cast("string"), archives, items, pages).collect())
    assert got == {1: 4, 2: 1, 3: 1, 4: 1, 5: 1}  # order, repeat, no pointer, no page; then one fatal each
    cited = prj.resolve_facsimiles(df, pages, ["source_id"])
    assert sorted((r["source_id"], r["page"], r["caption"]) for r in cited.where("source_id = 0").collect()) == [(0, 1, "c")]
    strip = prj.facsimile_strip(cited.where("source_id = 0"), pages, ["source_id"]).collect()
    assert sorted((r["page"], r["rest"]) for r in strip) == [(1, False), (2, True)]
    url = pages.where("page = 1").select(prj.image_address(F.lit("https://i/{pointer}/{page}"), F.col("pointer"), F.col("page")).alias("u")).first()["u"]
    assert url == "https://i/a%20b/1/full/full/0/default.jpg"
    src = source_df(spark, {"letter_id": "w/10#2"}, {"letter_ids": ["w/10#1", "w/10#3"]})
    citing = coverage.citing_records(src, F.col("n").cast("string"))
    cov = {r["state"]: r for r in coverage.coverage(matches, citing).collect()}
    assert cov["w/10#1"]["citers"] == 1 and cov["w/10#1"]["span"] == "pp.1-2" and cov["folder, not per letter"]["citers"] == 0
    assert counts(checks.manifest_matches(matches, citing)) == {"L3": 1, "L4": 2}
    tiers = coverage.backlog(matches, matches.where("letter_id = 'w/10#1'"), r"\bto Hub\b").collect()
    assert {(r["tier"], r["done"]) for r in tiers} == {("photostat", True), ("autograph-unprinted", False)}


def test_transcription_rules_and_gate(spark, tree, tmp_path):
    held = records.scan_transcriptions(spark, f"file://{tree}/manuscripts", f"file://{tree}/transcriptions")
    roster = spark.createDataFrame([("Ann Smith", ["Annie"]), ("Bea Smith", None)], "name string, aka array<string>")
    c = counts(checks.transcriptions(held, roster))
    assert c["N1"] == 1 and c["N3"] == 1 and c["N5"] == 1 and c["N7"] == 1 and c["N9"] == 1 and c["N10"] == 1 and c["N6"] >= 1
    ok = held.where("load_error IS NULL AND letter_id <> 'nope'")
    first, _ = dedup.one_reading_each(ok)
    best = dedup.preferred_reading(first, ["letter_id", "transcribed_from", "at", "quote"])
    assert {r["letter_id"]: r["transcribed_from"] for r in best.collect()} == {"w/10#1": "facsimile", "w/11#1": "facsimile", "w/12#1": "printed"}
    cited = sets.cited_letters(source_df(spark, {"letter_id": "w/10#1"}))
    publish.publish_transcriptions(best, cited, str(tmp_path / "t"))
    out = spark.read.parquet(str(tmp_path / "t"))
    assert out.count() == 1 and "at" not in out.columns
    with pytest.raises(publish.GateClosed):
        publish.assert_no_leaks(best, cited)
    assert [r["letter_id"] for r in sets.waiting(first, cited).collect()] == ["w/12#1"]


def test_gate_report_bundle_and_controls(spark, tree, loaded, tmp_path):
    people = loaded[0]
    v = checks.people(people)
    assert publish.report(v).count() >= 5
    with pytest.raises(publish.GateClosed):
        publish.gate(v)
    publish.gate(v.where("severity = 'warning'"))
    publish.write_bundle({"people": people}, str(tmp_path / "b"))
    back = publish.read_bundle(spark, str(tmp_path / "b"), "people")
    assert back.count() == 3 and "load_error" not in back.columns
    files = records.scan_text_files(spark, f"file://{tree}")
    found = checks.control_characters(files).collect()
    assert len(found) == 1 and found[0]["path"] == "BACKSPACE at line 2, column 5"
    listed = records.list_files(spark, f"file://{tree}/people", str(tree))
    assert "people/ann.json" in [r["file"] for r in listed.collect()]


def test_location_order_and_statement(spark):
    works = spark.createDataFrame([("w1", "secondary", "P", None, "Hart-Davis (ed.); X", "Hart 2000"), ("w2", "secondary-web", None, None, None, "Web")],
                                  "work string, kind string, publisher string, ia_id string, editors string, short_cite string")
    arc = spark.createDataFrame([("hrc", "Harry Ransom Center, The University of Texas at Austin", "HRC")], "archive string, name string, short_name string")
    df = source_df(spark, {}, {"work": "w2"}, {"document": "letter"}, {"manuscript": {"repository": "Bodleian Library, Oxford", "as_of": "1927"}},
                   {"facsimile": {"archive": "hrc", "item": "1", "pages": [1]}})
    out = prj.last_recorded(works, prj.with_location(df, works, arc)).orderBy("n").collect()
    assert [r["location"]["short"] for r in out] == ["Published", "Online", "Unknown", "Bodleian", "Ransom Center"]
    assert out[0]["recorded_by"] == "Hart-Davis, in Hart 2000"
    assert out[3]["held_statement"] == "Last known at Bodleian Library, Oxford, 1927" and out[4]["held_statement"].startswith("Held at Harry")


def test_repeated_records_and_places(spark):
    act = schemas.ACT
    none = F.lit(None).cast(act)
    p = spark.createDataFrame([("a", "A", "core", "f"), ("a", "A", "core", None)], "id string, name string, group string, gender string").select("*", none.alias("born"), none.alias("died"))
    assert counts(checks.people(p)) == {"P2": 1}
    r = spark.createDataFrame(
        [("a--b", ["a", "b"], "married", "confirmed"), ("a--b", ["a", "b"], "married", "confirmed"), ("x", ["a", "b"], "friends", "maybe")],
        "id string, people array<string>, certainty string, certainty_status string")
    r = r.select("*", none.alias("start"), none.alias("end"), *[F.lit(None).cast("string").alias(c) for c in ("direction", "outcome", "date_label")])
    roster = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert counts(checks.relationships(r, roster)) == {"R2": 1, "R4": 1, "R6": 2, "R14": 1}
    g = spark.createDataFrame([("p", None, "Nice"), ("q", None, "Nice"), ("r", "Hotel A", "Nice"), ("s", "A Hotel", "Nice")], "place_id string, venue string, city string")
    g = g.select("*", *[F.lit(None).cast("string").alias(c) for c in ("street", "region", "country")])
    used = spark.createDataFrame([("p",), ("q",), ("r",)], "place string")
    assert counts(checks.places(g, used)) == {"G4": 1, "G5": 1, "G6": 1}


def test_transcription_fields(spark):
    t = spark.createDataFrame(
        [("w/1", "copied", "a/1.json", "text", "A", "B"), ("w/2", "printed", "a/2.json", " ", "A", " "), ("w/2", "printed", "a/3.json", "text", "A", "B")],
        "letter_id string, transcribed_from string, at string, quote string, sender string, addressee string")
    assert counts(checks.transcriptions(t)) == {"N2": 1, "N4": 1, "N8": 1, "N10": 1}


def test_raw_place_references(spark):
    from sourceweave.operators import joins
    raw = spark.createDataFrame([('{"born":{"place":"rome"},"places":["paris", "nice"],"x":{"place": "bonn"}}',)], "raw string")
    assert {r["place"] for r in joins.raw_place_references(raw).collect()} == {"rome", "paris", "nice", "bonn"}


def test_findings_are_counted_while_written(spark, tmp_path):
    rows = [("A1", "error", f"r{i % 7}") for i in range(90)] + [("B1", "warning", None)] * 3
    v = spark.createDataFrame(rows, "rule string, severity string, record string").repartition(5)
    counts = publish.write_findings(v, str(tmp_path / "found"))
    assert counts == {"errors": 90, "warnings": 3} and spark.read.parquet(str(tmp_path / "found")).count() == 93
    with pytest.raises(publish.GateClosed, match="90 errors"):
        publish.gate_counts(counts)
    publish.gate_counts(publish.write_findings(v.where("rule = 'B1'"), str(tmp_path / "warned")))
    assert publish.write_findings(v.limit(0), str(tmp_path / "none")) == {"errors": 0, "warnings": 0}
