import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceweave import schemas
from sourceweave.functions import dates, geometry, records, text
from sourceweave.operators import headings


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def date(**k):
    return tuple(k.get(f.name) for f in schemas.PARTIAL_DATE)


def on_date(spark, fn, **k):
    df = spark.createDataFrame([(date(**k),)], T.StructType([T.StructField("d", schemas.PARTIAL_DATE)]))
    return df.select(fn(F.col("d")).alias("v")).first()["v"]


def test_keys_fold_accents_and_marks(spark):
    assert one(spark, text.excerpt_key(F.lit("Louÿs, é!"))) == one(spark, text.excerpt_key(F.lit(" Louÿs — é"))) == "louÿs é"
    assert one(spark, text.name_key(F.lit("Pierre Louÿs, O’Neill Jr."))) == "pierre louys oneill jr"
    assert one(spark, text.words(F.lit("ﬁne ½ Straße"))) == ["fine", "1", "2", "stra", "e"]
    assert one(spark, text.words(F.lit("—"))) == []


def test_unelided_runs_and_containment(spark):
    q = F.lit("one two three four five … one two three four five six ... seven")
    assert one(spark, text.unelided_runs(q)) == [["one", "two", "three", "four", "five", "six"]]
    assert one(spark, text.any_run_contained(text.unelided_runs(q), F.lit("xx bone two three four five sixty")))


def test_marked_spans_map_back_to_the_original(spark):
    full = "He said: Yes! I have no doubt we shall win -- but the road is long and cold."
    quote = "Yes: I have no doubt we shall win, but … road is long and cold"
    spans = one(spark, text.marked_spans(F.lit(full), F.lit(quote)))
    assert [full[s["start"]:s["end"]] for s in spans] == ["Yes! I have no doubt we shall win -- but", "road is long and cold"]


@pytest.mark.parametrize("quote,expected", [
    ("Did you know him?—I did. He was kind to Mr. Gray. Was he?—Yes.",
     [("Carson", "Did you know him?"), ("Smith", "I did. He was kind to Mr. Gray."), ("Carson", "Was he?"), ("Smith", "Yes.")]),
    ("Between you and Mr. Gray?—No.", [("Carson", "Between you and Mr. Gray?"), ("Smith", "No.")]),
    ("Before. MR. CLARKE: Where? WITNESS: There.", [("", "Before."), ("Mr. clarke", "Where?"), ("Witness", "There.")]),
    ("plain prose", None),
])
def test_split_transcript(spark, quote, expected):
    got = one(spark, text.split_transcript(F.lit(quote), F.lit("Lord Alfred Smith, witness"), F.lit("Mr Carson")))
    assert (got and [tuple(t) for t in got]) == expected


def test_turns_must_reproduce_the_quotation(spark):
    t = lambda *xs: F.array(*[F.struct(F.lit("a").alias("who"), F.lit(x).alias("text")) for x in xs])
    assert one(spark, text.turns_match(F.lit("CLERK: Guilty?—No, The Foreman—sir"), t("Guilty?", "No,", "sir")))
    assert not one(spark, text.turns_match(F.lit("Guilty?—No"), t("Guilty?", "Not")))


def test_language_guess(spark):
    french = "les enfants et des amis dans une maison pour elle qui est avec nous"
    assert one(spark, text.foreign_guess(F.lit(french)))["language"] == "French"
    assert one(spark, text.foreign_guess(F.lit("l’amour n’est pas d’un jour j’ai")))["hits"] == 4
    assert one(spark, text.foreign_guess(F.lit("the man of the house")))["language"] is None


@pytest.mark.parametrize("s,bad", [("_*Title*_ and **b**", False), ("a * b", True), ("~~x~~ _y", True), ("", False)])
def test_emphasis(spark, s, bad):
    assert one(spark, text.unbalanced_emphasis(F.lit(s))) is bad


def test_names_and_repositories(spark):
    assert one(spark, text.short_surname(F.lit("Sir John Gray (elder), witness"))) == "Gray"
    assert one(spark, text.short_repository(F.lit("The Morgan Library & Museum, New York"))) == "Morgan"
    assert one(spark, text.short_repository(F.lit("The Old House, Town"))) == "Old House"
    assert tuple(one(spark, text.speaker_capacity(F.lit("John Gray, letter to X"), F.lit("X")))) == ("John Gray", "")
    assert tuple(one(spark, text.speaker_capacity(F.lit("John Gray, plea"), F.lit("X")))) == ("John Gray", "plea")


def test_terms_ids_and_controls(spark):
    assert one(spark, text.term_offsets(F.lit("Aa.aA a"), "a")) == [0, 1, 3, 4, 6]
    assert one(spark, text.term_offsets(F.lit("xyz"), "a")) == []
    assert one(spark, text.is_letter_id(F.lit("w/10#1"))) and not one(spark, text.is_letter_id(F.lit("W/10")))
    assert one(spark, text.folio(F.lit("w/10#1"))) == "10" and one(spark, text.stem(F.lit("w/10#1"))) == "w/10"
    assert tuple(one(spark, text.control_character(F.lit("ab\n\x08c")))) == ("BACKSPACE", 2, 1)
    assert tuple(one(spark, text.control_character(F.lit("a\x02")))) == ("0x2", 1, 2)
    assert one(spark, text.control_character(F.lit("a\tb\r\n"))) is None
    assert [tuple(r) for r in one(spark, text.cited_page_ranges(F.lit("PDF pages 3–5; PDF page 9")))] == [(3, 5), (9, 9)]
    assert one(spark, text.has_shelfmark(F.lit("Library (MA 7258)"))) and not one(spark, text.has_shelfmark(F.lit("Library of Mars")))


@pytest.mark.parametrize("d,label,dating", [
    (dict(y=1897, m=5, d=3, circa=True, weekday="monday"), "c. 3 May 1897", "Monday circa 3 May 1897"),
    (dict(y=1897, m=5, d=3, to=(1897, 5, 6, None, None, None)), "3–6 May 1897", "3 May–6 May 1897"),
    (dict(y=1891, m=3, to=(1891, 6, None, None, None, None)), "March–June 1891", "March–June 1891"),
    (dict(y=1891, season="spring", to=(1891, 6, 2, None, None, None)), "spring – 2 June 1891", "spring–2 June 1891"),
    (dict(y=1880, part="early", bound="not-later-than"), "by early 1880", "by early 1880"),
    (dict(y=1885, bound="not-earlier-than"), "at least 1885", "at least 1885"),
    (dict(y=1880, to=(1881, None, None, None, None, None), uncertain=True), "1880 – 1881", "1880–1881 (?)"),
    (dict(weekday="tuesday"), "date unknown", "Tuesday"),
    (dict(m=6, d=3, weekday="thursday"), "date unknown", "Thursday 3 June"),
])
def test_labels(spark, d, label, dating):
    assert on_date(spark, dates.date_label, **d) == label
    assert on_date(spark, dates.dating_label, **d) == dating


def test_date_keys_and_calendar(spark):
    assert on_date(spark, dates.timeline_key, y=1900) == pytest.approx(1900 + 5.5 / 12 + 15 / 372)
    assert on_date(spark, dates.timeline_key, m=3) is None
    assert on_date(spark, dates.calendar_weekday, y=1898, m=3, d=21) == "monday"
    assert on_date(spark, dates.calendar_weekday, y=1900, m=2, d=30) is None


@pytest.mark.parametrize("s,t", [("3.50 p.m.", "15:50"), ("8 o'clock am", "08:00"), ("12.15 a.m", "00:15"), ("3.30", None), ("13.00 p.m.", None)])
def test_clock(spark, s, t):
    assert one(spark, dates.clock_time(F.lit(s))) == t


def test_raw_json_tells_null_from_absent(spark):
    raw = F.lit('{"written":null,"x":1}')
    assert one(spark, records.explicit_null(raw, "written")) and not one(spark, records.explicit_null(raw, "sent"))
    assert one(spark, records.unknown_keys(raw, ["written"])) == ["x"]
    assert one(spark, records.letter_ids(F.lit("a"), F.array(F.lit("b")))) == ["a", "b"]
    assert one(spark, records.letter_ids(F.lit(None).cast("string"), F.lit(None).cast("array<string>"))) == []


def test_geometry(spark):
    n = lambda *xs: [F.lit(float(x)) for x in xs]
    assert one(spark, geometry.segments_cross(n(0, 0), n(2, 2), n(0, 2), n(2, 0)))
    assert not one(spark, geometry.segments_cross(n(0, 0), n(1, 0), n(0, 1), n(1, 1)))
    assert one(spark, geometry.point_segment_distance(*n(3, 1, 0, 0, 2, 0))) == pytest.approx(2 ** 0.5)
    assert one(spark, geometry.point_segment_distance(*n(3, 4, 0, 0, 0, 0))) == 5


HEADS = [
    ("Monday [3 May 1897]\n\n16 Tite Street\n\nMy dear Robbie, hello", "parsed", dict(y=1897, m=5, d=3, weekday="monday", inferred=True), "tite"),
    ("[? 13] February 1895 Dear Sir, x", "parsed", dict(y=1895, m=2, d=13, uncertain=True, inferred=True), None),
    ("10 or 11 May 1897\n\nDear X", "flagged", None, None),
    ("16 Tite Street 22 August 1897 Dear Y, z", "parsed", dict(y=1897, m=8, d=22), "tite"),
    ("Late 1880-early 1881 [Paris] Dear Tom, hi", "parsed", dict(y=1880, part="late"), "paris"),
    ("19 April [1882] 3.50 p.m. Paris\n\nDear Z", "parsed", dict(y=1882, m=4, d=19, t="15:50", inferred=True), "paris"),
    ("Circa XII June 1894\n\nDear A, b", "parsed", dict(y=1894, m=6, d=12, circa=True), None),
    ("Lundi, le 24 Mai 1897\n\nCher ami, c", "parsed", dict(y=1897, m=5, d=24, weekday="monday"), None),
    ("Sunday night, 6 June [1897]\n\nNowhere Hall\n\nDear C, d", "flagged", None, None),
    ("MS Clark\n\nSummer [1893] Paris My dear E, f", "parsed", dict(y=1893, season="summer", inferred=True), "paris"),
    ("Hello there I have nothing.", "flagged", None, None),
]


def test_heading_extraction(spark):
    df = spark.createDataFrame([(i, "x", q, False) for i, (q, *_) in enumerate(HEADS)] + [(99, "x", "3 May 1897", True)],
                               "file int, addressee string, quote string, already_dated boolean")
    aliases = spark.createDataFrame([("16 Tite Street", "tite"), ("Paris", "paris")], "address string, place_id string")
    res, unmapped = headings.extract(df, aliases)
    rows = {r["file"]: r for r in res.collect()}
    for i, (q, status, parts, place) in enumerate(HEADS):
        assert rows[i]["status"] == status, q
        if parts:
            got = {k: v for k, v in rows[i]["written"]["date"].asDict().items() if v is not None and k != "to"}
            assert got == parts, q
            assert rows[i]["written_place"] == place, q
    assert rows[4]["written"]["date"]["to"]["y"] == 1881
    assert rows[0]["body"].startswith("My dear Robbie") and rows[99]["status"] == "skipped"
    assert [tuple(r) for r in unmapped.collect()] == [(8, "Nowhere Hall")]


def test_heading_postmarks_and_overrides(spark):
    df = spark.createDataFrame([
        ("a", "x", "Friday [15 October] [Postmark 16 October 1897]\n\nMy dear M, I"), ("b", "x", "[Date of receipt 2 July 1891]\n\nDear D, e"),
        ("c", "x", "Monday [Postmark Paris]\n\nDear D, e"), ("d", "x", "8 May 18951\n\nDear D, e"), ("e", "x", "Dear D, e")],
        "file string, addressee string, quote string")
    over = spark.createDataFrame([("d", "18951", "1895", None, "Robert"), ("e", None, None, "19 April [1882]", None)],
                                 "file string, fix_from string, fix_to string, prepend_heading string, addressee string")
    aliases = spark.createDataFrame([("Paris", "paris")], "address string, place_id string")
    r = {x["file"]: x for x in headings.extract(df, aliases, over)[0].collect()}
    assert (r["a"]["written"]["date"]["y"], r["a"]["postmarked"]["date"]["d"]) == (1897, 16)
    assert r["a"]["written"]["date"]["inferred"]
    assert r["b"]["received"]["date"]["m"] == 7 and r["b"]["written"] is None
    assert r["c"]["postmarked_place"] == "paris" and r["c"]["written"]["date"]["weekday"] == "monday"
    assert r["d"]["written"]["date"]["y"] == 1895 and r["d"]["addressee"] == "Robert"
    assert r["e"]["written"]["date"]["m"] == 4


def test_headings_lose_nothing(spark):
    """Whatever the form, the body is the end of the input; what cannot be read is quarantined."""
    forms = {
        "junk": "3 May 1897\n\nDear Bob, I came\n\nPrivate\n\nMore words\n\nyours\n\nBob",
        "long": "Friday\n\n[15 October 1897]\n\n[Postmark 16 October 1897]\n\n16 Tite Street\n\nI came to the house.",
        "acts": "[15 October 1897] [Postmark 16 October 1897] [Received 18 October 1897]\n\nDear Bob, I",
        "twice": "[15 October 1897] [Postmark 16 October 1897] [Postmark 17 October 1897]\n\nDear Bob, I",
        "dates": "[15 October 1897] [16 October 1897]\n\nDear Bob, I",
        "aside": "3 May 1897 (Postcard No. 2) Paris\n\nDear Bob, I",
        "number": "LETTER NO. 4\n\nPrivate\n\n3 May 1897 Paris\n\nDear Bob, I",
        "french": "Lundi 3 mai 1897 Paris\n\nCher Bob, je",
        "place then body": "3 May 1897\n\n16 Tite Street\n\nShort words\n\nmore",
        "roman": "III May 1897 Paris\n\nDear Bob, I",
    }
    df = spark.createDataFrame([(k, "x", q) for k, q in forms.items()], "file string, addressee string, quote string")
    aliases = spark.createDataFrame([("16 Tite Street", "tite"), ("Paris", "paris")], "address string, place_id string")
    r = {x["file"]: x for x in headings.extract(df, aliases)[0].collect()}
    for k, q in forms.items():
        assert q.endswith(r[k]["body"]) and r[k]["body"], k
    assert r["junk"]["body"] == "Dear Bob, I came\n\nPrivate\n\nMore words\n\nyours\n\nBob"
    assert (r["long"]["status"], r["long"]["written_place"], r["long"]["postmarked"]["date"]["d"], r["long"]["body"]) == ("parsed", "tite", 16, "I came to the house.")
    assert (r["acts"]["status"], r["acts"]["postmarked"]["date"]["d"], r["acts"]["received"]["date"]["d"], r["acts"]["written"]["date"]["d"]) == ("parsed", 16, 18, 15)
    assert (r["twice"]["reason"], r["dates"]["reason"]) == ("several brackets of one act", "several date brackets")
    for k in ("aside", "number", "french", "roman"):
        assert (r[k]["status"], r[k]["written_place"], r[k]["written"]["date"]["d"], r[k]["written"]["date"]["m"]) == ("parsed", "paris", 3, 5), k
    assert (r["place then body"]["written_place"], r["place then body"]["body"]) == ("tite", "Short words\n\nmore")
