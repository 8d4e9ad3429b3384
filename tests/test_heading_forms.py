"""Headings with two readings, openings an edition prints, and a sender's line."""

import pytest

from sourceweave.operators import headings

FORMS = [  # text, status, reason, (year, month, day)
    ("May-June 1897 Paris", "flagged", "ambiguous range or alternative", None),
    ("May – June 1897\n\nParis", "flagged", "ambiguous range or alternative", None),
    ("3 May 1897 [4 May 1897]\n\nParis", "flagged", "a date and a bracket that differ", None),
    ("Monday 3 May 1897 [Tuesday]\n\nParis", "flagged", "a date and a bracket that differ", None),
    ("3 May 1897 [3 May 1897]\n\nParis", "parsed", None, (1897, 5, 3)),
    ("18 March [1896] Paris", "parsed", None, (1896, 3, 18)),
    ("LETTER NO. 4 3 May 1897 Paris", "parsed", None, (1897, 5, 3)),
    ("LETTER NO. 12 Strictly Private 3 May 1897 Paris", "parsed", None, (1897, 5, 3)),
    ("de la part de M. Untel\n\n3 May 1897 Paris", "parsed", None, (1897, 5, 3)),
    ("3 May [1897] [Postmark 4 May 1897] [Received 5 May 1897]\n\nParis", "parsed", None, (1897, 5, 3)),
    ("", "flagged", "no heading", None),
]


@pytest.fixture(scope="module")
def told(spark):
    rows = [(i, "x", f"{t}\n\nMy dear Bob, the body.") for i, (t, *_) in enumerate(FORMS)] + [(99, "x", None)]
    aliases = spark.createDataFrame([("Paris", "paris")], "address string, place_id string")
    done, _ = headings.extract(spark.createDataFrame(rows, "file long, addressee string, quote string"), aliases)
    return {r.file: r for r in done.collect()}


@pytest.mark.parametrize("i", range(len(FORMS)))
def test_forms(told, i):
    text, status, reason, date = FORMS[i]
    r = told[i]
    assert (r.status, r.reason) == (status, reason), text
    assert r.body == "My dear Bob, the body."
    if date:
        w = r.written["date"]
        assert (w["y"], w["m"], w["d"]) == date and r.written_place == "paris"


def test_null_heading(told):
    assert told[99].status == "flagged" and told[99].body == ""
