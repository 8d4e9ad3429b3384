import json

import pytest

from sourceweave.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def write_json(path, obj):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(obj if isinstance(obj, str) else json.dumps(obj, ensure_ascii=False), encoding="utf-8")


SOURCE = dict(work="w1", locator="p. 1", quote="Plain words here", verified=True, verified_with="in-hand", document="biography",
              voice="modern", citation_provenance="read at the page")


@pytest.fixture(scope="session")
def tree(tmp_path_factory):
    """A small record tree on disk with good and bad records."""
    root = tmp_path_factory.mktemp("corpus")
    person = lambda i, **k: dict(id=i, name=i.title() + " Smith", group="core", gender="f", **k)
    write_json(root / "people/ann.json", person("ann", sexuality_sources=[
        {"subject": "Bea Smith", "sources": [SOURCE, dict(SOURCE, quote="")]}, {"name": "x", "sources": []}]))
    write_json(root / "people/bea.json", person("bea", born={"date": {"y": 1850}, "place": "paris"}))
    write_json(root / "people/cid.json", dict(id="cid", name="", group="crew", gender="q", died={"time": "  "}))
    write_json(root / "people/bad.json", "{not json")
    rel = lambda a, b, **k: dict(id=f"{a}--{b}", people=[a, b], certainty="married", certainty_status="confirmed", sources=[SOURCE]) | k
    write_json(root / "rels/ann--bea.json", rel("ann", "bea"))
    write_json(root / "rels/bea--ann.json", rel("bea", "ann", sources=[]))
    write_json(root / "rels/ann--zed.json", rel("ann", "zed", certainty="attraction-expressed", places=["paris", "paris", "nowhere"]))
    write_json(root / "rels/cid--dan.json", rel("cid", "dan", certainty="uncorroborated", outcome="declined", date_label="1890-1900",
                                              start={"date": {"y": 1901, "circa": True}}, end={"date": {"y": 1900}},
                                              phases=[{"start": {"date": {"y": 1890, "season": "fall"}}}]))
    write_json(root / "works.json", {"w1": {"author": "Bea Smith", "title": "A Life", "kind": "secondary", "publisher": "P"}, "w2": {"kind": "odd"}})
    write_json(root / "places.json", {"paris": {"city": "Paris"}, "Bad Id": {"city": " Rome", "zip": "1"}, "none": {}})
    write_json(root / "manuscripts/hrc/MANIFEST.json", {
        "collection": "Papers", "archive": {"name": "The Ransom", "iiif_url": "https://i/{pointer}/{page}"},
        "items": [{"itemId": "27", "title": "Letters", "boxFolder": "1.1",
                   "pages": [{"page": 1, "pointer": "a b", "rights": "http://rightsstatements.org/vocab/InC/1.0/"}, {"page": 2, "pointer": ""}],
                   "matches": [{"letter_id": "w/10#1", "pages": [1, 2], "what": "Photostat"}, {"letter_id": "Bad Id", "pages": []}, {"person": "Ann"}]}]})
    write_json(root / "manuscripts/loc/MANIFEST.json", {"items": []})
    letter = dict(letter_id="w/10#1", transcribed_from="facsimile", quote="My dear Ann, one two three four five six seven eight nine ten",
                  sender="Ann Smith", addressee="Smith", written={"date": {"y": 1890}}, facsimile={"archive": "hrc", "item": "27", "pages": [1]})
    write_json(root / "manuscripts/hrc/transcriptions/hrc-27-001.json", letter)
    write_json(root / "manuscripts/hrc/transcriptions/wrong-name.json", dict(letter, letter_id="w/11#1", written=None))
    pr = {k: v for k, v in letter.items() if k != "facsimile"} | dict(transcribed_from="printed")
    write_json(root / "transcriptions/ed/1.json", pr)
    write_json(root / "transcriptions/ed/2.json", pr)
    write_json(root / "transcriptions/ed/3.json", {k: v for k, v in pr.items() if k != "written"} | dict(letter_id="w/12#1", printed={"locator": "p. 13"}, verified_marks=True))
    write_json(root / "transcriptions/ed/4.json", dict(pr, letter_id="nope"))
    (root / "note.md").write_bytes(b"fine\nbad \x08 here\n")
    return root
