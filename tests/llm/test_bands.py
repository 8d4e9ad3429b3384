"""Fertility bands measured on the documents reject junk that passes the base rule."""

import base64
import random

import pytest

from sourceweave.llm import fertility


def prose(rng, n):
    return " ".join(rng.choice(["the", "river", "was", "quiet", "and", "green", "meadows", "under", "a", "pale", "morning", "sky", "people", "walked", "slowly", "home",
                                "with", "baskets", "of", "apples", "while", "children", "played", "near", "old", "stone", "bridges"]) for _ in range(n)) + "."


def junk(rng):
    letters = "bcdfghjklmnpqrstvwxz"
    return {
        "base64": " ".join(base64.b64encode(rng.randbytes(24)).decode() for _ in range(20)),
        "hex": " ".join(rng.randbytes(12).hex() for _ in range(20)),
        "random letters": " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(40)),
        "consonants": " ".join("".join(rng.choice(letters) for _ in range(7)) for _ in range(40)),
        "punctuation": " ".join("".join(rng.choice("!#$%&*()|<>?;") for _ in range(6)) for _ in range(40)),
    }


@pytest.mark.parametrize("lang", ["en", "xx", None])
def test_measured_bands(spark, lang):
    rng = random.Random(3)
    clean = [prose(rng, rng.choice([40, 80, 160])) for _ in range(200)]
    words = prose(rng, 120).split()
    bad = junk(rng) | {"signs on words": " ".join(w + rng.choice(["***", "$$$", "%%%", "&&&"]) for w in words), "table": " | ".join(a + b for a, b in zip(words, words[::-1]))}
    texts = [*clean, *bad.values()]
    docs = spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    bands = fertility.spread_bands(docs)
    rows = {r.doc_id: r for r in fertility.quality(docs, bands=bands).collect()}
    assert not any(r.base_failed for r in rows.values())
    # a text without language and letters has no group to be measured in
    assert [name for name, i in zip(bad, range(200, 207)) if rows[i].kept] == ([] if lang else ["punctuation"])
    assert sum(rows[i].kept for i in range(200)) >= 195


def test_constants_reject_encoded_text(spark):
    """Too few documents to measure: the constant bands stand."""
    rng = random.Random(4)
    texts = [prose(rng, 40), *junk(rng).values()]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert fertility.spread_bands(docs) == {}
    rows = {r.doc_id: r for r in fertility.quality(docs).collect()}
    assert not any(r.base_failed for r in rows.values()) and [i for i, r in rows.items() if r.kept] == [0]
