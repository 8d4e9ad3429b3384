"""Contexts longer than two symbols in the PPM score."""

import collections
import math
import zlib

import numpy as np
import pytest

from sourceweave.llm import ppm
from tests.llm.test_operators import by_id, corpus, docs, rows, small  # noqa: F401


def _brute(texts, order):
    """Score of a byte string under the definition, by dictionaries."""
    ctx = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in texts:
        s = (*[256] * order, *t, 256)
        for k in range(order, len(s)):
            for n in range(order + 1):
                ctx[n][s[k - n : k]][s[k]] += 1

    def prob(before, x):
        out, gone = 1.0, set()
        for n in range(order, -1, -1):
            c = ctx[n].get(before[order - n :], {})
            left = {s: m for s, m in c.items() if s not in gone}
            if left:
                whole = sum(left.values()) + len(left)
                if x in left:
                    return out * left[x] / whole
                out *= len(left) / whole
            gone |= set(c)
        return out / (257 - len(gone))

    def score(t):
        s = (*[256] * order, *t, 256)
        return sum(math.log10(prob(s[k - order : k], s[k])) for k in range(order, len(s)))

    return score


@pytest.mark.parametrize("order,grams", [(3, 10**6), (5, 40), (6, 0)])
def test_orders(docs, rows, order, grams):  # noqa: F811
    train = [small(t).encode() for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 10]
    score, got = _brute(train, order), by_id(ppm.scores(docs, order=order, table_grams=grams))
    for i, text, *_ in rows:
        b = small(text).encode()
        if len(b) < 600:
            assert got[i].score == pytest.approx(score(b), rel=1e-4), i


def test_tasks_cut_between_contexts():
    """Grams that come in many batches get the probabilities that all at once get."""
    import pyarrow as pa

    order = 5
    data = np.random.default_rng(3).integers(97, 105, 600_000).astype(np.uint8)
    codes, n = np.unique(ppm._symbols(data, np.array([0, len(data)]), order)[0], return_counts=True)
    assert len(codes) > 200_000
    cells = codes // ppm.SYMBOLS ** (order - 1) * ppm.SYMBOLS + codes % ppm.SYMBOLS
    cell, back = np.unique(cells, return_inverse=True)
    low = ppm._Low(cell, np.bincount(back, weights=n).astype(np.int64))
    sent = type("Sent", (), {"value": low})
    batches = [pa.RecordBatch.from_arrays([pa.array(codes[a : a + 10_000]), pa.array(n[a : a + 10_000]), pa.array(n[a : a + 10_000])], names=["key", "n", "met"])
               for a in range(0, len(codes), 10_000)]
    out = list(ppm._model(sent, order)(iter(batches)))
    assert len(out) > 1
    assert np.array_equal(np.concatenate([b.column("key").to_numpy() for b in out]), codes)
    assert np.allclose(np.concatenate([b.column("logp").to_numpy() for b in out]), ppm.log_grams(codes, n, low, order), rtol=1e-6)


def test_longer_contexts_tell(spark):
    """Texts of trained phrases are likelier than texts of the same trigrams in another order."""
    from sourceweave.llm import queries

    # every trigram of the second kind stands in the training texts, but never in this order
    a, b = "abxcd abyef ", "abxcf abyed "
    learned = [(i, a * 20 + "cf ed xcf yed ") for i in range(200) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(1000, 1400) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    df = spark.createDataFrame([*learned, (held[0], "abyef "), (held[1], "abxcf ")], "doc_id long, text string")
    asked, queries.read = queries.read, lambda *_: df
    try:
        got = by_id(queries.op10(spark, ""))
    finally:
        queries.read = asked
    two, five = by_id(ppm.scores(df)), by_id(ppm.scores(df, order=5))
    gap = lambda s: s[held[0]].score - s[held[1]].score
    assert gap(got) == pytest.approx(gap(five)) and gap(got) > gap(two) + 0.5
