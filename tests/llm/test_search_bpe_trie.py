"""Dual-tree search, prefix BPE and the conversation trie against brute force, with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from sourceweave.llm import dual_tree, prefix_bpe, prefix_trie

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n long, terms string, rank string, ids string, last string, bytes string"


def small(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def texts():
    rng = random.Random(11)
    word = lambda: rng.choice(["red", "Blue", "über", "sky", "日本", "of", "the", "a1", "sea"]) + str(int(rng.paretovariate(0.7)) % 90)
    out = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return out + out[:20] + [None, "", " \n ", "the the the", "é" * 900, " ".join(word() for _ in range(20000)), "x" * 30000, "a\x00b � don't  I'LL\n\n end  "]


def brute_ranking(docs, items, k):
    sets = [(i, Counter(TERM.findall(small(t)))) for i, t in docs]
    sets = [(i, c) for i, c in sets if c]
    total, length = len(sets), sum(sum(c.values()) for _, c in sets)
    df = Counter(t for _, c in sets for t in c)
    out = []
    for item, text in items:
        ask = Counter(TERM.findall(small(text)))
        scored = []
        for i, c in sets:
            m = 75 + 25 * sum(c.values()) * total // length
            s = sum(n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in ask.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def ranked_rows():
    t = texts()
    docs = [(None if i == 5 else i % 170, x) for i, x in enumerate(t)]
    items = [(1, t[0]), (1, t[3]), (None, t[7]), (4, "the the nowhere sea1"), (5, ""), (6, None), (7, t[175])] + [(10 + i, t[i] + " " + t[i + 1]) for i in range(20)]
    return docs, items


@pytest.mark.parametrize("blocks", [None, 5])
def test_search_equals_brute_force(spark, monkeypatch, ranked_rows, blocks):
    docs, items = ranked_rows
    if blocks:  # several blocks of items, and batches smaller than a task's rows
        monkeypatch.setattr(dual_tree, "BLOCK_ITEMS", blocks)
        monkeypatch.setattr(dual_tree, "CELLS", 1 << 13)
    d = spark.createDataFrame([(i, x, *[None] * 6) for i, x in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, x, 0) for i, x in items], "item_id long, text string, score long")
    got = sorted((tuple(r) for r in dual_tree.ranked(d, b, k=7, seed_share=4).collect()), key=str)
    assert got == brute_ranking(docs, items, 7)
    none = dual_tree.ranked(d.limit(0), b)
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0 and dual_tree.ranked(d, b.limit(0)).count() == 0


def test_search_prunes_whole_nodes():
    rng = np.random.default_rng(1)
    n, width = 2048, 400
    topic = np.sort(rng.integers(0, 20, n))
    rows = [np.unique(np.concatenate([t * 20 + rng.integers(0, 20, 6), rng.integers(0, width, 2)])) for t in topic]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    cols = np.concatenate(rows)
    own = cols // 20 == np.repeat(topic, np.diff(first))
    vals = np.where(own, rng.integers(500, 1000, len(cols)), rng.integers(1, 50, len(cols)))
    items = dual_tree.Items([{int(t): 1 for t in range(k * 20, k * 20 + 12)} for k in range(20)], rng.integers(1, 9, width))
    best = dual_tree.Best(20, 5, np.zeros(20, np.int64))
    ids = np.arange(n)
    scored = dual_tree.search(items, best, first, cols, vals, ids)
    dense = np.zeros((n, width), np.int64)
    dense[np.repeat(ids, np.diff(first)), cols] = vals
    for i, s in enumerate(items.query @ dense.T):
        want = np.lexsort((ids, -s))[:5]
        assert best.rows[i][1].tolist() == want.tolist() and best.rows[i][0].tolist() == s[want].tolist()
    assert scored < 20 * n / 4
    # every node's maxima bound its rows
    tree = dual_tree.Hierarchy(first, cols, width, 32)
    top = tree.maxima(first, cols, vals, width)
    assert all((top[k] == dense[tree.order[a:b]].max(0)).all() for k, (a, b) in enumerate(zip(tree.lo, tree.hi)))


@pytest.fixture(scope="module")
def tokens():
    v = prefix_bpe.vocabulary()
    return tiktoken.Encoding("own", pat_str=prefix_bpe.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def test_bpe_equals_the_library(spark, tokens):
    rows = [(i, t, *[None] * 6) for i, t in enumerate(texts())] + [(3, "twice", *[None] * 6), (None, "no id", *[None] * 6)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    want = sorted((r[0] if r[0] is not None else -1, tokens.encode_ordinary(r[1] or "")) for r in rows)
    coded = prefix_bpe.encode(df, carry=("doc_id", "text", "ids"))
    assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in coded.collect()) == want
    back = prefix_bpe.decode(coded, carry=("doc_id", "text", "bytes")).collect()
    assert len(back) == len(rows) and all(bytes(r.bytes).decode() == (r.text or "") for r in back)
    got = {r.doc_id: r for r in prefix_bpe.digests(df.where("doc_id > 3")).collect()}
    for i, t, *_ in rows[4:-2]:
        ids = tokens.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    odd = spark.createDataFrame([(1, [1, 99999999, None, -4]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.bytes) for r in prefix_bpe.decode(odd).collect()} == {1: prefix_bpe.vocabulary().raw[1], 2: b""}
    assert prefix_bpe.digests(df.limit(0)).count() == 0


def test_bpe_round_trip_needs_one_worker(spark, tokens):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    both = {r.doc_id: r for r in prefix_bpe.round_trip(df, into="back").collect()}
    for k, t in enumerate(texts()):
        assert list(both[k].ids) == tokens.encode_ordinary(t or "") and bytes(both[k].back) == (t or "").encode()
    plan = prefix_bpe.digests(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_bpe_edits_compute_what_is_near(spark, tokens):
    rng = random.Random(3)
    chars = "ab aA1 'srete\n\t 中日é😀ö.,-—"
    rows = [(k, "".join(rng.choice(chars) for _ in range(rng.randint(0, 60))), rng.choice([0, 5, 30, 99, -1, None]), rng.choice([0, 1, 9, None]), rng.choice(["", "x", "é 1", None]))
            for k in range(200)]
    rows += [(900, None, 3, 1, "new"), (901, "".join(rng.choice("abcdefgh") for _ in range(20000)), 9000, 2, "yz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, at long, cut long, insert string")
    kept = prefix_bpe.encode(df, carry=("doc_id", "text", "at", "cut", "insert"), keep_table=True)
    for i in range(2):  # an edit of an edit
        kept = prefix_bpe.edit(kept, carry=("doc_id", "at", "cut", "insert"))
    got = {r.doc_id: r for r in kept.collect()}
    cut, v = regex.compile(prefix_bpe.PATTERN), prefix_bpe.vocabulary()
    for k, text, at, n, insert in rows:
        s = text or ""
        for _ in range(2):
            a = len(s) if at is None else min(max(at, 0), len(s))
            s = s[:a] + (insert or "") + s[a + (n or 0) :]
        assert got[k].text == s and list(got[k].ids) == tokens.encode_ordinary(s)
        assert list(got[k].last) == prefix_bpe.encode_table(s.encode(), v, cut)
    assert got[901].n_computed < 200  # of 20,000 entries of one match


def test_bpe_prefixes_have_one_last_token(tokens):
    v, data = prefix_bpe.vocabulary(), " unbelievableness".encode()
    table = v.table(data)
    assert [v.spell(table[:n]) for n in range(1, len(data) + 1)] == [tokens._encode_single_piece(data[:n]) for n in range(1, len(data) + 1)]
    with pytest.raises(ValueError):
        prefix_bpe.Vocabulary({b"a": 0, b"b": 1, b"abb": 2})


def brute_trie(rows):
    conv = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            r, x = role or "", text or ""
            conv.setdefault(c, []).append((turn is not None, turn or 0, r, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16], x))
    said = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in conv.items()}
    built = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = said.get(c - int(math.fmod(c, 100)), [])[:h] + said[c][h:]
    nodes, kids = {}, {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    below = {}
    for k in sorted(nodes, key=len, reverse=True):
        sub = [below[x] for x in kids.get(k, [])]
        below[k] = sum(x[0] for x in sub) or 1, sum(x[1] for x in sub) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0)
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), *below[k],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))).encode()).hexdigest()) for k, m in nodes.items()), key=str)


@pytest.mark.parametrize("size", [8, 3])
def test_trie_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    rng = random.Random(size)
    rows = []
    for c in [*range(30), 100, 101, 102, 205, -3, -99, -100, -104, 333, 777]:
        n = 60 if c == 777 else rng.choice([1, 1, 2, 3, 5, 9, 17, 30 if c % 100 == 0 else 4])
        rows += [(c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, "é😀", "long " * 900])) for t in range(n)]
    rows += [(c, t, "user", "same") for c in (300, 301, 302) for t in range(40)]  # copies over several blocks
    rows += [(None, 1, "user", "x")] + [(333, 1, "user", "dup")] * 5
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, id string").repartition(5)
    got = prefix_trie.rebuilt_trie(df, size)
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)
    assert prefix_trie.rebuilt_trie(df.limit(0), size).count() == 0


def test_running_sums_cross_ranges(spark):
    rows = [(7, i, i % 5) for i in range(3000)] + [(k, 1, 2) for k in range(100)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(6)
    got = {(r.k, r.i): r.total for r in prefix_trie.running(df.where("k = 7 AND i <> 1 OR k <> 7"), "k", [F.col("i")], F.col("v"), "total", "running").collect()}
    assert got[(7, 2999)] == sum(i % 5 for i in range(3000)) - 1 and got[(3, 1)] == 2
