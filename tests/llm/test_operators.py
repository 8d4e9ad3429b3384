"""The training-data operators against brute force on small tables with nulls, copies, ties, long texts and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from sourceweave.llm import (common, components, feistel, fertility, hash_tree, license_scan, piece_lattice, ppm, reply_trees, suffix_repeats, superminhash,
                             wu_manber)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, row string, ids string, node string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def small(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def sentence(rng, n):
    return " ".join(rng.choice(["red", "Blue", "über", "sky", "日本", "of", "the", "a1", "sea", "x-ray"]) + str(rng.randint(0, 30)) for _ in range(n))


def corpus():
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(30, 90)) for _ in range(25)]
    texts = [None, "", "   \n\t ", "one two", "one two", "ONE two", "the mit\nlicense", *base, *base[:6]]
    words = base[0].split()
    for i in range(6):  # near copies with one or three edits
        w = words.copy()
        for k in range(1 + 2 * (i % 2)):
            w[(7 * i + 20 * k) % len(w)] = f"edit{i}{k}"
        texts.append(" ".join(w))
    passage = sentence(rng, 60)
    texts += [f"{sentence(rng, 20)} {passage} {sentence(rng, 20)}" for _ in range(6)]
    texts += ["same line here\nsame line here\nother\nsame line here", "ab" * 700, "word " * 400, sentence(rng, 4000), "é" * 50 + "\x00▁ a  b",
              "Released under the MIT License. Licensed under the Apache License, Version 2.0, and the GNU General Public License",
              "call +1 (202) 555-0143 or mail bob.1@mail7.example.com, card 4111111111111111, born 29.02.2000, not 31.02.2001"]
    return [(i, t, "en" if i % 3 else None, "s", len(t or ""), "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Null ids, equal ids and equal rows."""
    extra = [(None, rows[8][1]), (None, None), (3, "another text of id three"), (8, rows[8][1]), (8, rows[8][1])]
    return spark.createDataFrame(rows[:12] + [(i, t, *[None] * 9) for i, t in extra], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_licenses(docs, rows, empty, odd):
    got = by_id(license_scan.report(docs))
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for i, text, *_ in rows:
        w = ALNUM.findall(small(text))
        at = [(k, label) for label, p in phrases.items() for k in range(len(w)) if w[k : k + len(p)] == p]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert license_scan.report(empty).count() == 0 and license_scan.report(odd).count() == odd.count()


def test_license_blocks_are_all_blocks(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(40)]
    notices = [license_scan.Template(f"t{k}", " ".join(rng.sample(vocab, rng.randint(3, 9))), rng.choice([0.5, 0.7, 0.8, 1.0])) for k in range(12)]
    texts = [" ".join(rng.choice(vocab[: rng.choice([10, 40])]) for _ in range(rng.randint(0, 200))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: sorted((b.label, b.block) for b in r.blocks) for r in license_scan.scan(df, phrases=[], notices=notices, stride=8).collect()}
    for i, text in enumerate(texts):
        w = text.split()
        want = []
        for k in range(0, len(w), 8):
            for t in notices:
                own = set(t.text.split())
                if len(own & set(w[k : k + 16])) >= math.ceil(t.threshold * len(own) - 1e-9):
                    want.append((t.label, k // 8))
        assert got[i] == sorted(want)


def shingles(text):
    w = WORD.findall(small(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(sets, percent):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in sets}


def test_near_duplicates(docs, rows, empty, odd):
    got = by_id(superminhash.near_duplicates(docs))
    want = brute_components({i: shingles(t) for i, t, *_ in rows}, 85)
    for i, text, *_ in rows:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(shingles(text)), want[i], want[i] == i), i
    assert superminhash.near_duplicates(empty).count() == 0
    found = superminhash.near_duplicates(odd).collect()
    assert len(found) == odd.count() and all(r.component_id == 8 for r in found if r.doc_id == 8)
    kept = superminhash.deduplicated(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()].count(8) == 1


def test_near_duplicates_of_a_star(spark):
    """Copies that agree with a common base only: many components meet in one bucket."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    texts = []
    for i in range(120):
        w = base.copy()
        for k in rng.sample(range(120), rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            w[k] = f"new{i}x{k}" if rng.random() < 0.7 else f"alt{k}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = by_id(superminhash.near_duplicates(df))
    want = brute_components({i: shingles(t) for i, t in enumerate(texts)}, 85)
    assert {i: r.component_id for i, r in got.items()} == want and len(set(want.values())) > 10


def test_superminhash_estimates():
    """Signatures are those of the definition, one element at a time, and estimate the similarity."""
    rng = np.random.default_rng(1)
    el = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    first = np.array([0, 3, 3, 40, 700, len(el)])
    m = 64
    got = superminhash.signatures(el, first, m)
    for d in (0, 2, 3):
        h = [np.inf] * m
        for x in el[first[d] : first[d + 1]]:
            p = list(range(m))
            for j in range(m):
                rank, k = superminhash._level(np.array([x]), j, m)
                p[j], p[k[0]] = p[k[0]], p[j]
                h[p[j]] = min(h[p[j]], int(rank[0]) + (j << 32))
        assert got[d].tolist() == h
    a, b = el[:600], el[100:700]
    sig = superminhash.signatures(np.concatenate([a, b]), np.array([0, 600, 1200]), 252)
    assert abs((sig[0] == sig[1]).mean() - 500 / 700) < 0.1


def test_prefix_join_is_exact(spark):
    rng = random.Random(4)
    pool = list(range(1, 400))
    sets = [np.unique(common.mix(np.array(rng.sample(pool[: rng.choice([60, 400])], rng.randint(5, 50)), np.uint64))) for _ in range(150)]
    for i in range(60):
        s = list(sets[i])
        sets.append(np.unique(np.array(s[: len(s) - rng.randint(0, 4)], np.uint64)))
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, elements binary")
    held = spark.createDataFrame([(i, i) for i in range(len(sets))], "node long, comp long")
    pairs = {(r.a, r.b) for r in superminhash._verified(superminhash._rest(held, df, 85), df, 85).collect()}
    want = set()
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                want.add((a, b))
    assert pairs == want and want


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(80)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(docs, rows, empty, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=fertility.VOCABULARY)
    got = by_id(fertility.quality(docs))
    for i, text, lang, *_ in rows:
        text, r = text or "", got[i]
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        ids = [x for word in w for x in sp.encode(word)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_tokens) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(ids)), i
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        low, high, byte, entropy = fertility.BANDS[lang or fertility.script_of(text)]
        kept = not failed
        if ids:
            n = len(ids)
            e = -sum(c / n * math.log2(c / n) for c in collections.Counter(ids).values())
            share = sum(sp.is_byte(x) for x in ids) / n
            assert (r.chars_per_token, r.byte_share, r.token_entropy) == pytest.approx((sum(map(len, w)) / n, share, abs(e)))
            kept = kept and low <= sum(map(len, w)) / n <= high and share <= byte and e >= entropy
        assert (r.base_failed, r.kept) == (failed, kept)
    assert fertility.quality(empty).count() == 0 and fertility.quality(odd).count() == odd.count()
    assert fertility.script_of("Привет, мир") == "cyrillic" and fertility.script_of("日本語 text") == "latin" and fertility.script_of("12 !") == "other"


def test_reply_trees(spark):
    """Random trees: the best path by score, ties to the lesser leaf, round trip of hostile texts."""
    rng = random.Random(7)
    nodes, texts = [], []
    hostile = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "<\\|im_end|>", "[\\\\INST] \\", "", None, "plain\ntext ▁ 日本"]
    for t in range(12):
        for i in range(rng.randint(1, 40)):
            nodes.append((t, i, rng.randint(max(0, i - 3), i - 1) if i else None, float(rng.randint(0, 2))))
            texts.append((t, i, rng.choice(["user", "assistant", "system", "a\nb\\n", None]), rng.choice(hostile)))
    nodes.append((99, 5, 77, 1.0))  # its parent is missing: it starts a path
    texts.append((99, 5, "user", "alone"))
    nodes += [(98, 1, 2, 0.0), (98, 2, 1, 0.0)]  # a cycle has no root
    tree = spark.createDataFrame(nodes, "tree long, id long, parent long, score double")
    message = spark.createDataFrame(texts, "tree long, id long, role string, text string")
    chosen = reply_trees.paths(tree, per_tree=2)
    got = collections.defaultdict(list)
    for r in chosen.collect():
        got[(r.tree, r["rank"])].append((r.step, r.id))
    info = {(t, i): (p, s) for t, i, p, s in nodes if t != 98}
    said = {(t, i): (r or "", x or "") for t, i, r, x in texts}
    want = {}
    for t in {t for t, _ in info}:
        inner = {p for (u, _), (p, _) in info.items() if u == t}
        found = []
        for leaf in [i for (u, i) in info if u == t and i not in inner]:
            path, at = [], leaf
            while at is not None and (t, at) in info:
                path.append(at)
                at = info[(t, at)][0]
            found.append((-sum(info[(t, x)][1] for x in path), leaf, path[::-1]))
        for k, (_, _, path) in enumerate(sorted(found)[:2]):
            want[(t, k + 1)] = path
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == want
    assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in got.values())
    made = reply_trees.format_paths(chosen, message)
    for r in made.collect():
        turns = [said[(r.tree, i)] for i in want[(r.tree, r["rank"])]]
        assert reply_trees.parse(r.formatted) == turns
        assert "".join(reply_trees.unescape(r.formatted[s.start : s.start + s.chars]) for s in r.loss_spans) == "".join(x for role, x in turns if role == "assistant")
        assert r.formatted.count(reply_trees.END) == len(turns) and "</s>" not in r.formatted and "[INST]" not in r.formatted
    read = {(r.tree, r["rank"]): r for r in reply_trees.digests(made, ("tree", "rank")).collect()}
    for k, path in want.items():
        turns = [said[(k[0], i)] for i in path]
        assert read[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest() and read[k].n_turns == len(turns)


def test_linear_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "user", None), (2, None, None, "x")] + [(3, i, "user", str(i)) for i in range(70)]
    table = reply_trees.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    made = reply_trees.format_paths(reply_trees.paths(table), table).collect()
    got = {r.tree.conv_id: reply_trees.parse(r.formatted) for r in made}
    assert got == {1: [("user", "a"), ("assistant", "b"), ("assistant", "b")], None: [("user", "")], 2: [("", "x")], 3: [("user", str(i)) for i in range(70)]}
    none = reply_trees.linear(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert reply_trees.format_paths(reply_trees.paths(none), none).count() == 0


def test_piece_lattice(docs, rows, empty, odd):
    pieces, raw, byte, low = piece_lattice.vocabulary()
    table = {p: (i, s) for p, i, s in pieces}

    def best(unit):
        way = [(0.0, [])]
        for e in range(1, len(unit) + 1):
            top = None
            for s in range(max(0, e - 16), e):
                p = unit[s:e]
                if p in table:
                    new = (way[s][0] + table[p][1], way[s][1] + [table[p][0]])
                elif e - s == 1:
                    new = (way[s][0] + low * len(p.encode()), way[s][1] + [byte[x] for x in p.encode()])
                else:
                    continue
                if top is None or new[0] > top[0]:
                    top = new
            way.append(top)
        return way[-1][1]

    _, known = piece_lattice.unit_table(docs)
    for r in known.collect():
        assert r.ids == best(r.unit), r.unit
    whole = by_id(piece_lattice.measured(docs))
    assert all(r.round_trip for r in whole.values()) and whole[0].ids is None and whole[1].ids == []
    joined = by_id(piece_lattice.measured(docs, table_units=50))
    assert all(joined[i].ids == whole[i].ids for i in whole)
    assert piece_lattice.measured(empty).count() == 0
    assert [r.round_trip for r in piece_lattice.measured(odd, table_units=10).collect()] == [True] * odd.count()


def test_piece_lattice_keeps_one_way_back_per_place(spark):
    """Equal sums go to the longer last piece, characters without a piece become bytes, and no edge is a row."""
    pieces = [("a", 0, -1.0), ("b", 1, -1.0), ("ab", 2, -2.0), ("ba", 3, -1.5), ("éa", 4, -1.0), ("aab", 5, -3.0)]
    byte = [*range(100, 356)]
    units = ["ab", "aba", "aab", "bé", "éab", "xa", "日", "b" * 70]
    want = [[2], [0, 3], [5], [1, 100 + 0xC3, 100 + 0xA9], [4, 1], [100 + 120, 0], [100 + x for x in "日".encode()], [1] * 70]
    words = spark.createDataFrame([(u,) for u in units], "unit string").repartition(2)
    made = piece_lattice.lattice(words, pieces, byte, -20.0)
    got = {r.unit: r.ids for r in made.collect()}
    assert [got[u] for u in units] == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


@pytest.mark.parametrize("window,block", [(13, 10**6), (4, 20)])
def test_wu_manber(spark, docs, rows, empty, odd, window, block):
    rng = random.Random(8)
    long = [t for _, t, *_ in rows if t and len(t.split()) > 30]
    items = [(i, " ".join(x.split()[5 : 5 + n])) for i, (x, n) in enumerate(zip(long, [1, 2, 3, 12, 13, 14, 40, 20, 5, 13]))]
    items += [(90, None), (91, ""), (92, "word word word"), (93, "nowhere to be found " * 4), (5, long[3][:200]), (None, long[2])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(wu_manber.contamination(docs, bench, window=window, block_words=block))
    windows = collections.defaultdict(set)
    for i, text in items:
        w = ALNUM.findall(small(text))
        if w:
            for k in range(max(1, len(w) - window + 1)):
                windows[tuple(w[k : k + window])].add(i)
    for i, text, *_ in rows:
        w, hit, names = ALNUM.findall(small(text)), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                g = tuple(w[k : k + n])
                if len(g) == n and g in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[g]
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(names)), i
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(str(x) for x in names if x is not None)).encode()).hexdigest() and r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert wu_manber.contamination(empty, bench).count() == 0
    none = wu_manber.contamination(odd, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == odd.count() and not any(r.contaminated for r in none)


def test_feistel(docs, rows, empty, odd):
    for size in (2, 3, 10, 97, 1000):
        got = [feistel.permute(x, size, b"k", b"t") for x in range(size)]
        assert sorted(got) == list(range(size)) and [feistel.permute(x, size, b"k", b"t", True) for x in got] == list(range(size))
    for text in ["bob.12@mail7.example.com", "4111 1111 1111 1111", "4111111111111112", "2024-02-29", "31.12.1999", "+1 (202) 555-0143", "10.0.0.1", "password=a1b2c3d4e5", "123456789"]:
        new, found = feistel.pseudonymise(f"see {text}, and")
        assert sum(found.values()) == 1 and new != f"see {text}, and" and feistel.reveal(new) == f"see {text}, and", text
        assert len(new) == len(f"see {text}, and") or "." in text
        assert feistel.pseudonymise(f"x {text} y")[0][2:-2] == new[4:-5]  # equal values stay linked
        assert feistel.pseudonymise(f"see {text}, and", b"other")[0] != new
    card = feistel.pseudonymise("4111 1111 1111 1111")[0].replace(" ", "")
    assert feistel.luhn(card[:-1]) == int(card[-1]) and len(card) == 16
    for text in ["on 31.02.2023", "version 1.2.3.4.5", "999.1.1.1", "the year 2023, 12.5 or 7", ""]:
        assert feistel.pseudonymise(text) == (text, {})
    got = by_id(feistel.pseudonyms(docs))
    for i, text, *_ in rows:
        assert (got[i].text is None) == (text is None) and (text is None or feistel.reveal(got[i].text) == text)
    assert (got[len(rows) - 1].n_phone, got[len(rows) - 1].n_email, got[len(rows) - 1].n_card, got[len(rows) - 1].n_date) == (1, 1, 1, 1)
    assert feistel.pseudonyms(empty).count() == 0 and feistel.pseudonyms(odd).count() == odd.count()


def test_hash_tree(spark, docs, rows, empty, odd):
    got = by_id(hash_tree.shards(docs))
    for i, text, *_ in rows:
        assert (got[i].size, got[i].text_crc32) == (len((text or "").encode()) + 1, zlib.crc32((text or "").encode()))
        draws = {}
        for _, _, s, w in hash_tree.grown(hash_tree.TREE):
            u = (int(hashlib.md5(f"{i}/{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            draws[s] = -math.log(u) / w
        assert got[i].grown_shard == min(draws, key=draws.get) and got[i].shard == min(range(16), key=draws.get)
    many = spark.range(6000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    all_ = hash_tree.shards(many, blocks=7).collect()
    for s in range(16):
        slots = sorted(r.slot for r in all_ if r.shard == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - 375) < 100
    assert all(r.grown_shard in (r.shard, 16) for r in all_)
    # more weight in one rack moves documents only into its region and, inside, only into its rack
    heavy = [(g, r, s, 3.0 if r == 2 else w) for g, r, s, w in hash_tree.TREE]
    moved = {r.doc_id: r.shard for r in hash_tree.shards(many, tree=heavy).collect()}
    old = {r.doc_id: r.shard for r in all_}
    assert all(moved[i] == old[i] or moved[i] // 4 == 2 for i in old) and any(moved[i] != old[i] for i in old)
    assert hash_tree.shards(empty).count() == 0 and hash_tree.shards(odd).count() == odd.count()


def test_induced_sorting():
    rng = random.Random(9)
    for _ in range(200):
        t = np.array([rng.randint(0, rng.randint(0, 4)) for _ in range(rng.randint(0, 70))], np.int64)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert suffix_repeats.suffix_order(t, 5, 1000, rng.choice([2, 10**6])).tolist() == want
        if len(t) > 1:
            order = np.array(want)
            lcp = suffix_repeats.common_prefixes(t, order, 6).tolist()
            for k in range(1, len(t)):
                a, b = t[order[k] :].tolist(), t[order[k - 1] :].tolist()
                n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert lcp[k] == min(n, 6)


@pytest.mark.parametrize("length,gram,shard", [(200, 50, 4 << 20), (40, 10, 300)])
def test_suffix_repeats(docs, rows, empty, odd, length, gram, shard):
    def brute(table, got):
        seen = collections.Counter()
        for _, text in table:
            b = (text or "").encode()
            seen.update(b[i : i + length] for i in range(len(b) - length + 1))
        for (i, text), r in zip(table, got):
            b = (text or "").encode()
            mask = np.zeros(len(b), bool)
            for k in range(len(b) - length + 1):
                if seen[b[k : k + length]] > 1:
                    mask[k : k + length] = True
            kept = bytes(np.frombuffer(b, np.uint8)[~mask])
            spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()), i

    run = lambda df: suffix_repeats.digests(suffix_repeats.without_repeats(df, length=length, gram=gram, shard_bytes=shard, limit=500))
    brute([(i, t) for i, t, *_ in rows], sorted(run(docs).collect(), key=lambda r: r.doc_id))
    assert run(empty).count() == 0
    got = run(odd).collect()
    assert len(got) == odd.count() and len({r.kept_sha256 for r in got if r.doc_id == 8}) == 1


def test_ppm(docs, rows, empty, odd):
    train = [small(t).encode() for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for t in train for w in t.split())
    total, kinds = sum(count.values()) + len(train), len(count) + 1
    ctx = [collections.Counter(), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)]
    for t in train:
        s = [256, 256, *t, 256]
        for k in range(2, len(s)):
            ctx[0][s[k]] += 1
            ctx[1][s[k - 1]][s[k]] += 1
            ctx[2][(s[k - 2], s[k - 1])][s[k]] += 1

    def prob(a, b, x):
        out, gone = 1.0, set()
        for c in (ctx[2].get((a, b), {}), ctx[1].get(b, {}), ctx[0]):
            left = {s: n for s, n in c.items() if s not in gone}
            if left:
                whole = sum(left.values()) + len(left)
                if x in left:
                    return out * left[x] / whole
                out *= len(left) / whole
            gone |= set(c)
        return out / (257 - len(gone))

    for known in (7, 10**6):
        got = by_id(ppm.scores(docs, table_words=known))
        for i, text, *_ in rows:
            b, r = small(text).encode(), got[i]
            w = b.split()
            base = sum(math.log10((n + 0.1) / (total + 0.1 * (kinds + 1))) for n in [*(count[x] for x in w), len(train)])
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(w) + 1, sum(x in count for x in w) + 1, total)
            assert r.base_score == pytest.approx(base)
            s = [256, 256, *b, 256]
            if len(b) < 600:
                assert r.score == pytest.approx(sum(math.log10(prob(s[k - 2], s[k - 1], s[k])) for k in range(2, len(s))), rel=1e-4)
    assert ppm.scores(empty).count() == 0 and ppm.scores(odd).count() == odd.count()


def test_ppm_learns(spark):
    """Held-out texts of the trained kind are likelier per byte than shuffled ones and than a uniform model."""
    rng = random.Random(10)
    texts = [sentence(rng, 60) for _ in range(200)]
    mixed = ["".join(rng.sample(t, len(t))) for t in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts)) + [(1000 + 0, "")], "doc_id long, text string")
    got = by_id(ppm.scores(df))
    held = [got[i].score / len(texts[i].encode()) for i in range(200) if got[i].held_out]
    assert held and np.mean(held) > math.log10(1 / 257) * 0.6
    assert mixed


def test_common_helpers():
    roll = common.Roller(1)
    data = np.frombuffer(b"abcabc xyz", np.uint8)
    sums = roll.sums(data)
    h = roll.spans(sums, np.array([0, 3, 1, 0]), np.array([3, 6, 4, 0]))
    assert h[0] == h[1] != h[2] and roll.one(b"abc") == int(h[0])
    s, e, first = common.runs(~common.SPACE[data], np.array([0, 4, 4, 10]))
    assert list(zip(s.tolist(), e.tolist())) == [(0, 4), (4, 6), (7, 10)] and first.tolist() == [0, 1, 1, 3]
