import itertools

import numpy as np
import pyarrow as pa
from conftest_llm import edge_rows

from tidemill.llm import simhash
from tidemill.llm.simhash import distance, drop_near, fingerprints, links, masks, near_groups, signs


def brute(prints, radius):
    parent = {d: d for d, _, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (d, a, b), (e, c, f) in itertools.combinations(prints, 2):
        if bin(a ^ c).count("1") + bin(b ^ f).count("1") <= radius:
            x, y = sorted((find(d), find(e)))
            parent[y] = x
    groups = {}
    for d in parent:
        groups.setdefault(find(d), []).append(d)
    return {(d, g) for g, ds in groups.items() if len(ds) > 1 for d in ds}


def test_masks_cover_every_difference_within_reach():
    m = masks(3, 20, seed=1)
    assert len(m) == 15
    for k in range(4):
        for bits in itertools.combinations(range(20), k):
            d = sum(1 << i for i in bits)
            assert any(int(x) & d == 0 for x in m)
    r = np.random.default_rng(0)
    big = masks()
    for _ in range(2000):
        d = sum(1 << int(i) for i in r.choice(48, 6, replace=False))
        assert any(int(x) & d == 0 for x in big)


def test_signs_are_majorities():
    r = np.random.default_rng(1)
    h = r.integers(0, 2**63, 1500).astype(np.uint64)
    first = np.array([0, 1, 1, 600, 1500])
    got = signs(h, first)
    second = simhash.mix(h ^ np.uint64(0x9E3779B97F4A7C15))
    for t in range(4):
        own = slice(first[t], first[t + 1])
        for col, x in ((0, h[own]), (1, second[own])):
            want = sum(1 << i for i in range(48) if 2 * int(((x >> np.uint64(i)) & np.uint64(1)).sum()) > len(x))
            assert int(got[t, col]) == want


def test_links_give_the_components_of_all_close_pairs():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**48, 3)
    a = np.array([int(base[i % 3]) ^ sum(1 << int(j) for j in r.choice(48, int(r.integers(0, 9)), replace=False)) for i in range(60)])
    b = np.zeros(60, np.int64)
    found = set()
    for x, y in links(np.array([0]), np.array([60]), a, b, 9, room=100):
        found |= set(zip(x.tolist(), y.tolist()))

    def groups(pairs):
        p = list(range(60))
        for x, y in pairs:
            x, y = p[x], p[y]
            p = [min(x, y) if z in (x, y) else z for z in p]
        return p

    close = [(i, j) for i in range(60) for j in range(i) if distance(a[i], b[i], a[j], b[j]) <= 9]
    assert groups(found) == groups(close)


def test_groups_match_brute_force(docs_of, words):
    rows, n = [], 0
    for _ in range(25):
        base = words.text(words.r.randint(60, 200)).split()
        rows.append((n, " ".join(base)))
        n += 1
        for _ in range(words.r.randint(0, 3)):
            copy = [w if words.r.random() > 0.03 else "changedword" for w in base]
            rows.append((n, " ".join(copy)))
            n += 1
    docs = docs_of(rows)
    prints = [tuple(r) for r in fingerprints(docs).collect()]
    want = brute(prints, 13)
    assert len(want) > 20
    assert {tuple(r) for r in near_groups(docs).collect()} == want
    kept = {r.doc_id for r in drop_near(docs).collect()}
    assert kept == {r[0] for r in rows} - {d for d, g in want if d != g}


def test_edges(docs_of):
    docs = docs_of(edge_rows(), "a b u v group_id _gone")
    got = {tuple(r) for r in near_groups(docs).collect()}
    assert got == {(8, 8), (9, 8)}
    kept = drop_near(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(edge_rows()) - 1
    empty = docs.where("false")
    assert near_groups(empty).count() == 0 and drop_near(empty).count() == 0


def test_copies_in_thousands(docs_of, words):
    base = words.text(80)
    docs = docs_of([(i, base) for i in range(2000)] + [(5000, words.text(80))])
    assert drop_near(docs).count() == 2


def test_all_words_count(docs_of, words):
    short = ["".join(p) for p in itertools.product("abcdefghij", repeat=3)]
    pick = lambda n: " ".join(words.r.sample(short, n))
    for n in (2, 5, 300):
        docs = docs_of([(1, pick(n) + " hello"), (2, pick(n) + " hello"), (3, "hello " + pick(n))])
        assert near_groups(docs).count() == 0
    base = pick(300).split()
    docs = docs_of([(1, " ".join(base) + " hello"), (2, " ".join(base) + " world"), (3, " ".join(base[:150] + ["zzz"] + base[151:]) + " hello")])
    assert {tuple(r) for r in near_groups(docs).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_words_do_not_depend_on_batches(words):
    texts = [words.text(50), "", None, "tail "]
    _, codes, first, _ = simhash.word_codes(pa.array(texts))
    assert first.tolist() == [0, 50, 50, 50, 51]
    assert len(codes) == 51
