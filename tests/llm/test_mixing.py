import hashlib
import math
import time
from collections import Counter, defaultdict

from conftest_llm import edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import mixing
from tidemill.llm.mixing import keep_mixed, mix, permutation, quotas, sainte_lague, shares


def brute(weights, seats, supply):
    got = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if got[i] < supply[i] and weights[i] > 0]
        if not open_:
            break
        got[max(open_, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))] += 1
    return got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 12)), min_size=1, max_size=7), st.integers(0, 50))
def test_highest_quotients(parties, seats):
    weights, supply = [float(w) for w, _ in parties], [s for _, s in parties]
    assert sainte_lague(weights, seats, supply) == brute(weights, seats, supply)


def test_permutation():
    for n in (1, 2, 9, 64):
        a, c = permutation(3, ("s", 1), n)
        assert sorted((a * b + c) % n for b in range(n)) == list(range(n))


def test_quotas_follow_the_weights():
    tokens = {("a", 0): 8000, ("a", 1): 8000, ("b", 0): 5000, ("c", 0): 4800}
    got = quotas(tokens, {"a": 2.0}, block=100, target=9600)
    taken = Counter()
    for (s, _), (q, n) in got.items():
        assert q <= n
        taken[s] += q
    assert taken == {"a": 48, "b": 24, "c": 24}
    assert sum(q for q, _ in quotas(tokens, {}, block=100, share=0.5).values()) == 129


def test_a_scarce_source_does_not_bound_the_others(docs_of, words):
    tokens = {("", 0): 1} | {(f"s{i}", 0): 10_000 * 4096 for i in range(8)}
    got = quotas(tokens, {})
    assert got["", 0] == (1, 1) and sum(q for q, _ in got.values()) == 48_001
    assert max(q for q, _ in got.values()) - min(q for k, (q, _) in got.items() if k[0]) <= 1
    for blocks in (1, 9, 500, 80_001):
        assert sum(q for q, _ in quotas(tokens, {}, target=blocks * 4096).values()) == blocks
    assert sum(q for q, _ in quotas(tokens, {}, target=10**12).values()) == 80_001
    docs = docs_of([(i, words.text(20), "en", f"s{i % 8}") for i in range(400)] + [(900, "one", "en", None)])
    assert mix(docs, block=100).count() > 150
    assert mix(docs, block=100, target=10**6).count() == 401


def test_shards_are_bounded_and_grouped_once():
    tokens = {(f"s{k % 200}", k): 5000 for k in range(100_000)}
    start = time.perf_counter()
    got = quotas(tokens, {}, share=0.5)
    assert time.perf_counter() - start < 30 and sum(q for q, _ in got.values()) == 100_000


def test_achieved_shares_meet_unequal_weights(docs_of, words):
    weights = {"s0": 6.0, "s1": 3.0, "s2": 1.0, "s3": 30.0}
    rows = [(i, words.text(words.r.randint(5, 15)), "en", f"s{i % 3}") for i in range(6000)] + [(9000 + i, words.text(10), "en", "s3") for i in range(60)]
    got = {r.source: r for r in shares(docs_of(rows), weights, block=50, target=24_000).collect()}
    # s3 is too scarce for its weight and gives all it has; the others share the rest by theirs
    assert got["s3"].taken == got["s3"].there == 600
    for s, w in (("s0", 0.6), ("s1", 0.3), ("s2", 0.1)):
        assert abs(got[s].taken / (24_000 - 600) - w) < 0.03
    assert sum(r.target_share for r in got.values()) == 1 and abs(sum(r.taken_share for r in got.values()) - 1) < 1e-9


def test_rows_of_other_sources_and_copies(docs_of, words):
    """The same id and text in two sources are two rows; copies in one source are taken together."""
    rows = [(i, words.text(10), "en", s) for i in range(300) for s in ("A", "B")]
    rows = [(i, rows[2 * i][1], "en", s) for i in range(300) for s in ("A", "B")]
    docs = docs_of(rows)
    how = dict(weights={"A": 3.0, "B": 1.0}, block=50, target=4000)
    taken = Counter((r.doc_id, r.source) for r in mix(docs, **how).collect())
    assert 300 < sum(taken.values()) < 500
    assert Counter((r.doc_id, r.source) for r in keep_mixed(docs, **how).collect()) == taken
    twice = docs.unionByName(docs.where("source = 'A'"))
    taken = Counter((r.doc_id, r.source) for r in mix(twice, **how).collect())
    assert all(n == (2 if s == "A" else 1) for (_, s), n in taken.items())
    assert Counter((r.doc_id, r.source) for r in keep_mixed(twice, **how).collect()) == taken


def test_long_documents_meet_quotas_on_average_only():
    blocks, given = -(-10 * 400_000 // 4096), []
    for seed in range(1000):
        a, c = permutation(seed, ("s", 0), blocks)
        given.append(sum(400_000 for k in range(10) if (a * (k * 400_000 // 4096) + c) % blocks < 100))
    assert abs(sum(given) / 1000 - 409_600) < 40_000 and min(given) == 0 and max(given) > 1_200_000


def replay(docs, block, shard, seed=11, weights=None):
    """Taken (doc_id, source, order) by dealing, laying out and counting in Python."""
    rows, total, streams = [], Counter(), defaultdict(list)
    for r in docs.select("doc_id", "source", "text").collect():
        digest = hashlib.md5((r.text or "").encode()).hexdigest()
        order = int(hashlib.md5(f"{seed}/{'' if r.doc_id is None else r.doc_id}/{digest}".encode()).hexdigest()[:15], 16)
        rows.append((r.source or "", order, r.doc_id, len((r.text or "").split())))
        total[r.source or ""] += rows[-1][3]
    for s, order, doc, size in rows:
        streams[s, order % max(1, -(-total[s] // shard))].append((order, doc is not None, doc or 0, size))
    tokens = {k: sum(x[3] for x in v) for k, v in streams.items()}
    supply = Counter()
    for (s, _), n in tokens.items():
        supply[s] += -(-n // block)
    w = mixing.WEIGHTS if weights is None else weights
    names = sorted(s for s in supply if supply[s])
    seats = brute([w.get(s, 1.0) for s in names], math.ceil(mixing.SHARE * sum(supply.values())), [supply[s] for s in names])
    taken = set()
    for s, q in zip(names, seats):
        shards = sorted(k for k in tokens if k[0] == s and tokens[k])
        there = [-(-tokens[k] // block) for k in shards]
        for k, n, m in zip(shards, there, brute([float(n) for n in there], q, there)):
            a, c = permutation(seed, k, n)
            at, first = 0, {}
            for order, known, doc, size in sorted(streams[k]):
                start = first.setdefault((order, doc), at)
                if (a * min(start // block, n - 1) + c) % n < m:
                    taken.add((doc if known else None, s, order))
                at += size
    return taken


def test_blocks_match_a_replay(docs_of, words):
    rows = [(i, words.text(words.r.randint(1, 60)), "en", f"s{min(words.r.randint(0, 8), 4)}") for i in range(500)]
    docs = docs_of(rows)
    how = dict(block=100, shard=2000, weights={"s4": 3.0})
    got = mix(docs, **how).collect()
    assert len({r.doc_id for r in got}) == len(got) and max(r.shard for r in got) > 0
    size = {d: len(t.split()) for d, t, *_ in rows}
    assert all(size[r.doc_id] == r.n_tokens for r in got)
    assert {(r.doc_id, r.source, r.order) for r in got} == replay(docs, 100, 2000, weights={"s4": 3.0})
    assert sorted(r.doc_id for r in keep_mixed(docs, **how).collect()) == sorted(r.doc_id for r in got)
    assert max(r.shard for r in mix(docs, **how | {"shard": 1}, shards=3).collect()) <= 2


def test_same_rows_as_sql(docs_of, words):
    import duckdb

    rows = [(i, words.text(words.r.randint(1, 60)), "en", f"s{min(words.r.randint(0, 8), 4)}") for i in range(400)] + [(None, "a b", "en", None), (7, None), (8, "", "en", "e"), (9, "x\ty\n z ", "en", "e")]
    docs = docs_of(rows)
    how = dict(weights={"s4": 3.0, "s1": 0.0}, block=50, shard=600)
    documents = docs.toArrow()  # noqa: F841
    got = mix(docs, **how).select("doc_id", "source", "shard", "block", "n_tokens").collect()
    assert Counter(map(tuple, got)) == Counter(duckdb.sql(mixing.sql(**how)).fetchall()) and len(got) > 100


def test_edges(docs_of):
    docs = docs_of(edge_rows(), "_id _s _o _t order start block q n a c shard parts text_hash n_tokens")
    out = keep_mixed(docs)
    assert out.columns == docs.columns
    assert 0 < out.count() <= len(edge_rows())
    empty = docs.where("false")
    assert mix(empty).count() == 0 and keep_mixed(empty).count() == 0
    assert mix(docs.where("text IS NULL")).count() == 0
