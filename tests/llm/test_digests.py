import numpy as np
import pyarrow as pa
from conftest_llm import edge_rows

from tidemill.llm.common import raw
from tidemill.llm.digests import BITS, DULL, FILTER, NEAR, POINTS, STEPS, WINDOW, compare, digest, entropy_steps, features, filters, links, matches, overlap, ranks
from tidemill.llm.queries import op6_fingerprints


def slow_steps(data):
    out = []
    for i in range(len(data) - WINDOW + 1):
        _, n = np.unique(data[i : i + WINDOW], return_counts=True)
        out.append(-(n / WINDOW * np.log2(n / WINDOW)).sum() / 6 * STEPS)
    return np.array(out)


def slow_features(data, rank):
    """Places of a text's features."""
    steps = entropy_steps(data)
    worth = [rank[s] if s >= DULL else 10**6 for s in steps]
    if len(worth) < NEAR:
        return [int(np.argmin(worth))] if len(worth) and min(worth) < 10**6 else []
    points = np.zeros(len(worth), int)
    for i in range(len(worth) - NEAR + 1):
        own = worth[i : i + NEAR]
        if min(own) < 10**6:
            points[i + int(np.argmin(own))] += 1
    return [i for i in range(len(worth)) if points[i] >= POINTS]


def test_entropy_of_every_window(words):
    data = np.frombuffer((words.text(150) + "aaaaaaaa" * 20 + "é漢" * 60).encode(), np.uint8)
    assert np.abs(entropy_steps(data, block=100) - slow_steps(data)).max() <= 1.001
    assert (entropy_steps(data) == entropy_steps(data, block=97)).all()
    assert (entropy_steps(data)[50:] == entropy_steps(data[50:])).all()


def test_features_match_brute_force(spark, docs_of, words):
    texts = [words.text(n) for n in (3, 12, 14, 40, 300)] + ["", "z" * 500, words.text(100)]
    rank = ranks(docs_of(list(enumerate(texts))))
    assert sorted(rank) == list(range(STEPS + 1))
    data, off = raw(pa.array(texts))
    text, h = features(data, off, rank)
    for i, t in enumerate(texts):
        own = np.frombuffer(t.encode(), np.uint8)
        want = {own[p : p + WINDOW].tobytes() for p in slow_features(own, rank)}
        assert (text == i).sum() == len(want) == len(set(h[text == i].tolist()))
    count, chain, body = filters(text, h, len(texts))
    assert chain.tolist() == [-(-c // 160) for c in count]
    bits = np.unpackbits(body).reshape(-1, FILTER * 8)
    first = np.cumsum(chain) - chain
    for i in range(len(texts)):
        for nth, x in enumerate(h[text == i].tolist()):
            assert all(bits[first[i] + nth // 160, (x >> (11 * k)) & 2047] for k in range(BITS))


def test_texts_without_popular_window_have_their_best(docs_of, words):
    long = words.text(2000)
    texts = [long[k * 40 : k * 40 + n] for k, n in enumerate(range(120, 221))]
    rank = ranks(docs_of(list(enumerate([*texts, long]))))
    text, h = features(*raw(pa.array(texts)), rank)
    assert set(text.tolist()) == set(range(len(texts)))
    alone = 0
    for i, t in enumerate(texts):
        own = np.frombuffer(t.encode(), np.uint8)
        want = slow_features(own, rank)
        if not want:
            worth = [rank[s] if s >= DULL else 10**6 for s in entropy_steps(own)]
            points = np.bincount([k + int(np.argmin(worth[k : k + NEAR])) for k in range(len(worth) - NEAR + 1)], minlength=len(worth))
            want = [min(range(len(worth)), key=lambda k: (-points[k], worth[k], k))]
            alone += 1
        places = [t[p : p + WINDOW] for p in want]
        data, off = raw(pa.array(places))
        assert features(data, off, rank)[1].tolist() == h[text == i].tolist()
    assert alone > 15


def test_scores(spark, docs_of, words):
    base = words.text(2000)
    rows = [(1, base), (2, base), (3, base[:6000] + words.text(800)), (4, words.text(2000)), (5, "short")]
    d = digest(docs_of(rows))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5), (1, 77)], "a long, b long")
    got = {r.b: r.score for r in compare(pairs, d).collect()}
    assert got[2] == 100 and 20 < got[3] < 100 and got[4] < 10 and got[5] is None and got[77] is None
    body = {r.doc_id: (bytes(r.digest), r.n_features) for r in d.collect()}
    assert overlap(body[3][0], body[1][0], body[3][1], body[1][1]) == got[3]


def test_edges(docs_of):
    docs = docs_of(edge_rows(), "step n digest n_features")
    got = digest(docs).collect()
    assert len(got) == len(edge_rows())
    for r in got:
        assert len(r.digest) == r.n_filters * FILTER and (r.n_features > 0) == (r.n_filters > 0)
        if r.doc_id in (1, 2, 3, 4, 7):
            assert r.n_features == 0
    assert digest(docs.where("false")).count() == 0


def test_matches_are_all_pairs_with_a_common_feature(docs_of, words):
    part, whole = words.text(90), words.text(150)
    texts = [f"{words.text(60)} {part} {words.text(60)}" for _ in range(9)] + [whole] * 7 + [words.text(80) for _ in range(5)] + [whole + " " + words.text(1500)] * 2
    rows = list(enumerate(texts)) + [(3, texts[3]), (12, texts[0]), (None, whole), (90, None), (91, "short"), (92, "z" * 300)]
    docs = docs_of(rows, "h k x y i j p q a b kind features")
    rank, best = ranks(docs), {}
    data, off = raw(pa.array([t for _, t in rows]))
    text, h = features(data, off, rank)
    own = [h[text == i] for i in range(len(rows))]
    body = [filters(np.zeros(len(f), np.int64), f, 1)[2].tobytes() for f in own]
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows):
            if a is not None and b is not None and a < b and np.isin(own[i], own[j]).any():
                best[a, b] = max(best.get((a, b), 0), overlap(body[i], body[j], len(own[i]), len(own[j])))
    assert len(best) > 70 and any(s < 100 for s in best.values())
    for side in (2, 512):
        got = matches(docs, side=side).collect()
        assert len(got) == len(best)
        assert all(abs(best[r.a, r.b] - r.score) < 1e-9 for r in got)
    assert matches(docs.where("false")).count() == 0


def test_query_returns_a_row_for_each_document(spark, docs_of, words, tmp_path):
    base = words.text(300)
    docs_of([(1, base), (2, base), (3, words.text(300))]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(tuple(r) for r in op6_fingerprints(spark, str(tmp_path)).collect())
    assert rows == [(1, 1, 1, 2, 100.0), (2, 1, 1, 1, 100.0), (3, 3, 0, None, None)]


def test_links_are_those_of_all_pairs(docs_of, words):
    part, whole = words.text(90), words.text(150)
    texts = [f"{words.text(60)} {part} {words.text(60)}" for _ in range(9)] + [whole] * 7 + [words.text(80) for _ in range(5)] + [whole + " " + words.text(1500)] * 2
    rows = [(i - 4, t) for i, t in enumerate(texts)] + [(3, texts[3]), (12, texts[0]), (12, texts[1]), (None, whole), (90, None), (91, "short"), (92, "z" * 300), (93, texts[20])]
    docs = docs_of(rows, "n s t class_id links best")
    met = {}
    for r in matches(docs).collect():
        for x, y in ((r.a, r.b), (r.b, r.a)):
            met.setdefault(x, []).append((-round(r.score, 6), y))
    ids = {k for k, _ in rows if k is not None}
    for side in (2, 512):
        got = {r.doc_id: r for r in links(docs, side=side).collect()}
        assert set(got) == ids
        for k, r in got.items():
            assert r.n_links == len(met.get(k, []))
            assert (r.score is None and r.nearest is None) if k not in met else (-r.score, r.nearest) == min(met[k])
        same = {}
        for k in ids:
            if got[k].n_links:
                same.setdefault(tuple(sorted({t for i, t in rows if i == k})), set()).add(k)
        assert all(got[k].class_id == min(c) for c in same.values() for k in c)
        assert all(got[k].class_id == k for k in (90, 91, 92))
    assert links(docs.where("false")).count() == 0


def test_rows_follow_documents_where_all_share_a_passage(docs_of, words):
    part = words.text(90)
    docs = docs_of([(k, f"{words.text(30)} {part} {words.text(30)}") for k in range(120)])
    got = links(docs, side=16).collect()
    assert len(got) == 120 and {r.n_links for r in got} == {119}
    assert matches(docs, side=16).count() == 120 * 119 // 2
