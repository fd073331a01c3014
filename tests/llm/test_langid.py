import numpy as np
import pyarrow as pa
from conftest_llm import Words, edge_rows
from pyspark.sql import functions as F

from tidemill.llm import langid
from tidemill.llm.langid import ALPHA, BETA, L1, L2, NONE, ORDERS, _vectors, follow_leader, calibrate, grams, identify, inverse_frequencies, train


def test_grams_do_not_depend_on_neighbours():
    texts = ["Straße漢", "ab", "", None, "aBab"]
    orders, off = grams(pa.array(texts))
    assert off.tolist() == [0, 7, 9, 9, 9, 13]
    for i, t in enumerate(texts):
        alone, _ = grams(pa.array([t], pa.string()))
        for n, a, b in zip(ORDERS, alone, orders):
            assert a.tolist() == b[off[i] : off[i + 1]].tolist()
            assert (a != NONE).sum() == max(0, len(t or "") - n + 1)
    a, b = (grams(pa.array([t]))[0][2] for t in ("xabc", "abcy"))
    assert a[1] == b[0] and a[0] != b[1]


def test_frequencies_count_documents(docs_of, words):
    texts = [words.text(5) for _ in range(600)] + ["", None]
    idf = inverse_frequencies(docs_of(list(enumerate(texts))))
    df = np.zeros(NONE)
    for t in texts[:600]:
        ids = np.unique(np.concatenate(grams(pa.array([t]))[0]))
        df[ids[ids != NONE]] += 1
    assert np.allclose(idf, np.log(601 / (1 + df)) + 1)


def test_held_out_languages(docs_of):
    makers = {x: Words(seed=k, size=150) for k, x in enumerate(["aa", "bb", "cc"])}
    rows = [(i, makers[x].text(makers[x].r.randint(5, 40)), x if i < 240 else None) for i in range(300) for x in [["aa", "bb", "cc"][i % 3]]]
    docs = docs_of(rows)
    got = {r.doc_id: r for r in identify(docs).collect()}
    assert sum(got[i].predicted == ["aa", "bb", "cc"][i % 3] for i in range(240, 300)) >= 57
    assert all(1 / 3 <= r.confidence <= 1 for r in got.values())
    model = train(docs)
    assert (model.weights == 0).mean() > 0.5
    idf = inverse_frequencies(docs)
    (ids, x), text = _vectors(pa.array([rows[0][1]]), idf)[0], pa.array([rows[0][1]])
    w = model.weights[:-1] / idf[:, None]
    assert np.allclose(model.logits(text)[0][0], x @ w[ids], rtol=1e-4, atol=1e-5)


def test_temperature_has_the_least_loss():
    r = np.random.default_rng(0)
    s = r.normal(size=(4000, 3))
    p = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
    y = np.array([r.choice(3, p=q) for q in p])
    assert 2.5 < calibrate(3 * s, y) < 3.6


def test_edges(docs_of):
    docs = docs_of(edge_rows(), "order nth predicted confidence bucket")
    got = identify(docs).collect()
    assert len(got) == len(edge_rows())
    for r in got:
        assert (r.predicted == langid.UNKNOWN) == (r.doc_id in (1, 2, 7)) and (r.confidence > 0) == (r.doc_id not in (1, 2, 7))
    assert identify(docs.where("false")).count() == 0
    unknown = identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(unknown) == len(edge_rows()) and {(r.predicted, r.confidence) for r in unknown} == {(langid.UNKNOWN, 0.0)}


def test_weights_are_those_of_the_algorithm_as_published():
    """Coordinate by coordinate, with dictionaries, for each example in the same order."""
    r = np.random.default_rng(6)
    rows = []
    for _ in range(30):
        ids = np.unique(r.integers(0, 12, r.integers(0, 6)))
        rows.append((ids, r.random(len(ids)) * 5))
    y = r.integers(0, 3, 30)
    z, n = {}, {}

    def weight(i, c):
        a, b = z.get((i, c), 0.0), n.get((i, c), 0.0)
        return 0.0 if abs(a) <= L1 else -(a - np.sign(a) * L1) / ((BETA + b**0.5) / ALPHA + L2)

    order = np.random.default_rng(1)
    for _ in range(langid.EPOCHS):
        for k in order.permutation(30):
            ids, x = rows[k]
            if not len(ids):
                continue
            w = {(i, c): weight(i, c) for i in ids for c in range(3)}
            s = [sum(v * w[i, c] for i, v in zip(ids, x)) for c in range(3)]
            e = np.exp(np.array(s) - max(s))
            p = e / e.sum()
            for i, v in zip(ids, x):
                for c in range(3):
                    g = v * (p[c] - (c == y[k]))
                    b = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - ((b + g * g) ** 0.5 - b**0.5) / ALPHA * w[i, c]
                    n[i, c] = b + g * g
    got = follow_leader(rows, y, 3)
    want = np.zeros_like(got)
    for i, c in z:
        want[i, c] = weight(i, c)
    assert np.allclose(got, want) and (got != 0).sum() > 5
