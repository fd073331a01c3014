import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import edge_rows

from tidemill.llm import toxicity
from tidemill.llm.toxicity import FILTERS, WIDTHS, buckets, classify, drawn, drop_toxic, gradients, parameters, threshold, train


def slow_score(model, text):
    """The network as written: embed, convolve, take the maximum, weigh."""
    word, head, codes, _ = buckets(pa.array([text]))
    if not len(codes):
        return 0.0
    e = np.vstack([model.word[word[codes]] + model.head[head[codes]], np.zeros((2, model.word.shape[1]))])
    best = []
    for f, w in zip(model.filters, WIDTHS):
        # a window starts at a word and may run over the end by two words' worth of nothing
        rows = [sum(e[i + j] @ f[j] for j in range(w) if i + j < len(e)) for i in range(len(codes))]
        best.append(np.max(rows, axis=0))
    z = np.maximum(np.concatenate(best) + model.bias, 0) @ model.out + model.base
    return 1 / (1 + np.exp(-z))


@pytest.fixture
def corpus(docs_of, spark, words):
    bad = ["vile", "rotten", "horrid"]
    rows, labels = [], []
    for i in range(400):
        t = words.text(words.r.randint(20, 80)).split()
        toxic = i % 4 == 0
        for _ in range(2 * toxic):
            t[words.r.randrange(len(t))] = words.r.choice(bad)
        rows.append((i, " ".join(t), words.r.choice(["en", "de"])))
        if i < 320:
            labels.append((i, 1, int(toxic)))
    return rows, docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents(corpus, monkeypatch):
    monkeypatch.setattr(toxicity, "UPDATES", 300)
    rows, docs, labels = corpus
    model = train(docs, labels)
    got = {r.doc_id: r for r in classify(docs, labels, model=model).collect()}
    right = sum(got[i].toxic == (i % 4 == 0) for i in range(320, 400))
    assert right >= 76
    kept = {r.doc_id for r in drop_toxic(docs, labels, model=model).collect()}
    assert kept == {i for i, r in got.items() if not r.toxic}
    assert set(model.thresholds) == {"en", "de"} and len({model.default, *model.thresholds.values()}) == 3


def test_multiplied_out_tables_give_the_network(corpus, monkeypatch):
    monkeypatch.setattr(toxicity, "UPDATES", 30)
    rows, docs, labels = corpus
    model = train(docs, labels)
    texts = [rows[0][1], "", None, "one", rows[1][1] * 5, "two words"]
    got = model.score(pa.array(texts), room=50)
    assert np.allclose(got, [slow_score(model, t) if t else 0.0 for t in texts], atol=1e-5)
    assert np.allclose(got, [model.score(pa.array([t], pa.string()))[0] for t in texts], atol=1e-5)
    assert len(model.bias) == FILTERS * len(WIDTHS)


def test_threshold_by_all_cuts():
    r = np.random.default_rng(0)
    for _ in range(50):
        s, t, w = r.random(12).round(1), (r.random(12) < 0.4).astype(float), r.random(12) + 0.5
        t[0] = 1

        def f1(c):
            return 2 * (w * t * (s > c)).sum() / ((w * (s > c)).sum() + (w * t).sum())

        assert f1(threshold(s, t, w)) == pytest.approx(max(f1(c) for c in [*s, 0.0]))


def test_edges(docs_of, spark, monkeypatch):
    monkeypatch.setattr(toxicity, "UPDATES", 10)
    docs = docs_of(edge_rows(), "score threshold toxic _score word head")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(8, 1, 1), (9, 1, 0), (8, 1, 0), (6, 0, None), (None, 1, 1), (77, 1, 1)], none.schema)
    for labels in (none, some):
        out = drop_toxic(docs, labels)
        assert out.columns == docs.columns
        assert classify(docs, labels).count() == len(edge_rows())
        assert out.where("text IS NULL OR text = ''").count() == 3
    assert drop_toxic(docs, none).count() == len(edge_rows())
    assert classify(docs.where("false"), some).count() == 0


def test_gradients_by_finite_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "WORDS", 40)
    monkeypatch.setattr(toxicity, "HEADS", 12)
    r = np.random.default_rng(2)
    p = {k: v.astype(float) for k, v in parameters(r).items()}
    p["bias"] += r.normal(0, 0.1, p["bias"].shape)
    texts = [(r.integers(0, 40, n), r.integers(0, 12, n)) for n in (1, 2, 7, 30)]
    toxic = np.array([1.0, 0, 0, 1])
    loss, g = gradients(p, texts, toxic)
    z = []
    for w, h in texts:
        e = np.vstack([p["word"][w] + p["head"][h], np.zeros((2, p["word"].shape[1]))])
        best = [np.max([sum(e[i + j] @ p[f"f{k}"][j] for j in range(k) if i + j < len(e)) for i in range(len(w))], axis=0) for k in WIDTHS]
        z.append(np.maximum(np.concatenate(best) + p["bias"], 0) @ p["out"] + p["base"][0])
    assert loss == pytest.approx(np.mean([np.log1p(np.exp(x)) - t * x for x, t in zip(z, toxic)]))
    for name, x in p.items():
        full = g[name]
        if isinstance(full, tuple):
            full = np.zeros_like(x)
            full[g[name][0]] = g[name][1]
        for at in r.choice(x.size, min(x.size, 25), replace=False):
            keep, d = x.flat[at], 1e-6
            x.flat[at] = keep + d
            up, _ = gradients(p, texts, toxic)
            x.flat[at] = keep - d
            down, _ = gradients(p, texts, toxic)
            x.flat[at] = keep
            assert (up - down) / (2 * d) == pytest.approx(full.flat[at], abs=1e-6), (name, at)


def test_thresholds_are_drawn_towards_that_of_all_languages():
    assert drawn(0.9, 0.1, 0) == pytest.approx(0.1)
    between = [drawn(0.9, 0.1, n) for n in (1, 5, 50, 5000)]
    assert between == sorted(between) and 0.1 < between[0] and between[-1] > 0.89


def test_repeated_ids_do_not_break_the_bound(docs_of, spark, words, monkeypatch):
    monkeypatch.setattr(toxicity, "UPDATES", 5)
    seen = []
    real = toxicity._train
    monkeypatch.setattr(toxicity, "_train", lambda texts, toxic, seed=3: seen.append(len(texts)) or real(texts, toxic, seed))
    docs = docs_of([(k % 4, words.text(9)) for k in range(400)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(4)], "doc_id long, quality int, toxic int")
    assert classify(docs, labels, sample=2).count() == 400 and max(seen) == 4


def test_a_kept_model_scores_alike(corpus, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "UPDATES", 20)
    _, docs, labels = corpus
    model = train(docs, labels)
    toxicity.save(model, spark, str(tmp_path / "model"))
    again = toxicity.load(spark, str(tmp_path / "model"))
    assert again.thresholds == model.thresholds and again.default == model.default
    monkeypatch.setattr(toxicity, "train", None)
    assert sorted(map(tuple, classify(docs, None, model=again).collect())) == sorted(map(tuple, classify(docs, None, model=model).collect()))
    assert drop_toxic(docs, None, model=again).count() == drop_toxic(docs, None, model=model).count()


def test_all_labelled_documents_are_trained_on(docs_of, spark, words, monkeypatch):
    monkeypatch.setattr(toxicity, "UPDATES", 1)
    seen = []
    real = toxicity._train
    monkeypatch.setattr(toxicity, "_train", lambda texts, toxic, seed=3: seen.append(len(texts)) or real(texts, toxic, seed))
    docs = docs_of([(k, words.text(2)) for k in range(6110)])
    train(docs, spark.createDataFrame([(k, 1, int(k < 10)) for k in range(6110)], "doc_id long, quality int, toxic int"))
    assert max(seen) == 6110


def test_shards_train_on_all_and_do_not_depend_on_partitions(corpus, monkeypatch):
    monkeypatch.setattr(toxicity, "UPDATES", 100)
    monkeypatch.setattr(toxicity, "ALONE", 160)
    rows, docs, labels = corpus
    labels = labels.unionByName(labels.where("doc_id < 50"))
    again = docs.unionByName(docs.where("doc_id < 30")).repartition(5)
    trained, scored_docs = [], []
    averaged, thresholds = toxicity._averaged, toxicity._thresholds
    monkeypatch.setattr(toxicity, "_averaged", lambda nets, changes: trained.append({(c["net"], c["shard"]): c["docs"] for c in changes if c["name"] == "base"}) or averaged(nets, changes))
    monkeypatch.setattr(toxicity, "_thresholds", lambda model, score, *rest: scored_docs.append(len(score)) or thresholds(model, score, *rest))
    monkeypatch.setattr(toxicity, "_train", None)
    model, other = train(docs, labels), train(again, labels)
    assert scored_docs == [320, 320]
    for t in trained:
        by_net = [sum(n for (net, _), n in t.items() if net == k) for k in range(3)]
        assert by_net[0] == 320 == by_net[1] + by_net[2] and len({shard for _, shard in t}) == 2
    assert model.thresholds == other.thresholds and model.default == other.default and (model.word == other.word).all()
    got = {r.doc_id: r.toxic for r in classify(docs, None, model=model).collect()}
    assert sum(got[i] == (i % 4 == 0) for i in range(320, 400)) >= 76


def test_edges_of_shards(docs_of, spark, monkeypatch):
    monkeypatch.setattr(toxicity, "UPDATES", 3)
    monkeypatch.setattr(toxicity, "ALONE", 1)
    monkeypatch.setattr(toxicity, "NEARBY", 0)
    docs = docs_of(edge_rows(), "score threshold toxic _score word head shard h codes seq")
    some = spark.createDataFrame([(8, 1, 1), (9, 1, 0), (8, 1, 0), (6, 0, None), (None, 1, 1), (77, 1, 1), (1, 1, 0), (5, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (some, some.where("doc_id IN (5, 9)"), some.where("doc_id IN (1, 2, 7)")):
        assert classify(docs, labels).count() == len(edge_rows())


def test_weighted_gradients():
    r = np.random.default_rng(4)
    p = parameters(r)
    texts = [(r.integers(0, 40, n), r.integers(0, 12, n)) for n in (3, 5)]
    toxic = np.array([1.0, 0])
    loss, g = gradients(p, texts, toxic, np.array([3.0, 0]))
    one, h = gradients(p, texts[:1], toxic[:1])
    assert loss == pytest.approx(1.5 * one) and np.allclose(g["out"], 1.5 * h["out"])
