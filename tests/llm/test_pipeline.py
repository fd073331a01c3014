import inspect
from collections import Counter

import corpus_pipeline
from conftest_llm import edge_rows
from test_linededup import brute as brute_lines
from test_mixing import replay
from test_packing import brute as brute_bins
from test_simhash import brute as brute_groups

from tidemill.llm import mixing, packing, toxicity
from tidemill.llm.simhash import fingerprints


def test_stages_follow_each_other(spark, docs_of, words, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "UPDATES", 400)
    real, fitted = toxicity.train, []

    def train(*a, **k):
        # the whole run has the same documents and labels as the stage by itself
        fitted.extend([] if fitted else [real(*a, **k)])
        return fitted[0]

    monkeypatch.setattr(toxicity, "train", train)
    rows, labels = [], []
    for i in range(300):
        t = words.text(60).split()
        if i % 6 == 0:
            for k in (3, 20, 40):
                t[k] = words.r.choice(["vile", "rotten", "horrid"])
        labels.append((i, 1, int(i % 6 == 0)))
        rows.append((i, "\n".join(" ".join(t[k : k + 12]) for k in range(0, 60, 12)), "en", f"s{i % 3}"))
    rows += [(1000, rows[1][1] + " more"), (1001, rows[2][1].replace(" ", "  ")), *((d + 5000 if d else d, *rest) for d, *rest in edge_rows())]
    docs = docs_of(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    steps = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage_in, before_rows = steps, steps.select("doc_id", "text").collect()
        before = {r.doc_id for r in before_rows}
        out = stage(spark, steps, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            steps = spark.read.parquet(str(tmp_path / name))
            after = {r.doc_id for r in steps.select("doc_id").collect()}
            assert after <= before
            if name == "toxicity":
                assert sum(i in after for i in range(0, 300, 6)) <= 5 and sum(i in after for i in range(300) if i % 6) >= 248
            if name == "line_dedup":
                given = {r.doc_id: r.text for r in before_rows if r.doc_id is not None and r.text is not None}
                want = {d: x for d, (x, n) in brute_lines(given.items()).items() if not n or x.strip()}
                assert {r.doc_id: r.text for r in steps.collect() if r.doc_id is not None and r.text is not None} == want
            if name == "simhash":
                # of 1000, line dedup has left the last line only
                assert 1000 in after and 1001 not in after
                prints = {r.doc_id: tuple(r) for r in fingerprints(stage_in).collect()}
                groups = brute_groups(list(prints.values()), 13)
                assert after == before - {d for d, g in groups if d != g}
            if name == "mixing":
                taken = replay(stage_in, mixing.BLOCK, mixing.SHARD)
                assert after == {d for d, *_ in taken}
    packed, tokens, fill = out.collect(), Counter(), Counter()
    for r in packed:
        tokens[r.doc_id] += r.n_tokens
        fill[r.bin_id] += r.n_tokens
    size = Counter()
    for r in stage_in.select("doc_id", "text").collect():
        size[r.doc_id] += len((r.text or "").split())
    assert tokens == Counter({d: n for d, n in size.items() if n})
    assert Counter(packing.CAPACITY - n for n in fill.values()) == brute_bins([r.n_tokens for r in packed], packing.CAPACITY)
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select(out.columns).collect())) == Counter(map(tuple, packed))


def test_run_over_nothing_and_over_clashing_columns(spark, docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "UPDATES", 5)
    docs = docs_of(edge_rows(), "_score _removed _gone _id _s _o _t _at n lines_removed order start block shard salt rest wholes toxic")
    for name, rows in (("none", docs.where("false")), ("some", docs)):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        # of the texts with words the copies of one go, and the mixture takes its share of the rest
        assert {r.doc_id for r in got} <= {None, 4, 5, 6, 8} and (len(got) > 0) == (name == "some")


def test_contract():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, f in corpus_pipeline.STAGES:
        assert list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"]
