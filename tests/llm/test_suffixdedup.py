import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm.suffixdedup import _repeats, _runs, anchors, coded, front_code, grams, merge, repeats, shared


def brute(rows, length):
    """(doc_id, start, end, later) of (doc_id, text), each once."""
    where = {}
    words = {d: t.split() for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            where.setdefault(tuple(words[d][i : i + length]), []).append((d, i))
    every, later = {d: set() for d in words}, {d: set() for d in words}
    for places in where.values():
        for k, (d, i) in enumerate(places if len(places) > 1 else []):
            every[d] |= set(range(i, i + length))
            if k:
                later[d] |= set(range(i, i + length))
    out = set()
    for d in words:
        flags = [(i in every[d]) + (i in later[d]) for i in range(len(words[d]) + 1)] + [0]
        start = 0
        for i in range(1, len(flags)):
            if flags[i] != flags[i - 1]:
                if flags[i - 1]:
                    out.add((d, start, i, flags[i - 1] == 2))
                start = i
    return out


@pytest.mark.parametrize(("seed", "length", "gram"), [(0, 50, 26), (1, 12, 5), (2, 8, 3)])
def test_matches_brute_force(docs_of, words, seed, length, gram):
    r = random.Random(seed)
    pool = [words.text(r.randint(length - 4, 3 * length)) for _ in range(6)]
    rows = []
    for d in range(40):
        parts = [words.text(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(pool).split()
            a = r.randint(0, 8)
            parts += [" ".join(p[a : len(p) - r.randint(0, 8)]), words.text(r.randint(0, 20))]
        rows.append((d, " \n".join(parts)))
    rows.append((99, "again and " * 60))
    want = brute(rows, length)
    assert len(want) > 10
    assert {tuple(x) for x in repeats(docs_of(rows), length, gram).collect()} == want


def test_many_tasks_and_ranges(spark, docs_of, words):
    pool = [words.text(70) for _ in range(5)]
    rows = [(d, " ".join([words.text(words.r.randint(0, 60)), words.r.choice(pool), words.text(words.r.randint(0, 30))])) for d in range(60)]
    want = brute(rows, 50)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert {tuple(x) for x in repeats(docs_of(rows).repartition(7)).collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_runs_hold_their_own_range(words):
    texts = [words.text(300) for _ in range(40)]
    codes, first = coded(pa.array(texts))
    at, _, _, _ = anchors(codes, first, 50, 26)
    text = np.searchsorted(first, at, side="right") - 1
    x = [(at[text == i] - first[i]).tolist() for i in range(40)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(range(40), pa.int64()), pa.array(texts), pa.array(x, pa.list_(pa.int32()))], ["doc_id", "t", "text", "x"])
    seen, n = set(), 0
    for b in _runs(50, 26, 16)(iter([rows])):
        (part,), (run,) = b.column(0).to_pylist(), b.column(1).to_pylist()
        keys = [k for _, k, _ in merge([run])]
        assert keys == sorted(keys) and {int.from_bytes(k[:4], "big") * 16 >> 32 for k in keys} == {part}
        seen.add(part)
        n += len(keys)
    assert len(seen) == 16 and n == len(at)


def test_edges(docs_of):
    docs = docs_of(edge_rows(), "t h x d u lo hi part run later")
    got = {tuple(r) for r in repeats(docs).collect()}
    # 30000 equal words: every run repeats, only the first place isn't a later one; repeated rows are one document
    assert got == {(5, 0, 1, False), (5, 1, 30000, True), (8, 0, 1, False), (8, 1, 80, True), (9, 0, 80, True)}
    assert repeats(docs.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.lists(st.integers(0, 2), max_size=6), max_size=8), min_size=1, max_size=7))
def test_merge_of_front_coded_runs(runs):
    coded = [sorted(b"".join(x.to_bytes(4, "big") for x in key) for key in run) for run in runs]
    got = list(merge([front_code(r, [b"head"] * len(r)) for r in coded]))
    want = sorted(k for r in coded for k in r)
    assert [k for _, k, _ in got] == want
    for i, (n, k, head) in enumerate(got):
        assert head == b"head"
        assert n == (shared(want[i - 1], k, 0) if i else 0)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_every_run_has_one_anchor(symbols):
    codes = np.array(symbols, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, h, least, most = anchors(codes, np.array([0, len(codes)]), 9, 4)
    starts = sorted(int(a - o) for a, lo, hi in zip(at, least, most) for o in range(lo, hi + 1))
    assert starts == list(range(max(0, len(symbols) - 8)))
    g = grams(codes, 4)
    assert all(h[i] == g[at[i]] for i in range(len(at)))


def test_what_is_held_does_not_grow_with_copies(words):
    """One passage in very many documents: the suffixes of a range are merged in bounded memory."""
    import tracemalloc

    texts = [words.text(120)]
    codes, first = coded(pa.array(texts))
    at, _, _, _ = anchors(codes, first, 50, 26)

    def runs(lo, hi):
        for k in range(lo, hi, 500):
            n = min(500, hi - k)
            yield pa.RecordBatch.from_arrays([pa.array(range(k, k + n), pa.int64()), pa.array([7] * n, pa.int64()), pa.array(texts * n), pa.array([at.tolist()] * n, pa.list_(pa.int32()))], ["doc_id", "t", "text", "x"])

    def peak(copies):
        made = [b for lo in range(0, copies, 2000) for b in _runs(50, 26, 1)(runs(lo, min(copies, lo + 2000)))]
        tracemalloc.start()
        covered = {}
        for b in _repeats(50, 26)(iter(made)):
            for d, lo, hi, again in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lo", "hi", "later"))):
                covered.setdefault((d, again), []).append((lo, hi)) if d < 3 else None
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, covered, sum(len(r) for b in made for r in b.column(1).to_pylist() if not b.column(2)[0].as_py())

    few, _, small = peak(2000)
    many, covered, size = peak(40000)
    assert set(covered) == {(0, False), (1, True), (2, True)}
    for spans in covered.values():
        spans.sort()
        assert spans[0][0] == 0 and max(h for _, h in spans) == 120 and all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))
    # of a task's copies two are sent; 20 times the copies give 20 times the tasks' runs and no more
    assert size <= 20 * small and many < few + (24 << 20)
