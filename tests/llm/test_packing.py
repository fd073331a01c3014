from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm.packing import Plan, pack


def brute(lengths, capacity):
    """Gaps of the bins when items are placed one by one."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    gaps = []
    while large:
        n = large.pop(0)
        k = next((i for i, m in enumerate(large) if n + m <= capacity), None)
        gaps.append(capacity - n - (large.pop(k) if k is not None else 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [g for g in gaps if g >= n]
        gaps.append(capacity) if not fits else None
        g = min(fits) if fits else capacity
        gaps.remove(g)
        gaps.append(g - n)
    return Counter(gaps)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60))
def test_plan_is_best_fit_item_by_item(lengths):
    plan = Plan(Counter(lengths), 24)
    fill, spans = Counter(), defaultdict(list)
    for n, count in Counter(lengths).items():
        b, o = plan.look_up(np.full(count, n), np.arange(count))
        for x, y in zip(b.tolist(), o.tolist()):
            fill[x] += n
            spans[x].append((y, y + n))
    assert set(fill) == set(range(plan.bins))
    assert Counter(24 - n for n in fill.values()) == brute(lengths, 24)
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:]))
        assert sum(3 * (b - a) > 24 for a, b in s) <= 2


def test_no_token_is_lost(docs_of, words):
    rows = [(i, words.text(words.r.randint(1, 300))) for i in range(300)]
    got = pack(docs_of(rows), 128).collect()
    tokens = defaultdict(list)
    for r in got:
        assert 0 < r.n_tokens <= 128 and r.bin_offset + r.n_tokens <= 128
        tokens[r.doc_id].append((r.first_token, r.first_token + r.n_tokens))
    for d, text in rows:
        s = sorted(tokens[d])
        assert s[0][0] == 0 and s[-1][1] == len(text.split()) and all(a[1] == b[0] for a, b in zip(s, s[1:]))
    lengths = [r.n_tokens for r in got]
    fill = Counter()
    for r in got:
        fill[r.bin_id] += r.n_tokens
    assert Counter(128 - n for n in fill.values()) == brute(lengths, 128)


def test_edges(docs_of):
    docs = docs_of(edge_rows(), "n part salt nth n_tokens bin_id")
    got = pack(docs).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
    assert total == {4: 1, 5: 60000, None: 6, 6: 6, 8: 80, 9: 80}
    assert pack(docs.where("false")).count() == 0


def test_documents_of_many_bins(docs_of, words):
    rows = [(i, words.text(n)) for i, n in enumerate([400, 128, 129, 256, 5, 640, 128, 0, 127])] + [(0, words.text(400)), (3, words.text(256))]
    got = pack(docs_of(rows), 128).collect()
    fill = Counter()
    for r in got:
        fill[r.bin_id] += r.n_tokens
        assert r.first_token == r.part * 128 and (r.n_tokens == 128) <= (r.bin_offset == 0)
    assert set(fill) == set(range(len(fill))) and sum(fill.values()) == sum(len(t.split()) for _, t in rows)
    assert Counter(128 - n for n in fill.values()) == brute([r.n_tokens for r in got], 128)


def test_capacity_is_bounded(docs_of):
    for wrong in (0, 1 << 19):
        with pytest.raises(ValueError, match="capacity"):
            pack(docs_of([(1, "a")]), wrong)
    assert pack(docs_of([(1, "a b")]), (1 << 19) - 1).count() == 1
