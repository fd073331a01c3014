import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import rans
from tidemill.llm.rans import LANES, SCALE, coder, compress, decode, encode, expand, quantise, tokenise


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=4), st.integers(1, 300), st.integers(0, 99))
def test_round_trip(sizes, symbols, seed):
    r = np.random.default_rng(seed)
    blocks = [np.minimum(r.geometric(0.05, n) - 1, symbols - 1).astype(np.int32) for n in sizes]
    freq = quantise(np.bincount(np.concatenate(blocks), minlength=symbols))
    for b, (stream, states, offsets) in zip(blocks, encode(blocks, freq)):
        assert (decode(stream, states, offsets, len(b), freq) == b).all()


def test_size_is_near_the_entropy_and_checkpoints_decode_alone():
    r = np.random.default_rng(1)
    b = np.minimum(r.geometric(0.02, 60000) - 1, 499).astype(np.int32)
    count = np.bincount(b, minlength=500)
    freq = quantise(count)
    ((stream, states, offsets),) = encode([b], freq)
    p = count[count > 0] / len(b)
    bits = -(p * np.log2(p)).sum() * len(b)
    assert len(stream) * 8 < 1.01 * bits
    assert len(offsets) == -(-len(b) // (64 * 256)) and len(states) == len(offsets) * 64 * 8
    k = 2
    tail = decode(stream, states[k * 512 :], offsets[k:], len(b) - k * 64 * 256, freq)
    assert (tail == b[k * 64 * 256 :]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=400))
def test_quantised_table(counts):
    f = quantise(np.array(counts))
    assert f.sum() == (1 << SCALE if sum(counts) else 0)
    assert ((f > 0) == (np.array(counts) > 0)).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t 　'st漢!.1 ", max_size=40)), min_size=1, max_size=6))
def test_tokens_are_those_of_each_text(texts):
    ids, n = tokenise(pa.array(texts, pa.string()), rans.VOCABULARY)
    at = np.append(0, np.cumsum(n))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == coder(rans.VOCABULARY).encode_ordinary(t or "")


def test_documents_come_back(docs_of, words, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 2000)
    rows = [(i, words.text(words.r.randint(0, 400))) for i in range(200)] + [(777, words.text(9000)), *((d, t) for d, t, *_ in edge_rows())]
    docs = docs_of(rows, "n ids kind")
    blocks = compress(docs, side_by_side=3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted((tuple(r) for r in expand(blocks).collect()), key=key) == sorted(((r[0], r[1]) for r in rows), key=key)
    rows_ = [r for r in blocks.collect() if r.kind == "block"]
    assert len(rows_) > 20 and sum(r.n_tokens for r in rows_) == sum(max(0, n) for r in rows_ for n in r.doc_tokens)


def test_damage_is_noticed():
    b = np.arange(1000, dtype=np.int32) % 50
    freq = quantise(np.bincount(b))
    ((stream, states, offsets),) = encode([b], freq)
    import zlib

    good = zlib.crc32(b.astype("<i4").tobytes())
    assert (decode(stream, states, offsets, 1000, freq, good) == b).all()
    with pytest.raises(ValueError, match="checksum"):
        decode(stream[:-4] + b"\0\1\2\3", states, offsets, 1000, freq, good)


def test_empty(docs_of):
    got = compress(docs_of(edge_rows()).where("false")).collect()
    assert [r.kind for r in got] == ["table"]


def scalar(block, freq):
    """The coder as in the books, a lane after the other, symbol by symbol from the end."""
    start, total = [0, *np.cumsum(freq).tolist()], 1 << SCALE
    x, words = [1 << 31] * LANES, []
    for i in range(len(block) - 1, -1, -1):
        lane, f = i % LANES, int(freq[block[i]])
        if x[lane] >= f << (31 - SCALE + 32):
            words.append((i, x[lane] & 0xFFFFFFFF))
            x[lane] >>= 32
        x[lane] = x[lane] // f * total + x[lane] % f + start[block[i]]
    return b"".join(w.to_bytes(4, "little") for _, w in sorted(words)), x


def test_streams_are_those_of_a_scalar_coder():
    r = np.random.default_rng(4)
    blocks = [np.minimum(r.geometric(0.02, n) - 1, 299).astype(np.int32) for n in (0, 1, 63, 64, 5000, 20000)]
    freq = quantise(np.bincount(np.concatenate(blocks), minlength=300))
    for b, (stream, states, _) in zip(blocks, encode(blocks, freq)):
        want, x = scalar(b.tolist(), freq)
        assert stream == want
        if len(b):
            assert np.frombuffer(states, "<u8")[:LANES].tolist() == x


def test_a_long_document_does_not_take_the_room_of_others(docs_of, words, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 500)
    seen = []
    real = rans.encode
    monkeypatch.setattr(rans, "encode", lambda blocks, freq: seen.append([len(b) for b in blocks]) or real(blocks, freq))
    rows = [(i, words.text(50)) for i in range(60)] + [(100, words.text(9000))]
    docs = docs_of(rows)
    assert sorted(r.doc_id for r in expand(compress(docs)).collect()) == sorted(d for d, _ in rows)
    assert all(len(s) == 1 for s in seen if max(s, default=0) > 500)
