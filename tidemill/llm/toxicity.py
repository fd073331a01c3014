"""Toxic documents by a small convolutional text classifier, trained in numpy.

A word's embedding is the sum of a row for its own hash and one for the hash
of its first letters.  Filters of one, two and three words run over the whole
text; the strongest answer of each filter goes into a logistic output.  For
scoring, embeddings and filters are multiplied out once, so that a filter is
the sum of a few looked-up numbers.  All labelled documents are trained on: a
few on the driver, many in shards where each task trains on its own documents
and the networks are averaged after each round.  Each language has its own threshold.  It
is set on all labelled documents, each scored by a network that was trained
without it, and drawn towards the threshold of all languages the more, the
fewer toxic documents the language has.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, cut, fresh, hashes, mix, normal, pieces, word_codes

#: Labels up to which the driver trains, and documents of a shard beyond that; shards at most, as each sends its networks to the driver.
ALONE, SHARDS = 12_800, 8
#: Labels up to which they are sent to the documents instead of both being sent by id.
NEARBY = 1 << 20
#: Documents and words of a chunk, updates between two averages, words of a batch.
CHUNK, CHUNK_WORDS, APART, BATCH_WORDS = 512, 1 << 20, 300, 1 << 18
WORDS, HEADS, HEAD, DIM, FILTERS, WIDTHS = 1 << 15, 1 << 13, 4, 16, 8, (1, 2, 3)
UPDATES, BATCH, RATE = 1200, 48, 0.01
#: Parts of the labelled documents that are left out in turn, to set the thresholds.
FOLDS = 2
#: A language's own threshold counts by its toxic documents, that of all languages as so many.
SHRINK = 10.0


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For distinct words their two rows, then each word's code and each text's first word."""
    values, codes, first, _ = word_codes(texts)
    plain = normal(values)
    word = (hashes(plain) % np.uint64(WORDS)).astype(np.int32)
    head = (hashes(pc.utf8_slice_codeunits(plain, 0, HEAD)) % np.uint64(HEADS)).astype(np.int32)
    return word, head, codes, first


@dataclass
class Model:
    word: np.ndarray
    head: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    base: float
    thresholds: dict[str, float]
    default: float

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What each row of the embeddings adds to each filter at each of its places."""
        k = np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)
        return (self.word @ k).astype(np.float32), (self.head @ k).astype(np.float32)

    def score(self, texts: pa.Array, tables: tuple[np.ndarray, np.ndarray] | None = None, room: int = 1 << 18) -> np.ndarray:
        """Probability for each text; null and wordless texts get 0."""
        t = tables or self.tables()
        word, head, codes, first = buckets(texts)
        n, out = np.diff(first), np.zeros(len(first) - 1)
        if not len(codes):
            return out
        values = np.vstack([t[0][word] + t[1][head], np.zeros((1, t[0].shape[1]), np.float32)])
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + room, side="right")) - 1)
            out[lo:hi] = self._some(values, codes[first[lo] : first[hi]], n[lo:hi])
            lo = hi
        return np.where(n > 0, out, 0.0)

    def _some(self, values: np.ndarray, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        pad = max(WIDTHS) - 1
        ends = np.cumsum(n + pad)
        begin = ends - (n + pad)
        padded = np.full(int(ends[-1]) + pad, len(values) - 1, np.int64)
        padded[np.repeat(begin - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(len(codes))] = codes
        size, col, best = int(ends[-1]), 0, []
        for width in WIDTHS:
            answer = 0
            for j in range(width):
                answer = answer + np.take(np.ascontiguousarray(values[:, col : col + FILTERS]), padded[j : size + j], axis=0)
                col += FILTERS
            # windows that start at a word; those in between would see the next text
            best.append(np.maximum.reduceat(answer, np.stack([begin, begin + n], axis=1).ravel(), axis=0)[::2])
        z = np.maximum(np.concatenate(best, axis=1) + self.bias, 0) @ self.out + self.base
        return 1 / (1 + np.exp(-z))


def parameters(r: np.random.Generator) -> dict[str, np.ndarray]:
    p = {"word": r.normal(0, 0.1, (WORDS, DIM)).astype(np.float32), "head": r.normal(0, 0.1, (HEADS, DIM)).astype(np.float32), "bias": np.zeros(FILTERS * len(WIDTHS)), "out": r.normal(0, 0.3, FILTERS * len(WIDTHS)), "base": np.zeros(1)}
    return p | {f"f{w}": r.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS}


def gradients(p: dict[str, np.ndarray], texts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[float, dict]:
    """Mean weighted log loss of some texts and its gradient, for embeddings as (rows, sums).

    The gradient of a maximum goes to the first place that has it.
    """
    pad = max(WIDTHS) - 1
    n = np.array([len(t[0]) for t in texts])
    begin = np.cumsum(n + pad) - (n + pad)
    size = int((n + pad).sum())
    live = np.zeros(size + pad, bool)
    word, head = (np.zeros(size + pad, np.int64) for _ in range(2))
    for b, t in zip(begin, texts):
        word[b : b + len(t[0])], head[b : b + len(t[0])] = t
        live[b : b + len(t[0])] = True
    e = np.take(p["word"], word, axis=0)  # far faster than indexing
    e += np.take(p["head"], head, axis=0)
    e[~live] = 0
    each = e @ np.concatenate([p[f"f{w}"][j] for w in WIDTHS for j in range(w)], axis=1).astype(e.dtype)
    best, where, col = [], [], 0
    for w in WIDTHS:
        answer = each[:size, col : col + FILTERS]
        for j in range(1, w):
            answer = answer + each[j : size + j, col + j * FILTERS : col + (j + 1) * FILTERS]
        col += w * FILTERS
        at = np.stack([b + answer[b : b + m].argmax(axis=0) for b, m in zip(begin, n)])
        best.append(np.take_along_axis(answer, at, axis=0))
        where.append(at)
    pre = np.concatenate(best, axis=1) + p["bias"]
    act = np.maximum(pre, 0)
    z = act @ p["out"] + p["base"][0]
    loss = float((weight * (np.logaddexp(0, z) - toxic * z)).mean())
    d = weight * (1 / (1 + np.exp(-z)) - toxic) / len(texts)
    g = {"out": act.T @ d, "base": np.array([d.sum()])}
    dp = d[:, None] * p["out"] * (pre > 0)
    g["bias"] = dp.sum(axis=0)
    rows, grads = [], []
    for k, w in enumerate(WIDTHS):
        own, at = dp[:, k * FILTERS : (k + 1) * FILTERS], where[k]
        g[f"f{w}"] = np.stack([np.einsum("bf,bfd->df", own, e[at + j]) for j in range(w)])
        for j in range(w):
            rows.append((at + j).ravel())
            grads.append((own[:, :, None] * p[f"f{w}"][j].T).reshape(-1, DIM))
    rows, grads = np.concatenate(rows), np.concatenate(grads)
    use = live[rows]
    for name, index in (("word", word), ("head", head)):
        own = index[rows[use]]
        order = np.argsort(own, kind="stable")
        own = own[order]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        g[name] = (own[start], np.add.reduceat(grads[use][order], start, axis=0).astype(p[name].dtype))
    return loss, g


class Adam:
    """Updates of a network's parameters, in place; of embeddings only the rows that occur."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = RATE):
        self.p, self.rate, self.step = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def update(self, g: dict) -> None:
        self.step += 1
        m, v = self.m, self.v
        for name, x in self.p.items():
            at, dx = g[name] if isinstance(g[name], tuple) else (slice(None), g[name])
            m[name][at] = 0.9 * m[name][at] + 0.1 * dx
            v[name][at] = 0.999 * v[name][at] + 0.001 * dx * dx
            x[at] -= self.rate * (m[name][at] / (1 - 0.9**self.step)) / (np.sqrt(v[name][at] / (1 - 0.999**self.step)) + 1e-8)


def _model(p: dict[str, np.ndarray]) -> Model:
    return Model(p["word"].astype(np.float32), p["head"].astype(np.float32), [p[f"f{w}"].astype(np.float32) for w in WIDTHS], p["bias"], p["out"], float(p["base"][0]), {}, 0.5)


def _train(texts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, seed: int = 3) -> Model:
    """Adam on batches that are half toxic; the documents of a class come in turn, so each of ``ALONE`` is trained on."""
    r = np.random.default_rng(seed)
    p = parameters(r)
    adam, half = Adam(p), BATCH // 2
    turns = []
    for c in (0, 1):
        side = np.flatnonzero(toxic == c)
        turns.append(np.concatenate([r.permutation(side) for _ in range(-(-UPDATES * half // len(side)))]))
    for step in range(UPDATES):
        some = np.concatenate([t[step * half : (step + 1) * half] for t in turns])
        adam.update(gradients(p, [texts[i] for i in some], toxic[some])[1])
    return _model(p)


def threshold(score: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the widest gap between scores among those with the highest weighted F1."""
    order = np.argsort(-score, kind="stable")
    s, w, t = score[order], weight[order], toxic[order]
    hit, said = np.cumsum(w * t), np.cumsum(w)
    f1 = 2 * hit / (said + (w * t).sum())
    nxt = np.append(s[1:], 0.0)
    ok = (s > nxt) & (f1 >= f1[s > nxt].max() - 1e-12)
    k = np.flatnonzero(ok)[np.argmax((s - nxt)[ok])]
    return float((s[k] + nxt[k]) / 2)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("toxic", pa.int32()), ("word", pa.list_(pa.int32())), ("head", pa.list_(pa.int32()))])
    for part in pieces(batches):
        word, head, codes, first = buckets(part.column("text"))
        off = pa.array(first.astype(np.int32))
        lists = [pa.ListArray.from_arrays(off, pa.array(x[codes] if len(codes) else np.zeros(0, np.int32), pa.int32())) for x in (word, head)]
        yield batch(schema, part.column("doc_id"), part.column("lang"), part.column("toxic"), *lists)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a shard's documents, whose rows come sorted; of rows with one id the first counts."""
    held: list[tuple] = []
    words = seq = 0
    last = None

    def chunk() -> pa.RecordBatch:
        nonlocal held, words, seq
        fold = (mix(np.array([d[1] for d in held], np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(np.uint8)
        toxic = np.array([d[3] > 0 for d in held], np.uint8)
        n = np.array([len(d[4]) // 4 for d in held], np.int32)
        counts = np.bincount(fold * 2 + toxic, minlength=2 * FOLDS)
        blob = pa.compress(b"".join(d[4] for d in held), codec="zstd", asbytes=True)
        row = [held[0][0], seq, counts.tolist(), [d[2] for d in held], fold.tobytes(), toxic.tobytes(), n.tobytes(), blob]
        held, words, seq = [], 0, seq + 1
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _CHUNKS, strict=True)], schema=_CHUNKS)

    for part in batches:
        for row in zip(*(part.column(c).to_pylist() for c in ("shard", "doc_id", "lang", "toxic", "codes"))):
            if row[1] != last and row[4]:
                held.append(row)
                words += len(row[4]) // 4
                if len(held) == CHUNK or words >= CHUNK_WORDS:
                    yield chunk()
            last = row[1]
    if held:
        yield chunk()


_CHUNKS = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("counts", pa.list_(pa.int64())), ("lang", pa.list_(pa.string())), ("fold", pa.binary()), ("toxic", pa.binary()), ("n", pa.binary()), ("codes", pa.binary())])


def _opened(part: pa.RecordBatch) -> Iterator[tuple]:
    """Of each chunk: shard, number, languages, folds, classes and texts."""
    for row in part.to_pylist():
        fold, toxic = (np.frombuffer(row[c], np.uint8) for c in ("fold", "toxic"))
        n = np.frombuffer(row["n"], np.int32)
        off = np.append(0, np.cumsum(n, dtype=np.int64))
        codes = np.frombuffer(pa.decompress(row["codes"], decompressed_size=int(off[-1]) * 4, codec="zstd"), np.uint32)
        word, head = (codes // HEADS).astype(np.int32), (codes % HEADS).astype(np.int32)
        yield row["shard"], row["seq"], row["lang"], fold, toxic, [(word[lo:hi], head[lo:hi]) for lo, hi in zip(off[:-1], off[1:])]


def _batches(order: np.ndarray, texts: list) -> Iterator[np.ndarray]:
    lo = 0
    while lo < len(order):
        hi, words = lo, 0
        while hi < len(order) and hi - lo < BATCH and (hi == lo or words + len(texts[order[hi]][0]) <= BATCH_WORDS):
            words += len(texts[order[hi]][0])
            hi += 1
        yield order[lo:hi]
        lo = hi


def _round(nets, weights: tuple[float, float], rate: float, seed: int):
    """Train each net of a broadcast on a shard's chunks, but for its fold; gives what has changed."""
    schema = pa.schema([("net", pa.int32()), ("shard", pa.int32()), ("docs", pa.int64()), ("name", pa.string()), ("at", pa.binary()), ("rows", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [{k: x.copy() for k, x in p.items()} for p in nets.value]
        adams, docs = [Adam(p, rate) for p in own], [0] * len(own)
        at = None
        for part in batches:
            for at, seq, _, fold, toxic, texts in _opened(part):
                r = np.random.default_rng((seed, at, seq))
                key = np.empty(len(toxic))
                for c in (0, 1):  # each batch has its share of either class
                    side = r.permutation(np.flatnonzero(toxic == c))
                    key[side] = (np.arange(len(side)) + 0.5) / max(len(side), 1)
                order = np.argsort(key, kind="stable")
                weight = np.where(toxic > 0, weights[1], weights[0])
                for k, adam in enumerate(adams):
                    use = order[fold[order] != k - 1]
                    docs[k] += len(use)
                    for some in _batches(use, texts):
                        adam.update(gradients(adam.p, [texts[i] for i in some], toxic[some].astype(float), weight[some])[1])
        for k, p in enumerate(own):
            for name, x in p.items():
                if docs[k]:
                    flat, before = x.reshape(len(x), -1), nets.value[k][name].reshape(len(x), -1)
                    rows = np.flatnonzero((flat != before).any(axis=1)).astype(np.int32)
                    yield batch(schema, [k], [at], [docs[k]], [name], [rows.tobytes()], [(flat[rows] - before[rows]).astype(np.float32).tobytes()])

    return run


def _averaged(nets: list[dict[str, np.ndarray]], changes: list[dict]) -> None:
    """Add to each row the mean change of the shards that changed it, by their documents."""
    for k, p in enumerate(nets):
        for name, x in p.items():
            flat = x.reshape(len(x), -1)
            total, docs = np.zeros(flat.shape), np.zeros((len(x), 1))
            for c in sorted((c for c in changes if c["net"] == k and c["name"] == name), key=lambda c: c["shard"]):
                at = np.frombuffer(c["at"], np.int32)
                total[at] += c["docs"] * np.frombuffer(c["rows"], np.float32).reshape(len(at), -1)
                docs[at] += c["docs"]
            flat += (total / np.maximum(docs, 1)).astype(x.dtype)


def _train_shards(chunks: DataFrame, nets: list[dict[str, np.ndarray]], shards: int, docs: tuple[int, int]) -> None:
    """Train ``nets``, the first on all and each other without a fold, on every chunk at least once."""
    sc = chunks.sparkSession.sparkContext
    one = sum(docs) / BATCH / shards
    passes = max(1, round(UPDATES / one))
    rounds = max(1, round(one / APART))
    weights = tuple(sum(docs) / 2 / n for n in docs)
    total = passes * rounds
    for k in range(total):
        sent = sc.broadcast(nets)
        own = chunks.where(F.col("seq") % rounds == k % rounds)
        rate = RATE * min(1.0, 2 * (total - k) / (total + 1))
        changes = own.mapInArrow(_round(sent, weights, rate, k), "net int, shard int, docs long, name string, at binary, rows binary").toArrow().to_pylist()
        _averaged(nets, changes)
        sent.destroy()


def _held_out(models):
    """(lang, toxic, score) of every document of the chunks, by the model trained without its fold, a row for each chunk."""
    schema = pa.schema([("lang", pa.list_(pa.string())), ("toxic", pa.binary()), ("score", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for _, _, lang, fold, toxic, texts in _opened(part):
                score = np.empty(len(texts))
                for k, model in enumerate(models.value):
                    out = np.flatnonzero(fold == k)
                    if len(out):
                        score[out] = _scores(model, [texts[i] for i in out])
                yield batch(schema, [lang], [toxic.tobytes()], [score.tobytes()])

    return run


def _scores(model: Model, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    tables, score = model.tables(), np.empty(len(texts))
    for lo in range(0, len(texts), 64):
        some = texts[lo : lo + 64]
        words, heads = (np.concatenate([t[j] for t in some]) for j in (0, 1))
        values = np.vstack([tables[0][words] + tables[1][heads], np.zeros((1, tables[0].shape[1]), np.float32)])
        score[lo : lo + 64] = model._some(values, np.arange(len(words)), np.array([len(t[0]) for t in some]))
    return score


def drawn(own: float, pooled: float, n: int) -> float:
    """A threshold between a language's own, from ``n`` toxic documents, and that of all languages, on the scale of log odds."""
    a, b = (np.log(t / (1 - t)) for t in np.clip([own, pooled], 1e-9, 1 - 1e-9))
    return float(1 / (1 + np.exp(-(n * a + SHRINK * b) / (n + SHRINK))))


def _thresholds(model: Model, score: np.ndarray, toxic: np.ndarray, lang: np.ndarray, weight: np.ndarray) -> Model:
    model.default = threshold(score, toxic, weight)
    for x in sorted(set(lang) - {""}):
        own = lang == x
        n = int(toxic[own].sum())
        model.thresholds[x] = drawn(threshold(score[own], toxic[own], weight[own]), model.default, n) if n else model.default
    return model


def _nothing() -> Model:
    """Calls nothing toxic."""
    zero = np.zeros(FILTERS * len(WIDTHS))
    return Model(np.zeros((WORDS, DIM), np.float32), np.zeros((HEADS, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], zero, zero, -20.0, {}, 0.5)


def train(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> Model:
    """Fit on all labelled documents, or if asked for on at most ``sample`` of either class, by a hash of doc_id.

    Labels with null id or class are left out; where labels of a document
    differ it counts as toxic.  Of several rows with an id the one with the
    least text hash counts.  Up to ``ALONE`` labels are trained on by the
    driver, beyond that by a task for each shard, for which a document's shard
    and place follow from its id alone; then only networks and the scores that
    thresholds are set by (9 bytes and a language each) come to the driver.
    If there are no words of one of the classes, the model calls nothing toxic.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = dict(known.groupBy("toxic").count().collect())
    if sample is not None:
        order = F.xxhash64("doc_id")
        known = known.where("toxic > 0").orderBy(order, "doc_id").limit(sample).unionByName(known.where("toxic <= 0").orderBy(order, "doc_id").limit(sample))
    most = sum(min(sum(c for t, c in share.items() if (t > 0) == x), sum(share.values()) if sample is None else sample) for x in (False, True))
    # as many labels as the parameter allows, so broadcast whatever the corpus holds
    near = F.broadcast(known) if most <= NEARBY else known
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = text.join(near, "doc_id")
    if most > ALONE:
        return _fit_shards(rows, min(SHARDS, -(-most // ALONE)), share, sample)
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text", "lang").alias("h"), "lang", "toxic", "text")).alias("r")).select("doc_id", "r.lang", "r.toxic", "r.text")
    got = rows.mapInArrow(_coded, "doc_id long, lang string, toxic int, word array<int>, head array<int>").toArrow().combine_chunks()
    lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (x.chunk(0) if isinstance(x, pa.ChunkedArray) and x.num_chunks else x.combine_chunks() for x in (got["word"], got["head"]))]
    ids = got["doc_id"].to_numpy()
    n = np.diff(lists[0][1])
    at = np.array([i for i in np.argsort(ids) if n[i]], np.int64)
    texts = [(lists[0][0][lists[0][1][i] : lists[0][1][i + 1]], lists[1][0][lists[1][1][i] : lists[1][1][i + 1]]) for i in at]
    toxic = (got["toxic"].to_numpy()[at] > 0).astype(float)
    lang = np.array([x or "" for x in got["lang"].to_pylist()], object)[at]
    both = lambda t: all((t == c).any() for c in (0, 1))
    if not both(toxic):
        return _nothing()
    model = _train(texts, toxic)
    fold = np.random.default_rng(5).permutation(len(at)) % FOLDS
    if not all(both(toxic[fold != k]) for k in range(FOLDS)):
        return model
    score = np.empty(len(at))
    for k in range(FOLDS):
        out = np.flatnonzero(fold == k)
        score[out] = _scores(_train([texts[i] for i in np.flatnonzero(fold != k)], toxic[fold != k]), [texts[i] for i in out])
    return _thresholds(model, score, toxic, lang, _weights(toxic, share, sample))


def _weights(toxic: np.ndarray, share: dict[int, int], sample: int | None) -> np.ndarray:
    """How much a document counts for thresholds: one, unless the classes were sampled."""
    if sample is None:
        return np.ones(len(toxic))
    there = [sum(c for t, c in share.items() if (t > 0) == x) / (toxic == x).sum() for x in (False, True)]
    return np.where(toxic > 0, 1.0, there[0] / there[1])


def _fit_shards(rows: DataFrame, shards: int, share: dict[int, int], sample: int | None) -> Model:
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("toxic", pa.int32()), ("h", pa.int64()), ("codes", pa.binary())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            word, head, codes, first = buckets(part.column("text"))
            both = (word.astype(np.uint32) * np.uint32(HEADS) + head.astype(np.uint32))[codes] if len(codes) else np.zeros(0, np.uint32)
            blob = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((first * 4).astype(np.int32).tobytes()), pa.py_buffer(both.tobytes())])
            yield batch(schema, *(part.column(c) for c in ("doc_id", "lang", "toxic", "h")), blob)

    rows = rows.select("doc_id", "lang", "toxic", F.xxhash64("text", "lang").alias("h"), "text").mapInArrow(coded, "doc_id long, lang string, toxic int, h long, codes binary")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard"))
    rows = rows.sortWithinPartitions(F.xxhash64(F.lit(5), "doc_id"), "doc_id", "h").select("shard", "doc_id", "lang", "toxic", "codes")
    chunks = cut(rows.mapInArrow(_packed, "shard int, seq int, counts array<long>, lang array<string>, fold binary, toxic binary, n binary, codes binary"))
    by = np.array([c or 0 for c in chunks.agg(*[F.sum(F.col("counts")[i]) for i in range(2 * FOLDS)]).first()], np.int64).reshape(FOLDS, 2)
    docs = by.sum(axis=0)
    if not docs.all():
        return _nothing()
    folds = FOLDS if (docs - by > 0).all() else 0
    nets = [parameters(np.random.default_rng(3)) for _ in range(1 + folds)]
    _train_shards(chunks, nets, shards, (int(docs[0]), int(docs[1])))
    models = [_model(p) for p in nets]
    if not folds:
        return models[0]
    held = chunks.mapInArrow(_held_out(chunks.sparkSession.sparkContext.broadcast(models[1:])), "lang array<string>, toxic binary, score binary").collect()
    toxic = np.concatenate([np.frombuffer(r.toxic, np.uint8) for r in held]).astype(float)
    score = np.concatenate([np.frombuffer(r.score, np.float64) for r in held])
    lang = np.array([x or "" for r in held for x in r.lang], object)
    return _thresholds(models[0], score, toxic, lang, _weights(toxic, share, sample))


def scored(model: Model) -> Column:
    tables, keep = [], model

    def score(texts: pa.Array) -> pa.Array:
        if not tables:
            tables.append(keep.tables())
        if not len(texts):
            return pa.array([], pa.float64())
        rows = pa.RecordBatch.from_arrays([texts], ["text"])
        return pa.array(np.concatenate([keep.score(p.column("text"), tables[0]) for p in pieces(iter([rows]), limit=2 << 20)]))

    return F.arrow_udf(score, "double")(F.col("text").cast("string"))


def limit(model: Model) -> Column:
    c = F.lit(model.default)
    for x, t in sorted(model.thresholds.items()):
        c = F.when(F.col("lang") == x, t).otherwise(c)
    return c


def save(model: Model, spark: SparkSession, path: str) -> None:
    """Keep a fitted model, a few MB, in a folder that executors share."""
    arrays = {"word": model.word, "head": model.head, "bias": model.bias, "out": model.out} | {f"f{k}": f for k, f in enumerate(model.filters)}
    packed = io.BytesIO()
    np.savez_compressed(packed, base=model.base, default=model.default, names=np.array(sorted(model.thresholds), str), cuts=np.array([model.thresholds[x] for x in sorted(model.thresholds)]), **arrays)
    spark.createDataFrame([(bytearray(packed.getvalue()),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    x = np.load(io.BytesIO(bytes(spark.read.parquet(path).first()[0])))
    thresholds = dict(zip(x["names"].tolist(), x["cuts"].tolist()))
    return Model(x["word"], x["head"], [x[f"f{k}"] for k in range(len(WIDTHS))], x["bias"], x["out"], float(x["base"]), thresholds, float(x["default"]))


def classify(docs: DataFrame, labels: DataFrame | None, sample: int | None = None, model: Model | None = None) -> DataFrame:
    """(doc_id, lang, score, threshold, toxic) for every row of ``docs``.

    Null and empty texts score 0 and aren't toxic; texts of any length are
    read whole, and an empty table gives no rows.  A score equal to its
    threshold isn't toxic.  A null or unknown language has the threshold of
    all languages.  Null ids and repeated rows are scored like others; extra
    columns are ignored, whatever their names.  With a ``model`` nothing is fitted.
    """
    model = model or train(docs, labels, sample)
    rows = docs.select("doc_id", "lang", scored(model).alias("score"), limit(model).alias("threshold"))
    return rows.withColumn("toxic", F.col("score") > F.col("threshold"))


def drop_toxic(docs: DataFrame, labels: DataFrame | None, sample: int | None = None, model: Model | None = None) -> DataFrame:
    """``docs`` without the rows that ``classify`` calls toxic; null and empty texts stay, and so do all columns."""
    model = model or train(docs, labels, sample)
    (s,) = fresh(docs, "_score")
    return docs.withColumn(s, scored(model)).where(F.col(s) <= limit(model)).drop(s)
