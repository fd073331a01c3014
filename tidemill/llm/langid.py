"""Language identification by sparse logistic regression on character n-grams.

Runs of one to three characters of the lower-cased text are hashed into
buckets.  A text's value for a bucket is its share of the text's n-grams times
the bucket's inverse document frequency, counted over all documents.  One
weight for each bucket and language is learned by following the regularised
leader, example by example, with absolute and squared penalties that leave
most weights at nothing.  A temperature, chosen on documents held out, turns
scores into honest probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, pieces, raw

BITS, ORDERS = 16, (1, 2, 3)
NONE = 1 << BITS
#: Documents of each language that are sampled at most, by a hash of their rows.
SAMPLE = 400
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.5, 1.0, 0.002, 0.01, 3, 20.0
UNKNOWN = "und"


def grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket of the n-gram that starts at each character, NONE if it runs over the end; offsets."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    data, _ = raw(low)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    off = np.append(0, np.cumsum(pc.utf8_length(low).to_numpy(zero_copy_only=False))).astype(np.int64)
    out = []
    for n in ORDERS:
        h = np.full(len(cp), (0x9E3779B1 * n) & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h[: len(cp) - j] = (h[: len(cp) - j] ^ cp[j:]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        b = ((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)).astype(np.int32)
        for j in range(1, n):
            ends = off[1:] - j
            b[ends[ends >= off[:-1]]] = NONE
        out.append(b)
    return out, off


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of this task in which each bucket occurs; the row for NONE counts the documents."""
    total = np.zeros(NONE + 1, np.int64)
    some = np.zeros(NONE + 1, np.uint8)
    seen = np.zeros(NONE + 1, np.uint8)
    pending = 0
    for part in pieces(batches, limit=1 << 20):
        orders, off = grams(part.column("text"))
        for lo, hi in zip(off[:-1], off[1:]):
            if lo == hi:
                continue
            seen[:] = 0
            for b in orders:
                seen[b[lo:hi]] = 1
            seen[NONE] = 1
            some += seen
            pending += 1
            if pending == 255:
                total += some
                some[:] = 0
                pending = 0
    total += some
    has = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], ["bucket", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Over all documents with text; one number for each of the fixed buckets comes to the driver."""
    n = np.zeros(NONE + 1, np.int64)
    for b, c in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).toLocalIterator():
        n[b] = c
    return np.log((1 + n[NONE]) / (1 + n[:NONE])) + 1


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    temperature: float

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores and number of n-grams of each text."""
        orders, off = grams(texts)
        n, k = len(off) - 1, len(self.languages)
        out, count = np.zeros((n, k)), np.zeros(n)
        has = np.flatnonzero(np.diff(off))
        if len(has):
            for b in orders:
                out[has] += np.add.reduceat(self.weights[b], off[:-1][has], axis=0)
                count[has] += np.add.reduceat((b != NONE).astype(np.int64), off[:-1][has])
        return SCALE * out / np.maximum(count, 1)[:, None], count


def _vectors(texts: pa.Array, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    orders, off = grams(texts)
    out = []
    for lo, hi in zip(off[:-1], off[1:]):
        b = np.concatenate([o[lo:hi] for o in orders])
        ids, n = np.unique(b[b != NONE], return_counts=True)
        out.append((ids, SCALE * n / max(1, n.sum()) * idf[ids]))
    return out


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, seed: int = 1) -> np.ndarray:
    """Weights (bucket, class) after ``EPOCHS`` over the rows in seeded order."""
    z, n = np.zeros((NONE, classes)), np.zeros((NONE, classes))
    weight = lambda z, n: np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    r = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in r.permutation(len(rows)):
            ids, x = rows[i]
            if not len(ids):
                continue
            w = weight(z[ids], n[ids])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p
            root = np.sqrt(n[ids])
            z[ids] += g - (np.sqrt(n[ids] + g * g) - root) / ALPHA * w
            n[ids] += g * g
    return weight(z, n)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, from a fixed grid."""
    best, least = 1.0, np.inf
    for t in np.exp(np.linspace(np.log(0.02), np.log(20), 121)):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        loss = -(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean()
        if loss < least - 1e-12:
            best, least = float(t), loss
    return best


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents of each value of lang; every fifth is held out for the temperature."""
    idf = inverse_frequencies(docs)
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("order"))
    # the limit holds for each language, so this is small enough to broadcast whatever the corpus holds
    chosen = rows.select("lang", "order").withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).where(F.col("nth") <= sample).select("lang", "order").distinct()
    got = sorted(rows.join(F.broadcast(chosen), ["lang", "order"]).dropDuplicates(["lang", "order"]).collect(), key=lambda r: (r["order"], r["lang"]))
    languages = sorted({r["lang"] for r in got})
    if not languages:
        return Model([], np.zeros((NONE + 1, 0), np.float32), 1.0)
    y = np.array([languages.index(r["lang"]) for r in got])
    texts = pa.array([r["text"] for r in got], pa.string())
    held = np.arange(len(got)) % 5 == 4
    fit = np.flatnonzero(~held)
    w = follow_leader(_vectors(texts.take(pa.array(fit)), idf), y[fit], len(languages))
    model = Model(languages, np.vstack([w * idf[:, None], np.zeros((1, len(languages)))]).astype(np.float32), 1.0)
    if held.any():
        logits, _ = model.logits(texts.take(pa.array(np.flatnonzero(held))))
        model.temperature = calibrate(logits, y[held])
    return model


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, lang, predicted, confidence) for every row of ``docs``; whole texts are read.

    Null and empty texts are 'und' with confidence 0, as is everything if no
    document has a language.  A null lang is predicted like any other.  Of
    equal scores the language first in the alphabet wins.  An empty table
    gives no rows.  Null ids and repeated rows are scored like others; extra
    columns are ignored, whatever their names.
    """
    model = train(docs, sample)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("predicted", pa.string()), ("confidence", pa.float64())])
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, limit=1 << 20):
            best, sure = np.full(part.num_rows, len(names) - 1), np.zeros(part.num_rows)
            if len(names) > 1:
                logits, count = model.logits(part.column("text"))
                s = logits / model.temperature
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = np.where(count > 0, p.argmax(axis=1), len(names) - 1)
                sure = np.where(count > 0, p.max(axis=1), 0.0)
            yield batch(schema, part.column("doc_id"), part.column("lang"), pa.array(names[best], pa.string()), sure)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang string, predicted string, confidence double")
