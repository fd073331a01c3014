"""Near duplicates by SimHash, found through covering hash tables.

A document's fingerprint has 96 bits: for each bit the signs given by the
hashes of all its words are added up, each occurrence.  A longer word counts
by itself; a shorter one, as such are common to all texts of a language, with
the word before it.  In texts with many longer words these count up to three
times, in others all words count alike.  The bits form
two halves of 48.  Each half has 2**(r+1)-1 tables, one for each non-zero
vector v of r+1 bits: every bit position i has a fixed random vector m(i), and
the table's mask holds the positions with odd <m(i), v>.  Positions in which
two halves differ, r at most, span no more than r dimensions, so some v is
orthogonal to all of them and that table's key is equal.  Two fingerprints
within 2r+1 bits differ in at most r bits in one half: every such pair meets
in a table, whatever the data are.

Keys keep about 24 bits of a half; that suits some 10**7 to 10**8 distinct
fingerprints, beyond which ``HALF`` should grow with the logarithm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, cut, fresh, hashes, mix, normal, pieces, word_codes

HALF = 48
#: Radius within a half; the radius of the whole fingerprint is 2 * REACH + 1 = 13.
REACH = 6
#: Rows of the tables that a task holds, on average.
ROWS = 1 << 21
#: Words shorter than this count together with the word before them.
LONG_WORD = 5
#: Texts with so many longer words count each of these once more.
MANY_LONG = (8, 24)
_SPREAD = np.array([int.from_bytes(bytes((v >> b) & 1 for b in range(8)), "little") for v in range(256)], np.uint64)


def masks(reach: int = REACH, half: int = HALF, seed: int = 4206) -> np.ndarray:
    """One mask for each table of a half.

    With this seed the smallest mask has 19 positions; the more, the fewer chance meetings.
    """
    vectors = np.random.default_rng(seed).integers(0, 1 << (reach + 1), half)
    return np.array([sum(1 << i for i, m in enumerate(vectors) if bin(int(m) & v).count("1") & 1) for v in range(1, 1 << (reach + 1))], np.int64)


def signs(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the 96 majority bits of its words' hashes, as two columns."""
    n = len(first) - 1
    both = np.empty((len(h), 2), np.uint64)
    both[:, 0] = h
    both[:, 1] = mix(h ^ np.uint64(0x9E3779B97F4A7C15))
    octets = both.view(np.uint8).reshape(len(h), 16)[:, [0, 1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 13]]
    total = np.zeros((n, 12, 8), np.int64)
    count = np.diff(first)
    # eight counters of one byte share a word of 64 bits: runs of at most 255 words can't overflow
    runs = -(-count // 255)
    text = np.repeat(np.arange(n), runs)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    begin = first[:-1][text] + nth * 255
    step = 1 << 12
    for lo in range(0, len(begin), step):
        b = begin[lo : lo + step]
        end = int(begin[lo + step]) if lo + step < len(begin) else len(h)
        sums = np.add.reduceat(_SPREAD[octets[b[0] : end]], b - b[0], axis=0)
        np.add.at(total, text[lo : lo + step], sums.view(np.uint8).reshape(len(b), 12, 8))
    bits = (2 * total > count[:, None, None]).reshape(n, 2, HALF)
    return (bits * (np.int64(1) << np.arange(HALF, dtype=np.int64))).sum(axis=2)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    for part in pieces(batches):
        values, codes, first, _ = word_codes(part.column("text"))
        plain = normal(values)
        size = pc.utf8_length(plain).to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(part.num_rows), np.diff(first))
        lengths = size[codes] if len(codes) else codes
        keep = lengths > 0
        if not keep.any():
            continue
        text, long = text[keep], lengths[keep] >= LONG_WORD
        h = hashes(plain)[codes[keep]]
        before = np.append(np.uint64(0), np.where(text[1:] == text[:-1], h[:-1], np.uint64(0)))
        h = np.where(long, h, mix(h * np.uint64(0x9E3779B97F4A7C15) + before))
        many = np.bincount(text[long], minlength=part.num_rows)
        times = np.where(long, 1 + np.searchsorted(MANY_LONG, many, side="right")[text], 1)
        count = np.bincount(np.repeat(text, times), minlength=part.num_rows)
        ab = signs(np.repeat(h, times), np.append(0, np.cumsum(count)))
        has = np.flatnonzero(count)
        yield batch(schema, part.column("doc_id").cast(pa.int64()).take(pa.array(has)), ab[has, 0], ab[has, 1])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b) for each row with an id and at least one word; a and b have 48 bits each."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_prints, "doc_id long, a long, b long")


def distance(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ c).astype(np.int16) + np.bitwise_count(b ^ d)


def links(first: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, room: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within ``radius`` that join each bucket as all its close pairs would.

    Every member is compared with the bucket's first; those that are close to
    it are joined by that pair.  Each other member is compared with the whole
    bucket, so no close pair between unjoined members is missed.
    """
    owner = np.repeat(np.arange(len(first)), size)
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + first[owner]
    lead = first[owner]
    near = distance(a[pos], b[pos], a[lead], b[lead]) <= radius
    yield lead[near & (pos != lead)], pos[near & (pos != lead)]
    rest = np.flatnonzero(~near)
    cost = np.cumsum(size[owner[rest]])
    lo = 0
    while lo < len(rest):
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + room)))
        who = rest[lo:hi]
        n = size[owner[who]]
        x = np.repeat(pos[who], n)
        y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[owner[who]], n)
        close = (distance(a[x], b[x], a[y], b[y]) <= radius) & (x != y)
        yield x[close], y[close]
        lo = hi


def _edges(reach: int):
    table_masks = np.concatenate([masks(reach)] * 2)
    per_half = len(table_masks) // 2
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "c", "d")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(p.column(0).to_numpy(), p.column(1).to_numpy()) for p in batches if p.num_rows]
        if not parts:
            return
        ta = np.concatenate([p[0] for p in parts])
        b = np.concatenate([p[1] for p in parts])
        del parts
        t = ta >> HALF
        a = ta & ((1 << HALF) - 1)
        masked = np.where(t < per_half, a, b) & table_masks[t]
        key = (t << HALF) | masked
        order = np.argsort(key, kind="stable")
        key, a, b = key[order], a[order], b[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        many = size > 1
        for x, y in links(first[many], size[many], a, b, 2 * reach + 1):
            swap = (a[x] > a[y]) | ((a[x] == a[y]) & (b[x] > b[y]))
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            found = np.unique(np.stack([a[x], b[x], a[y], b[y]], axis=1), axis=0) if len(x) else np.zeros((0, 4), np.int64)
            if len(found):
                yield batch(schema, *(np.ascontiguousarray(c) for c in found.T))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node that has an edge, with the least node of its component.

    Alternating large and small stars; each round is checkpointed, and rounds
    end when one changes nothing.
    """
    edges = cut(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct())
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        w = Window.partitionBy("u")
        large = both.withColumn("m", F.least(F.col("u"), F.min("v").over(w))).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.distinct().select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
        least = down.withColumn("m", F.min("v").over(w))
        small = least.select("v", "m").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return edges
        last = state


def near_groups(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Documents in groups of near duplicates: (doc_id, group_id), both of every group.

    Two documents are joined if their fingerprints differ in at most
    2 * reach + 1 of 96 bits; a group is a connected component and its id the
    least doc_id in it.  Documents alone in their group have no row, nor do rows
    with null id, null text or no word at all.  Rows with the same id are one
    document: the row appears once, in the least group if their texts differ.
    Ties don't matter, as groups don't depend on any order.  Texts are read
    whole; extra columns are ignored, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    prints = cut(fingerprints(docs))
    node = F.struct("a", "b")
    tables = np.concatenate([masks(reach)] * 2)
    # a task holds its rows, so there are more tasks if there are more fingerprints
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-prints.count() * len(tables) // ROWS))
    # each of these rows becomes hundreds, so its partitions mustn't be joined for being small
    distinct = prints.select("a", "b").repartition(parts, "a", "b").distinct()
    lookup = F.array(*[F.lit(int(m)) for m in tables])
    rows = distinct.select(F.explode(F.array(*[F.lit(t << HALF) for t in range(len(tables))])).alias("t"), "a", "b").select(F.col("t").bitwiseOR(F.col("a")).alias("ta"), "b")
    t = F.shiftright("ta", HALF)
    key = F.xxhash64(t, F.when(t < len(tables) // 2, F.col("ta").bitwiseAND((1 << HALF) - 1)).otherwise(F.col("b")).bitwiseAND(F.element_at(lookup, t.cast("int") + 1)))
    # the key only places rows; it is computed again on arrival and so not sent
    buckets = rows.repartition(parts, key)
    pairs = buckets.mapInArrow(_edges(reach), "a long, b long, c long, d long")
    edges = pairs.select(F.struct(F.col("c").alias("a"), F.col("d").alias("b")).alias("u"), F.struct("a", "b").alias("v"))
    labels = components(edges)
    labelled = prints.select("doc_id", node.alias("u")).join(labels, "u", "left").select("doc_id", F.coalesce("v", "u").alias("v"))
    least = labelled.groupBy("v").agg(F.min("doc_id").alias("group_id"), F.max("doc_id").alias("_most")).where("_most > group_id")
    return labelled.join(least, "v").groupBy("doc_id").agg(F.min("group_id").alias("group_id"))


def drop_near(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the least doc_id.

    Rows without id, text or words stay, as do all documents outside groups;
    rows of one id stay or go together.  All columns are kept.
    """
    (gone,) = fresh(docs, "_gone")
    later = near_groups(docs, reach).where("doc_id <> group_id").select(F.col("doc_id").alias(gone))
    return docs.join(later.hint("shuffle_hash"), docs["doc_id"].cast("long") == later[gone], "left_anti")
