"""Similarity digests made of improbable features.

Every 64-byte window of a text has an entropy, put on a scale of a thousand
steps.  How often each step occurs in the whole corpus ranks them: the rarer,
the more a window says about its text.  In every 64 neighbouring windows the
rarest, the leftmost of equals, gets a point; windows with 16 points or more
are features, and in a text without such the one with most points.  Their hashes set five bits each in a Bloom filter of 256 bytes,
and after 160 features a further filter is chained on.

Two digests are compared filter by filter: the bits that two filters share,
less what chance would give, on a scale from 0 to 100.

All pairs with a common feature are found by grouping on the features.
Features that occur in the same documents are looked at once, each document's
features go once to the place where the sets of a cluster of copies are looked
at, and the documents of a frequent feature are dealt into cells of two
blocks.  A pair is looked at where its least common set is, so pairs themselves
are never sent or sorted, however many there are.  ``matches`` puts them out;
``links`` counts them by document and keeps the best, for which documents with
equal features are looked at as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, cut, mix, pieces, raw

WINDOW, NEAR, POINTS, STEPS = 64, 64, 16, 1000
FILTER, FULL, BITS = 256, 160, 5
#: Windows whose entropy is below this step (runs of one or two bytes) are no features.
DULL = 100
#: Documents of a feature from which on they are dealt into blocks.
SIDE = 4096
#: Digits of the best score after the point.
DIGITS = 6
_SCALE = 1 << 20
_N = np.arange(WINDOW + 2)
_TERM = np.round(np.diff(np.where(_N > 0, _N * np.log2(np.maximum(_N, 1)), 0)) * _SCALE).astype(np.int64)
_TOP = 6 * WINDOW * _SCALE
#: Common bits to be expected by chance of two filters, by their features.
_SET = 1 - (1 - 1 / (FILTER * 8)) ** (BITS * np.arange(FULL + 1))
_CHANCE = FILTER * 8 * _SET[:, None] * _SET


def entropy_steps(data: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Step of every window's entropy, in whole numbers and so the same wherever a text is cut.

    With f(n) = n log n, a window's entropy is 6 - sum f(n_byte) / 64.  Sliding
    by one, the sum changes by what one byte adds with so many equals around it.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for lo in range(0, len(data), block):
        hi = min(len(data), lo + block)
        for d in range(1, WINDOW):
            a = max(lo, d)
            if a < hi:
                same = (data[a:hi] == data[a - d : hi - d]).view(np.uint8)
                before[a:hi] += same
                after[a - d : hi - d] += same
    count = np.bincount(data[:WINDOW], minlength=256)
    start = int(np.concatenate([[0], np.cumsum(_TERM)])[count].sum())
    total = np.empty(n, np.int64)
    total[0] = start
    np.cumsum(_TERM[before[WINDOW:]] - _TERM[after[: n - 1]], out=total[1:])
    total[1:] += start
    return ((_TOP - total) * STEPS // _TOP).clip(0, STEPS).astype(np.int16)


def _owned(off: np.ndarray, n: int, width: int) -> np.ndarray:
    """Whether the window that starts at each of n bytes ends in the same text."""
    end = np.repeat(off[1:], np.diff(off))[:n]
    return np.arange(n) + width <= end


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(STEPS + 1, np.int64)
    for part in pieces(batches, limit=1 << 20):
        data, off = raw(part.column("text"))
        steps = entropy_steps(data)
        total += np.bincount(steps[_owned(off, len(steps), WINDOW)], minlength=STEPS + 1)
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total).astype(np.int32)), pa.array(total[total > 0])], ["step", "n"])


def ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy step by its frequency in all texts, the rarest 0; steps that don't occur come first."""
    total = np.zeros(STEPS + 1, np.int64)
    for step, n in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_tally, "step int, n long").groupBy("step").agg(F.sum("n")).collect():
        total[step] = n
    out = np.empty(STEPS + 1, np.int64)
    out[np.lexsort((np.arange(STEPS + 1), total))] = np.arange(STEPS + 1)
    return out


def features(data: np.ndarray, off: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and 64-bit hash of each feature, in order, once for each text."""
    steps = entropy_steps(data)
    none = np.zeros(0, np.int64)
    if not len(steps):
        return none, none.astype(np.uint64)
    owned = _owned(off, len(steps), WINDOW)
    worth = np.where(steps >= DULL, rank[steps], 2 * STEPS).astype(np.int64)
    key = (worth << 40) | np.arange(len(steps))
    have = 1
    while have < NEAR and len(key) > 1:
        step = min(have, NEAR - have, len(key) - 1)
        key = np.minimum(key[:-step], key[step:])
        have += step
    # neighbours are windows of the same text; texts with fewer than NEAR windows count as one neighbourhood
    full = _owned(off, len(key), WINDOW + NEAR - 1) if have == NEAR else np.zeros(len(key), bool)
    win = key[full]
    at = (win & ((1 << 40) - 1))
    ok = (win >> 40) <= STEPS
    at = at[ok]
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else none
    points = np.diff(np.append(new, len(at)))
    place = at[new]
    chosen = [place[points >= POINTS]] if len(at) else []
    has = np.zeros(len(off) - 1, bool)
    if chosen:
        has[np.searchsorted(off, chosen[0], side="right") - 1] = True
    for i in np.flatnonzero((np.diff(off) >= WINDOW) & ~has):
        lo, hi = np.searchsorted(place, (off[i], off[i + 1]))
        if lo < hi:
            chosen.append(place[[lo + np.lexsort((worth[place[lo:hi]], -points[lo:hi]))[0]]])
            continue
        own = worth[off[i] : off[i + 1] - WINDOW + 1]
        best = int(np.argmin(own))
        if own[best] <= STEPS:
            chosen.append(np.array([off[i] + best]))
    at = np.sort(np.concatenate(chosen)) if chosen else none
    at = at[owned[at]]
    if not len(at):
        return none, none.astype(np.uint64)
    words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at].view("<u8").astype(np.uint64)
    h = np.zeros(len(at), np.uint64)
    for k in range(words.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[:, k] + np.uint64(k + 1))
    text = np.searchsorted(off, at, side="right") - 1
    order = np.lexsort((at, h, text))
    twin = np.append(False, (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1]))
    keep = np.ones(len(at), bool)
    keep[order[twin]] = False
    return text[keep], h[keep]


def filters(text: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each text, its number of filters, and all filters one after the other."""
    count = np.bincount(text, minlength=texts)
    chain = -(-count // FULL)
    base = np.cumsum(chain) - chain
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    which = base[text] + nth // FULL
    bits = np.zeros(int(chain.sum()) * FILTER * 8, np.uint8)
    for k in range(BITS):
        bits[which * (FILTER * 8) + ((h >> np.uint64(11 * k)) & np.uint64(2047)).astype(np.int64)] = 1
    return count, chain, np.packbits(bits)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_features, n_filters, digest) for every row of ``docs``.

    A digest is its filters of 256 bytes in order.  Texts shorter than 64
    bytes, null, or with dull windows only have no feature and an empty
    digest.  Where no window has 16 points, as in texts with fewer than 79
    windows, the one with most points, of equals the rarest, is the only
    feature.  Features of a text count once.  Null ids and repeated rows have
    digests like others; extra columns are ignored.
    """
    rank = ranks(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int32()), ("n_filters", pa.int32()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, limit=1 << 20):
            data, off = raw(part.column("text"))
            count, chain, body = filters(*features(data, off, rank), part.num_rows)
            cuts = np.append(0, np.cumsum(chain * FILTER)).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(body.tobytes())])
            yield batch(schema, part.column("doc_id"), count.astype(np.int32), chain.astype(np.int32), blob)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_features int, n_filters int, digest binary")


def overlap(a: bytes, b: bytes, n_a: int, n_b: int, alpha: float = 0.3) -> float | None:
    """0 to 100: for each filter of the digest with fewer, its best match in the other, on average; None without features."""
    if not a or not b:
        return None
    x, y = (np.frombuffer(s, np.uint8).reshape(-1, FILTER) for s in (a, b))
    if len(x) > len(y) or (len(x) == len(y) and n_a > n_b):
        x, y, n_a, n_b = y, x, n_b, n_a
    sizes = [np.append(np.full(len(z) - 1, FULL), n - FULL * (len(z) - 1)) for z, n in ((x, n_a), (y, n_b))]
    p, q = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    best = []
    for i in range(len(x)):
        e = np.bitwise_count(x[i] & y).sum(axis=1, dtype=np.int64)
        most = np.minimum(p[i], q).astype(float)
        keep = 1 - 1 / (FILTER * 8)
        chance = FILTER * 8 * (1 - keep ** (BITS * sizes[0][i])) * (1 - keep ** (BITS * sizes[1]))
        floor = np.minimum(alpha * (most - chance) + chance, most)
        score = np.where(e > floor, 100 * (e - floor) / np.maximum(most - floor, 1e-9), 0.0)
        best.append(score.max())
    return float(np.mean(best))


def similarity(a: str, b: str, n_a: str, n_b: str) -> Column:
    """Score of two digest columns with their feature counts; null if one is null or empty."""

    def score(x: pa.Array, y: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        size = np.stack([pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in (n, m)]).astype(np.int64)
        has = np.flatnonzero((size > 0).all(axis=0) & pc.and_(pc.is_valid(x), pc.is_valid(y)).to_numpy(zero_copy_only=False))
        out = np.full(len(x), np.nan)
        if len(has):
            some = pa.array(has)
            body = raw(pa.concat_arrays([x.take(some), y.take(some)]))[0].reshape(-1, FILTER)
            own = size[:, has].ravel()
            chain = -(-own // FULL)
            out[has] = scores(np.arange(len(has)), len(has) + np.arange(len(has)), body, np.cumsum(chain) - chain, own)
        return pa.array(out, pa.float64(), from_pandas=True)

    return F.arrow_udf(score, "double")(a, b, n_a, n_b)


def compare(pairs: DataFrame, digests: DataFrame) -> DataFrame:
    """``pairs`` (a, b of doc_ids) with the score of their digests; ids without digest score null."""
    side = lambda c: digests.select(F.col("doc_id").alias(c), F.col("digest").alias(f"digest_{c}"), F.col("n_features").alias(f"n_{c}")).dropDuplicates([c])
    both = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.select("a", "b", similarity("digest_a", "digest_b", "n_a", "n_b").alias("score"))


def _described(docs: DataFrame) -> DataFrame:
    """(doc_id, texts) for each id that has a feature: the features of each of its different texts."""
    rank = ranks(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, limit=1 << 20):
            data, off = raw(part.column("text"))
            text, h = features(data, off, rank)
            count = np.bincount(text, minlength=part.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(h.view(np.int64)))
            has = pa.array(np.flatnonzero(count))
            yield batch(schema, part.column("doc_id").take(has), lists.take(has))

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, features array<long>").groupBy("doc_id").agg(F.array_sort(F.collect_set("features")).alias("texts"))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common bits of filters given as rows of 32 words; 16 bits of a word hold a sum of at most 512."""
    octets = np.bitwise_count(a & b).view(np.uint64)
    low = np.uint64(0x00FF00FF00FF00FF)
    lanes = ((octets & low) + ((octets >> np.uint64(8)) & low)).T
    total = lanes[0] + lanes[1] + lanes[2] + lanes[3]
    return ((total * np.uint64(0x0001000100010001)) >> np.uint64(48)).astype(np.int64)


def _close(e: np.ndarray, p: np.ndarray, q: np.ndarray, n: np.ndarray, m: np.ndarray, alpha: float) -> np.ndarray:
    """Score of filters with ``e`` common bits, from their own bits and features."""
    most = np.minimum(p, q).astype(float)
    chance = _CHANCE[n, m]
    floor = np.minimum(alpha * (most - chance) + chance, most)
    return np.where(e > floor, 100 * (e - floor) / np.maximum(most - floor, 1e-9), 0.0)


def scores(x: np.ndarray, y: np.ndarray, body: np.ndarray, base: np.ndarray, n: np.ndarray, room: int = 1 << 14, alpha: float = 0.3) -> np.ndarray:
    """``overlap`` of digests x[k] and y[k]; digest d has n[d] features and its filters from row base[d] of ``body``."""
    chain = -(-n // FULL)
    swap = (chain[x] > chain[y]) | ((chain[x] == chain[y]) & (n[x] > n[y]))
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    wide = body.view(np.uint64)
    bits = np.bitwise_count(wide).sum(axis=1, dtype=np.int64)
    owner = np.repeat(np.arange(len(n)), chain)
    size = np.minimum(FULL, n[owner] - FULL * (np.arange(len(owner)) - base[owner]))
    out = np.empty(len(x))
    cost = chain[x] * chain[y]
    total = np.cumsum(cost)
    lo = 0
    if len(x) and total[-1] == len(x):  # one filter each, as most texts have
        for lo in range(0, len(x), room >> 2):
            i, j = base[x[lo : lo + (room >> 2)]], base[y[lo : lo + (room >> 2)]]
            out[lo : lo + (room >> 2)] = _close(_common(wide[i], wide[j]), bits[i], bits[j], size[i], size[j], alpha)
        return out
    while lo < len(x):
        if cost[lo] > room:
            d, e = x[lo], y[lo]
            out[lo] = overlap(body[base[d] : base[d] + chain[d]].tobytes(), body[base[e] : base[e] + chain[e]].tobytes(), int(n[d]), int(n[e]), alpha)
            lo += 1
            continue
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + room, side="right")))
        c, d = cost[lo:hi], chain[y[lo:hi]]
        k = np.repeat(np.arange(hi - lo), c)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(c) - c, c)
        i, j = base[x[lo:hi]][k] + nth // d[k], base[y[lo:hi]][k] + nth % d[k]
        score = _close(_common(wide[i], wide[j]), bits[i], bits[j], size[i], size[j], alpha)
        best = np.maximum.reduceat(score, np.flatnonzero(nth % d[k] == 0))
        rows = chain[x[lo:hi]]
        out[lo:hi] = np.add.reduceat(best, np.cumsum(rows) - rows) / rows
        lo = hi
    return out


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists one after the other, and each list's offsets."""
    whole = column.combine_chunks()
    off = whole.offsets.to_numpy().astype(np.int64)
    return whole.values.to_numpy()[off[0] : off[-1]], off - off[0]


def _taken(values: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of ``rows`` one after the other, and for each value the row's place in ``rows``."""
    n = off[rows + 1] - off[rows]
    owner = np.repeat(np.arange(len(rows)), n)
    return values[np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(off[rows], n)], owner


def _marks(sets: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A row of bits for each of n members: which of the sets that two members or more have are its own."""
    ids, which, count = np.unique(sets, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    use = count[which] > 1
    bits = np.zeros((n, -(-int((count > 1).sum()) // 64)), np.uint64)
    at = column[which[use]]
    np.bitwise_or.at(bits, (owner[use], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    return bits


def _met(part: pa.Table, room: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of some places, and their scores.

    A pair that shares several sets is met in the least of them only: each
    member knows all of its sets, wherever those are looked at.
    """
    block, i, j = (part.column(c).to_numpy() for c in ("block", "i", "j"))
    texts = part.column("texts").combine_chunks()
    first = texts.offsets.to_numpy().astype(np.int64)
    lists = texts.values.slice(first[0], first[-1] - first[0])
    first = first - first[0]
    h, h_off = _lists(pa.chunked_array([lists]))
    n = np.diff(h_off)
    body = filters(np.repeat(np.arange(len(n)), n), h.view(np.uint64), len(n))[2].reshape(-1, FILTER)
    base = np.cumsum(-(-n // FULL)) + n // -FULL
    several = np.diff(first) > 1

    def best(x: int, y: int) -> float:
        """Of two ids with several texts, the best score of texts that share a feature."""
        u, v = (c.ravel() for c in np.meshgrid(np.arange(first[x], first[x + 1]), np.arange(first[y], first[y + 1])))
        met = [np.isin(h[h_off[p] : h_off[p + 1]], h[h_off[q] : h_off[q + 1]]).any() for p, q in zip(u, v)]
        return float(scores(u[met], v[met], body, base, n).max())

    every, e_off = _lists(part.column("every"))
    own, o_off = _lists(part.column("own"))
    place = np.cumsum(np.append(False, _differ(part)))
    who = np.repeat(np.arange(part.num_rows), np.diff(o_off))
    order = np.lexsort((who, own, place[who]))
    own, who = own[order], who[order]
    start = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (place[who][1:] != place[who][:-1])))
    for lo, hi in zip(start, np.append(start[1:], len(own))):
        rows = who[lo:hi]
        if len(rows) < 2:
            continue
        sets, owner = _taken(every, e_off, rows)
        less = sets < own[lo]
        bits = _marks(sets[less], owner[less], len(rows))
        after = len(rows) - 1 - np.arange(len(rows))
        total = np.cumsum(after)
        at = 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + room, side="right")))
            c = after[at:end]
            x = np.repeat(np.arange(at, end), c)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c)
            ok = (i[rows[0]] == j[rows[0]]) | (block[rows][x] != block[rows][y])
            for k in range(bits.shape[1]):
                ok &= (bits[x, k] & bits[y, k]) == 0
            x, y = rows[x[ok]], rows[y[ok]]
            if len(x):
                u, v = first[x], first[y]
                score = np.empty(len(x))
                for some in (one := (n[u] <= FULL) & (n[v] <= FULL), ~one):
                    score[some] = scores(u[some], v[some], body, base, n)
                for k in np.flatnonzero(several[x] | several[y]):
                    score[k] = best(x[k], y[k])
                yield x, y, score
            at = end


def _pairs(part: pa.Table) -> Iterator[pa.RecordBatch]:
    """(a, b, score) of each pair."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])
    doc = part.column("doc_id").to_numpy()
    for x, y, score in _met(part):
        yield batch(schema, np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y]), score)


def _counted(part: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each row that has pairs: how many documents it meets, its best score and the least id of those that have it."""
    schema = pa.schema([("doc_id", pa.int64()), ("links", pa.int64()), ("score", pa.float64()), ("nearest", pa.int64())])
    doc, n = (part.column(c).to_numpy() for c in ("doc_id", "n"))
    links = np.zeros(len(doc), np.int64)
    top = np.full(len(doc), -1.0)
    nearest = np.full(len(doc), np.iinfo(np.int64).max)
    for x, y, score in _met(part):
        score = score.round(DIGITS)
        x, y, score = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([score, score])
        np.add.at(links, x, n[y])
        before = top[x]
        np.maximum.at(top, x, score)
        nearest[x[top[x] > before]] = np.iinfo(np.int64).max
        least = score == top[x]
        np.minimum.at(nearest, x[least], doc[y[least]])
    has = np.flatnonzero(links)
    yield batch(schema, doc[has], links[has], top[has], nearest[has])


def _meet(give: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """What ``give`` makes of whole places; rows come sorted by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        for part in batches:
            if not part.num_rows:
                continue
            now = pa.Table.from_batches([*left[-1:], part])
            ends = np.flatnonzero(_differ(now)) + 1 - (left[-1].num_rows if left else 0)
            # the last place may go on in the next batch
            done = int(ends[-1]) if len(ends) else 0
            if len(ends):
                yield from give(pa.Table.from_batches([*left, part.slice(0, done)]))
                left = []
            if done < part.num_rows:
                left.append(part.slice(done))
        if left:
            yield from give(pa.Table.from_batches(left))

    return run


def _differ(rows: pa.Table) -> np.ndarray:
    """Whether each row but the first is of another place than the one before."""
    place = np.stack([rows.column(c).to_numpy() for c in ("label", "m", "i", "j")])
    return (place[:, 1:] != place[:, :-1]).any(axis=0)


def _members(found: DataFrame, side: int) -> DataFrame:
    """A row for each document of ``found`` (doc_id, texts, n) at each place where a set of its features is looked at.

    Features with the same documents are one set.  A set is looked at in one
    place, or, if it has more than ``side`` documents, in one for each two of
    its blocks.  A set's place is named after the largest set like it of one of
    its documents, so that sets of one cluster of copies meet in one place
    and a document's features are sent there once for all of them.
    """
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy("h")
    rows = found.select("doc_id", F.explode(F.array_distinct(F.flatten("texts"))).alias("h")).repartition(parts, "h")
    shared = rows.select("doc_id", F.count("*").over(w).alias("k"), F.bit_xor(F.xxhash64("doc_id")).over(w).alias("x")).where("k > 1")
    sets = shared.repartition(parts, "doc_id").groupBy("doc_id", "k", "x").agg(F.lit(1).alias("_")).drop("_")
    sets = sets.withColumn("m", F.when(F.col("k") <= side, 1).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(F.col("k") / side)))).cast("long"))
    sets = sets.withColumn("top", F.max(F.struct("k", "x")).over(Window.partitionBy("doc_id", "m")))
    label = F.min_by(F.xxhash64("top"), F.xxhash64(F.lit(3), "doc_id")).over(Window.partitionBy("k", "x"))
    named = sets.withColumn("label", label).withColumn("block", F.pmod(F.xxhash64(F.lit(2), "doc_id"), "m"))
    named = named.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    named = named.select("doc_id", "x", "label", "m", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    place = ["label", "m", "i", "j"]
    own = named.repartition(parts, "doc_id").groupBy("doc_id", "block", *place).agg(F.collect_list("x").alias("own"))
    every = sets.groupBy("doc_id").agg(F.collect_list("x").alias("every"))
    members = own.join(every, "doc_id").join(found, "doc_id").repartition(parts, *place).sortWithinPartitions(*place)
    return members.select(*place, "doc_id", "n", "block", "own", "every", "texts")


def matches(docs: DataFrame, side: int = SIDE) -> DataFrame:
    """(a, b, score), a < b, for every two documents that share a feature; the score is that of ``overlap``, 0 included.

    Rows without id or feature have no pair, and no documents give none.  Rows
    with one id are one document; if their texts differ, its best score counts.
    Texts are read whole; ties don't matter, as every pair is scored.  Extra
    columns are ignored.  There are as many rows as pairs, which grow with the
    square of the documents that have a passage in common.
    """
    found = cut(_described(docs)).withColumn("n", F.lit(1).cast("long"))
    return _members(found, side).mapInArrow(_meet(_pairs), "a long, b long, score double")


def links(docs: DataFrame, side: int = SIDE) -> DataFrame:
    """(doc_id, class_id, n_links, nearest, score): one row for each id, whatever it shares.

    Two documents are linked if they share a feature, as in ``matches``.
    ``n_links`` counts all other documents that one is linked to; ``score`` is
    the best of their scores, to ``DIGITS`` digits, and ``nearest`` the least
    id that has it.  Both are null without a link.  Documents with the same
    features in the same order, and so the same digest, are one class, named
    by its least id; a document without features is one by itself.  Every pair
    of classes with a common feature is scored, once for all of their documents.

    Rows without id are left out; rows with one id are one document, with the
    features of each of its texts, and its best score counts.  Texts are read
    whole, extra columns are ignored, and no documents give no rows.
    """
    found = cut(_described(docs))
    same = Window.partitionBy("s", "t").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hashed = found.select("doc_id", F.xxhash64("texts").alias("s"), F.xxhash64(F.lit(4), "texts").alias("t"))
    classed = cut(hashed.select("doc_id", F.first("doc_id").over(same).alias("class_id"), F.nth_value("doc_id", 2).over(same).alias("second"), F.count("*").over(same).alias("n")))
    heads = found.join(classed.where("doc_id = class_id").select("doc_id", "n"), "doc_id")
    # of equal scores the least id: the greatest complement
    best = lambda score, who: F.struct(score.alias("score"), F.bitwise_not(who).alias("least"))
    met = _members(heads, side).mapInArrow(_meet(_counted), "doc_id long, links long, score double, nearest long")
    met = met.groupBy(F.col("doc_id").alias("class_id")).agg(F.sum("links").alias("links"), F.max(best(F.col("score"), F.col("nearest"))).alias("other"))
    copy = F.when(F.col("n") > 1, best(F.lit(100.0), F.when(F.col("doc_id") == F.col("class_id"), F.col("second")).otherwise(F.col("class_id"))))
    of_class = classed.join(met, "class_id", "left").select("doc_id", "class_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.greatest(copy, "other").alias("best"))
    ids = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = ids.join(of_class, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.bitwise_not("best.least").alias("nearest"), "best.score")
