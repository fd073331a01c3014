"""Passages that repeat anywhere in the corpus, by a distributed sparse suffix sort.

A passage is any run of ``LENGTH`` words that occurs at two places or more.
Suffixes are compared as strings of words after a first symbol that names the
suffix's first ``GRAM`` words by a 64-bit hash, so that equal symbols mean
equal words.

Not every suffix is needed.  Of the LENGTH - GRAM + 1 grams in a run of LENGTH
words the one with the least hash (the first, if several) is the run's anchor.
Equal runs have equal anchors at equal places, so it is enough to sort the
suffixes that start at anchors, each knowing the words before it from which
runs are anchored there.  Anchors whose gram occurs once are dropped before
that: their runs can't repeat.

Each task sorts its suffixes into one run for each range of the first symbol
and front-codes it: what a suffix shares with the one before it isn't sent.
The receiving task merges the runs with a tree of losers that knows how much
each candidate shares with the last suffix put out, and so compares symbols
only beyond what is shared.  The shared lengths it puts out give, for each
number of words before the anchor, the groups of suffixes with equal runs.

Suffixes that are equal, with equal words before them too, are copies: the
first place of such and one other are enough to tell what repeats, so the
rest are put out at once, by the task that sorts or by the one that merges,
and what a task holds doesn't grow with the number of copies.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, hashes, mix, pieces, word_codes

LENGTH = 50
GRAM = 26
_ODD = 0x9E3779B97F4A7C15
_SPANS = np.dtype([("doc_id", "i8"), ("t", "i8"), ("lo", "i4"), ("hi", "i4")])


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, by prefix sums of a polynomial modulo 2**64."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up = np.cumprod(np.full(len(codes), _ODD, np.uint64))
    down = np.cumprod(np.full(len(codes), pow(_ODD, -1, 1 << 64), np.uint64))
    prefix = np.append(np.uint64(0), np.cumsum(codes * down, dtype=np.uint64))
    return mix((prefix[k:] - prefix[:-k]) * up[:n])


def anchors(codes: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, hash, and the least and most words before it, of each anchor in texts laid one after the other."""
    none = np.zeros(0, np.int64)
    n = len(codes) - length + 1
    if n <= 0:
        return none, none.astype(np.uint64), none, none
    h = grams(codes, gram)
    window = length - gram + 1
    best = np.arange(len(h))
    have = 1
    while have < window:
        step = min(have, window - have)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(h[b] < h[a], b, a)
        have += step
    text = np.searchsorted(first, np.arange(n), side="right") - 1
    start = np.flatnonzero(np.arange(n) + length <= first[text + 1])
    if not len(start):
        return none, none.astype(np.uint64), none, none
    at = best[start]
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (text[start][1:] != text[start][:-1])))
    last = np.append(new[1:], len(at)) - 1
    return at[new], h[at[new]], at[new] - start[last], at[new] - start[new]


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word as written, and each text's first word."""
    values, codes, first, _ = word_codes(texts)
    return hashes(pc.utf8_trim_whitespace(values))[codes] if len(codes) else np.zeros(0, np.uint64), first


def _find(length: int, gram: int):
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("h", pa.list_(pa.int64())), ("x", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            codes, first = coded(part.column("text"))
            at, h, _, _ = anchors(codes, first, length, gram)
            text = np.searchsorted(first, at, side="right") - 1
            cuts = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            has = np.flatnonzero(np.diff(cuts))
            off = pa.array(np.append(cuts[has], cuts[-1]).astype(np.int32))
            take = pa.array(has)
            yield batch(schema, part.column("doc_id").take(take), part.column("t").take(take), pa.ListArray.from_arrays(off, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(off, pa.array((at - first[text]).astype(np.int32))))

    return run


def front_code(keys: list[bytes], heads: list[bytes]) -> bytes:
    """A sorted run: for each suffix what it shares with the one before (in symbols of 4 bytes), the rest, and its head."""
    out, last = [], b""
    for key, head in zip(keys, heads):
        n = shared(last, key, 0)
        rest = key[4 * n :]
        out.append(bytes((n, len(rest) // 4, len(head) // 4)) + rest + head)
        last = key
    return b"".join(out)


def shared(a: bytes, b: bytes, known: int) -> int:
    """Symbols that a and b share, of which ``known`` are known to be."""
    n = min(len(a), len(b)) // 4
    lo = known
    if a[4 * lo : 4 * n] == b[4 * lo : 4 * n]:
        return n
    step = 1
    while a[4 * lo : 4 * (lo + step)] == b[4 * lo : 4 * (lo + step)]:
        lo += step
        step *= 2
    hi = lo + step
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[4 * lo : 4 * mid] == b[4 * lo : 4 * mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _read(run: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    at, last, size = 0, b"", len(run)
    while at < size:
        n, rest, head = run[at], 4 * run[at + 1], 4 * run[at + 2]
        at += 3
        last = last[: 4 * n] + run[at : at + rest]
        at += rest
        yield n, last, run[at : at + head]
        at += head


def merge(runs: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """(shared with the one before, suffix, head) of all runs in order.

    A node of the tree holds the loser of its match with what it shares with
    its winner.  Of two candidates the one that shares more with the last
    suffix put out is the lesser; only if they share as much are their symbols
    compared, from there on.
    """
    k = len(runs)
    if k == 1:
        yield from _read(runs[0])
        return
    readers = [_read(r) for r in runs]
    now = [next(r, None) for r in readers]
    lcp = [0 if c is not None else -1 for c in now]
    keys = [c[1] if c is not None else b"" for c in now]
    tree = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's lcp becomes what it shares with the winner."""
        x, y = lcp[a], lcp[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        p, q = keys[a], keys[b]
        n = shared(p, q, x)
        if p[4 * n :] <= q[4 * n :]:
            lcp[b] = n
            return a, b
        lcp[a] = n
        return b, a

    winner = -1
    for i in range(k):  # each enters at its leaf and waits at the first free node
        node, cand = (i + k) // 2, i
        while node:
            if tree[node] < 0:
                tree[node] = cand
                cand = -1
                break
            cand, tree[node] = play(tree[node], cand)
            node //= 2
        if cand >= 0:
            winner = cand
    while lcp[winner] >= 0:
        yield lcp[winner], keys[winner], now[winner][2]
        nxt = next(readers[winner], None)
        if nxt is None:
            lcp[winner], keys[winner] = -1, b""
        else:
            now[winner], lcp[winner], keys[winner] = nxt, nxt[0], nxt[1]
        cand, node = winner, (winner + k) // 2
        while node:
            other = tree[node]
            x, y = lcp[cand], lcp[other]
            if x < y:
                tree[node], cand = cand, other
            elif x == y and x >= 0:
                cand, tree[node] = play(other, cand)
            node //= 2
        winner = cand


def place(head: bytes) -> tuple[int, int, int]:
    """doc_id, text hash and position of a suffix, in the order in which one is the first."""
    return struct.unpack_from("=qqI", head)


def span(head: bytes, length: int) -> bytes:
    """The words of all runs that a suffix's anchor has, for one that isn't the first of its like."""
    doc, t, at = struct.unpack_from("=qqI", head)
    (least,) = struct.unpack_from("=I", head, 20)
    return struct.pack("=qqii", doc, t, at - (len(head) - 24) // 4, at - least + length)


def _runs(length: int, gram: int, ranges: int, room: int = 48 << 20):
    """Sorted, front-coded runs of a task's suffixes, a row for each range; a full task starts new ones."""
    schema = pa.schema([("part", pa.int32()), ("run", pa.binary()), ("copies", pa.bool_())])
    tail = length - gram

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        keys, heads = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        keys = keys.astype(">u4")  # joining has made it the machine's order, in which bytes don't sort as numbers do
        before, who = (np.concatenate([x[i] for x in held]) for i in (2, 3))
        order = np.argsort(keys.view(f"S{keys.shape[1] * 4}").ravel(), kind="stable")
        top = keys[order, 0].astype(np.uint64)
        part = (top * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
        cuts = np.searchsorted(part, np.arange(ranges + 1))
        raw_keys, raw_heads, size = keys.tobytes(), heads.tobytes(), keys.shape[1] * 4
        hsize = heads.shape[1] * 4
        for p in range(ranges):
            own = order[cuts[p] : cuts[p + 1]]
            if not len(own):
                continue
            k: list[bytes] = []
            hd: list[bytes] = []
            copies: list[bytes] = []
            seen: dict[bytes, list[int]] = {}
            for i in own.tolist():
                key = raw_keys[size * i : size * (i + 1)]
                head = who[i].tobytes() + raw_heads[hsize * (i + 1) - 4 * int(before[i]) : hsize * (i + 1)]
                if k and key != k[-1]:
                    seen = {}
                have = seen.setdefault(head[20:], [])
                if any(hd[j][:20] == head[:20] for j in have):
                    continue
                if len(have) == 2:
                    j = have[0]
                    if place(head) < place(hd[j]):
                        head, hd[j] = hd[j], head
                    copies.append(span(head, length))
                    continue
                if have and place(head) < place(hd[have[0]]):
                    hd[have[0]], head = head, hd[have[0]]
                have.append(len(hd))
                k.append(key)
                hd.append(head)
            yield batch(schema, np.array([p], np.int32), pa.array([front_code(k, hd)], pa.binary()), [False])
            if copies:
                yield batch(schema, np.array([p], np.int32), pa.array([b"".join(copies)], pa.binary()), [True])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in pieces(batches):
            codes, first = coded(rows.column("text"))
            at, h, least, most = anchors(codes, first, length, gram)
            text = np.searchsorted(first, at, side="right") - 1
            wanted = rows.column("x")
            woff = wanted.offsets.to_numpy().astype(np.int64)
            pos = wanted.values.to_numpy()[woff[0] : woff[-1]].astype(np.int64)
            live = np.isin(at, pos + np.repeat(first[:-1], np.diff(woff)))
            at, h, least, most, text = at[live], h[live], least[live], most[live], text[live]
            if not len(at):
                continue
            small = np.concatenate([np.zeros(tail, np.uint32), (codes >> np.uint64(32)).astype(np.uint32), np.zeros(length, np.uint32)])
            key = np.empty((len(at), 2 + tail), ">u4")
            # anchors have small hashes, being the least of many; mixed again they fill all ranges alike
            name = mix(h)
            key[:, 0], key[:, 1] = name >> np.uint64(32), name & np.uint64(0xFFFFFFFF)
            key[:, 2:] = small[tail + at[:, None] + gram + np.arange(tail)]
            # beyond the text's end nothing may look equal
            beyond = at[:, None] + gram + np.arange(tail) >= first[text + 1][:, None]
            key[:, 2:][beyond] = 0
            who = np.empty((len(at), 6), np.uint32)
            ids, t = rows.column("doc_id").to_numpy()[text], rows.column("t").to_numpy()[text]
            who[:, 0:2] = ids.astype(np.int64).view(np.uint32).reshape(-1, 2)
            who[:, 2:4] = t.view(np.uint32).reshape(-1, 2)
            who[:, 4] = (at - first[text]).astype(np.uint32)
            who[:, 5] = least
            heads = small[at[:, None] + np.arange(tail)]
            held.append((key, heads, most, who))
            size += len(at) * (4 * (2 + tail) + 4 * tail + 32)
            if size > room:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _repeats(length: int, gram: int):
    """Merges the runs of a range; puts out (doc_id, t, lo, hi, later) for word ranges that repeat.

    Of suffixes with equal words on both sides one is held, whatever their number.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("later", pa.bool_())])
    tail = length - gram

    def later(spans: bytes) -> pa.RecordBatch:
        x = np.frombuffer(spans, _SPANS)
        return batch(schema, *(np.ascontiguousarray(x[c]) for c in _SPANS.names), np.ones(len(x), bool))

    def groups(rows: Iterator[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        """What is found among suffixes whose first symbol is shared, 4096 or more at once if groups are small."""
        lcps, most, many, heads, copies = array("B"), array("B"), bytearray(), bytearray(), bytearray()
        seen: dict[bytes, int] = {}
        for n, _, head in rows:
            if n < 2 + tail:
                seen = {}
                if n < 2 and len(lcps) >= 4096:
                    if (b := found(lcps, most, many, heads)) is not None:
                        yield b
                    lcps, most, many, heads = array("B"), array("B"), bytearray(), bytearray()
            k = seen.setdefault(head[20:], len(lcps))
            if k == len(lcps):
                lcps.append(n)
                most.append(len(head) // 4 - 6)
                many.append(0)
                heads += head[:24] + head[24:].rjust(4 * tail, b"\0")
                continue
            at = 4 * (6 + tail) * k
            first = bytes(heads[at : at + 20])
            if first == head[:20]:
                continue
            many[k] = 1
            if place(head) < place(first):
                heads[at : at + 20] = head[:20]
                head = first + head[20:]
            copies += span(head, length)
            if len(copies) >= 1 << 18:
                yield later(bytes(copies))
                copies = bytearray()
        if copies:
            yield later(bytes(copies))
        if lcps and (b := found(lcps, most, many, heads)) is not None:
            yield b

    def found(lcps: array, most_: array, many_: bytearray, heads: bytearray) -> pa.RecordBatch | None:
        lcp, most, many = (np.frombuffer(x, np.uint8) for x in (lcps, most_, many_))
        table = np.frombuffer(heads, np.uint32).reshape(-1, 6 + tail)
        least, left = table[:, 5], table[:, 6:]
        doc, t = (np.ascontiguousarray(table[:, c : c + 2]).view(np.int64).ravel() for c in (0, 2))
        at = table[:, 4].astype(np.int64)
        # for each number of words before the anchor: 1 for the first of several places, 2 for the others
        state = np.zeros((len(lcp), tail + 3), np.uint8)
        back = np.zeros(len(lcp), np.uint64)
        for o in range(tail + 1):
            if o:
                back = mix(back * np.uint64(31) + left[:, tail - o] + np.uint64(o))
            use = np.flatnonzero((least <= o) & (o <= most))
            if not len(use):
                continue
            # runs are equal if the words from the anchor on are, up to the run's end, and those before it
            group = np.cumsum(lcp < 2 + tail - o)[use]
            u = use[np.lexsort((at[use], t[use], doc[use], back[use], group))]
            g = np.cumsum(lcp < 2 + tail - o)[u]
            start = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (back[u][1:] != back[u][:-1])))
            size = np.diff(np.append(start, len(u)))
            hit = np.repeat((size > 1) | np.logical_or.reduceat(many[u] > 0, start), size)
            kind = np.full(len(u), 2, np.uint8)
            kind[start] = 1
            state[u[hit], o + 1] = kind[hit]
        out = []
        for lo in range(0, len(lcp), 1 << 15):
            some = state[lo : lo + (1 << 15)]
            edge = some[:, 1:] != some[:, :-1]
            row, begin = np.nonzero(edge & (some[:, 1:] > 0))
            _, end = np.nonzero(edge & (some[:, :-1] > 0))
            out.append((lo + row, begin, end, some[row, begin + 1] == 2))
        row, begin, end, again = (np.concatenate(x) for x in zip(*out))
        if not len(row):
            return None
        return batch(schema, doc[row], t[row], (at[row] - end + 1).astype(np.int32), (at[row] - begin + length).astype(np.int32), again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, list[bytes]] = {}
        for rows in batches:
            for p, r, copies in zip(*(rows.column(c).to_pylist() for c in range(3))):
                if copies:
                    yield later(r)
                else:
                    ranges.setdefault(p, []).append(r)
        for p in sorted(ranges):
            yield from groups(merge(ranges.pop(p)))

    return run


def union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that overlap or touch, joined."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
    return lo[new], hi[np.append(new[1:], len(lo)) - 1]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("later", pa.bool_())])
    for rows in batches:
        out = []
        for doc, lo, hi, later in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "lo", "hi", "later"))):
            a, b, w = np.array(lo), np.array(hi), np.array(later)
            cut_lo, cut_hi = union(a[w], b[w]) if w.any() else (a[:0], b[:0])
            all_lo, all_hi = union(a, b)
            out += [(doc, x, y, True) for x, y in zip(cut_lo.tolist(), cut_hi.tolist())]
            # what is covered by first occurrences only
            edge = np.concatenate([all_lo, all_hi, cut_lo, cut_hi])
            sign = np.concatenate([np.ones_like(all_lo), -np.ones_like(all_hi), -np.ones_like(cut_lo), np.ones_like(cut_hi)])
            order = np.argsort(edge, kind="stable")
            edge, depth = edge[order], np.cumsum(sign[order])
            for k in range(len(edge) - 1):
                if depth[k] > 0 and edge[k] < edge[k + 1]:
                    out.append((doc, int(edge[k]), int(edge[k + 1]), False))
        if out:
            yield batch(schema, *(list(c) for c in zip(*out)))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Word ranges that lie in passages of ``length`` words found at two places or more.

    (doc_id, start_word, end_word, later): ranges of a document don't overlap
    and cover just the words of all its runs of ``length`` words that occur
    elsewhere, in the same document too.  ``later`` ranges lie in occurrences
    other than the first by doc_id and place, and can be cut out without losing
    a passage; the others hold first occurrences only.  Words are runs without
    white space, compared as written.  Texts of fewer words than ``length``
    have no row, nor do rows with null id or text; rows with the same id and
    text are one document.  Texts of any length are read whole; an empty table
    gives no rows.  Of places in one document the foremost is the first.  Extra
    columns are ignored, whatever their names.
    """
    if not 1 <= length - gram <= 200:
        raise ValueError("gram must be less than length, by 200 at most")
    spark = docs.sparkSession
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))
    found = cut(rows.mapInArrow(_find(length, gram), "doc_id long, t long, h array<long>, x array<int>"))
    each = found.select("doc_id", "t", F.explode(F.arrays_zip("h", "x")).alias("a")).select("doc_id", "t", "a.h", "a.x")
    common = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    live = each.join(common, "h", "left_semi").groupBy(F.col("doc_id").alias("d"), F.col("t").alias("u")).agg(F.collect_list("x").alias("x"))
    texts = rows.join(live.hint("shuffle_hash"), (rows["doc_id"] == live["d"]) & (rows["t"] == live["u"])).select("doc_id", "t", "text", "x")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = texts.mapInArrow(_runs(length, gram, ranges), "part int, run binary, copies boolean").repartitionById(ranges, "part")
    spans = runs.mapInArrow(_repeats(length, gram), "doc_id long, t long, lo int, hi int, later boolean")
    by_doc = spans.groupBy("doc_id", "t").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"), F.collect_list("later").alias("later"))
    return by_doc.mapInArrow(_joined, "doc_id long, start_word int, end_word int, later boolean")
