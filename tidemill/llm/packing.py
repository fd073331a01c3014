"""Best-fit packing of documents into training sequences of one capacity.

Items above a third of the capacity share a bin with at most one other such
item: the largest is matched with the largest that still fits.  Smaller items,
longest first, go into the tightest gap that holds them; if there is none, a
bin is opened.

What that gives depends only on how many items have each length, so the plan
is made on the histogram of lengths (at most one entry for each length up to
the capacity, whatever the size of the corpus), bins with the same gap as one
range.  Executors then look up each item by its length and rank.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, cut, token_count

CAPACITY = 2048
#: Ranks are counted in so many parts of each length, so that a frequent length is not one task.  Long texts don't
#: make one frequent, as only what is left of them is ranked.
SALTS = 64


class Plan:
    """Segments: items of a length from a rank on go into bins from ``bin`` on, ``per`` in each, the first at ``offset``."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.bins = capacity, 0
        self._segments: list[tuple[int, int, int, int, int]] = []
        self._rank = dict.fromkeys(histogram, 0)
        left = {n: c for n, c in histogram.items() if c}
        if any(not 0 < n <= capacity for n in left):
            raise ValueError("an item must have 1 token at least and fit its bin")
        self._gaps: dict[int, list[tuple[int, int]]] = {}
        self._order: list[int] = []
        large = sorted(n for n in left if 3 * n > capacity)
        for n in reversed(large):
            while left[n]:
                k = bisect.bisect_right(large, min(n, capacity - n)) - 1
                while k >= 0 and left[large[k]] < 1 + (large[k] == n):
                    k -= 1
                if k < 0:
                    bins = self._open(left[n])
                    self._place(n, left[n], bins, 1, 0)
                    self._free(capacity - n, bins, bins + left[n])
                    left[n] = 0
                    break
                other = large[k]
                count = left[n] // 2 if other == n else min(left[n], left[other])
                bins = self._open(count)
                for item, offset in ((n, 0), (other, n)):
                    self._place(item, count, bins, 1, offset)
                    left[item] -= count
                self._free(capacity - n - other, bins, bins + count)
        for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
            while left[n]:
                k = bisect.bisect_left(self._order, n)
                if k < len(self._order):
                    gap = self._order[k]
                    lo, hi = self._gaps[gap].pop()
                    if not self._gaps[gap]:
                        del self._order[k]
                        del self._gaps[gap]
                else:
                    gap = capacity
                    lo = self._open(max(1, left[n] // (capacity // n)))
                    hi = self.bins
                per = min(gap // n, left[n])
                count = min(hi - lo, left[n] // per)
                self._place(n, count * per, lo, per, capacity - gap)
                left[n] -= count * per
                self._free(gap - per * n, lo, lo + count)
                if lo + count < hi:
                    self._free(gap, lo + count, hi)
        rows = np.array(sorted(self._segments), np.int64).reshape(-1, 5)
        self.length, self.rank, self.bin, self.per, self.offset = rows.T.copy()

    def _open(self, count: int) -> int:
        self.bins += count
        return self.bins - count

    def _place(self, n: int, count: int, bin_: int, per: int, offset: int) -> None:
        self._segments.append((n, self._rank[n], bin_, per, offset))
        self._rank[n] += count

    def _free(self, gap: int, lo: int, hi: int) -> None:
        if gap:
            if gap not in self._gaps:
                bisect.insort(self._order, gap)
                self._gaps[gap] = []
            self._gaps[gap].append((lo, hi))

    def look_up(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of the items with these lengths and ranks."""
        at = np.searchsorted((self.length << 44) | self.rank, (length << 44) | rank, side="right") - 1
        nth = rank - self.rank[at]
        return self.bin[at] + nth // self.per[at], self.offset[at] + nth % self.per[at] * length


def items(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, rest, wholes, salt) for each row with tokens: bins that it fills by itself, and the tokens that are left."""
    n = docs.select("doc_id", token_count("text").alias("n")).where("n > 0")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    return n.select("doc_id", F.expr(f"n % {capacity}").alias("rest"), F.expr(f"n div {capacity}").alias("wholes"), salt.alias("salt"))


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(bin_id, doc_id, part, first_token, n_tokens, bin_offset): where each token run of each document goes.

    A token here is a run without white space.  Documents longer than
    ``capacity`` are cut into parts of that many tokens and a rest; no token
    is lost or cut off.  Parts that fill a bin have one each, after those of
    the others; only rests have to be matched.  Null and empty texts have no
    tokens and no row.  A null doc_id is packed like any other, repeated rows
    each for themselves; equal lengths are taken by salt and doc_id.  No
    documents give no bins.  Extra columns are ignored.  The capacity is less
    than 2**19.
    """
    if not 0 < capacity < 1 << 19:
        raise ValueError("the capacity is 1 at least and less than 2**19")
    # texts are read and counted once
    all_ = cut(items(docs, capacity))
    counts, wholes = (np.zeros((capacity, SALTS), np.int64) for _ in range(2))
    for n, salt, count, whole in all_.groupBy("rest", "salt").agg(F.count("*"), F.sum("wholes")).toLocalIterator():
        counts[n, salt], wholes[n, salt] = count, whole
    before = np.cumsum(counts, axis=1) - counts
    total = counts.sum(axis=1)
    plan = Plan({int(n): int(total[n]) for n in np.flatnonzero(total) if n}, capacity)
    first_whole = plan.bins + (np.cumsum(wholes) - wholes.ravel()).reshape(wholes.shape)
    schema = pa.schema([(c, pa.int64()) for c in ("bin_id", "doc_id", "part", "first_token", "n_tokens", "bin_offset")])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            rest, whole, salt, nth, done = (rows.column(c).to_numpy() for c in ("rest", "wholes", "salt", "nth", "done"))
            doc = rows.column("doc_id").cast(pa.int64())
            owner = np.repeat(np.arange(len(rest)), whole)
            part = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
            some = np.flatnonzero(rest)
            where, offset = plan.look_up(rest[some], before[rest[some], salt[some]] + nth[some] - 1)
            bins = np.append((first_whole[rest, salt] + done)[owner] + part, where)
            part = np.append(part, whole[some])
            size = np.append(np.full(len(owner), capacity), rest[some])
            yield batch(schema, bins, doc.take(pa.array(np.append(owner, some))), part, part * capacity, size, np.append(np.zeros(len(owner), np.int64), offset))

    w = Window.partitionBy("rest", "salt").orderBy("doc_id", "wholes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = all_.withColumn("nth", F.count("*").over(w)).withColumn("done", F.sum("wholes").over(w) - F.col("wholes"))
    return ranked.mapInArrow(assign, "bin_id long, doc_id long, part long, first_token long, n_tokens long, bin_offset long")
