"""Mixing sources to target weights by Sainte-Laguë apportionment.

Tokens of each source are dealt into shards of bounded number by a seeded hash.
Within a shard, documents in seeded order form one stream that is cut into
blocks of equal numbers of tokens; a document belongs to the block in which
it starts.  Blocks are the seats: the highest quotients weight / (2 s + 1)
give each source its number, a source's number is apportioned to its shards
in the same way, and a seeded permutation of a shard's blocks says which are
taken.  Seats that a scarce source can't fill go to the others by their weights.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, token_count

BLOCK = 4096
#: Tokens of a shard at least, and the most shards that all sources have together, give or take one each.
SHARD, SHARDS = 1 << 22, 4096
SEED = 11
#: Target weight of each source; of those not named, 1.
WEIGHTS: dict[str, float] = {"src0": 4.0, "src1": 3.0, "src2": 3.0, "src3": 2.0, "src4": 2.0, "src5": 0.5}
#: Share of all tokens that is taken if no number of tokens is given.
SHARE = 0.6


def sainte_lague(weights: list[float], seats: int, supply: list[int]) -> list[int]:
    """Seats by the highest quotients w / (2 s + 1), none beyond its supply; ties go to the earlier party.

    If supplies are used up before the seats, the rest stays empty.
    """
    w, cap = np.array(weights, float), np.array(supply, np.int64)
    cap = np.where(w > 0, cap, 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0:
        return [0] * len(weights)
    at = lambda least: np.minimum(cap, np.floor((w / least + 1) / 2).clip(0, 2.0**62).astype(np.int64))
    lo, hi = w[w > 0].min() / (4.0 * (cap.max() + 1)), w.max() * 2
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if at(mid).sum() > seats else (lo, mid)
    given = at(hi)
    queue = [(-w[i] / (2 * given[i] + 1), i) for i in range(len(w)) if given[i] < cap[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(given.sum())):
        _, i = heapq.heappop(queue)
        given[i] += 1
        if given[i] < cap[i]:
            heapq.heappush(queue, (-w[i] / (2 * given[i] + 1), i))
    return [int(x) for x in given]


def quotas(tokens: dict[tuple[str, int], int], weights: dict[str, float], block: int = BLOCK, target: int | None = None, share: float = SHARE) -> dict[tuple[str, int], tuple[int, int]]:
    """(blocks taken, blocks there) for each source and shard.

    ``target`` tokens are taken, or, if it isn't given, ``share`` of those of
    all sources with a weight, in whole blocks.
    """
    shards: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for (s, k), n in sorted(tokens.items()):
        shards[s].append((k, -(-n // block)))
    supply = [sum(n for _, n in own) for own in shards.values()]
    w = [float(weights.get(s, 1.0)) for s in shards]
    seats = -(-target // block) if target is not None else math.ceil(share * sum(n for n, x in zip(supply, w) if x > 0))
    out = {}
    for (s, own), q in zip(shards.items(), sainte_lague(w, seats, supply)):
        there = [n for _, n in own]
        for (k, n), m in zip(own, sainte_lague([float(n) for n in there], q, there)):
            out[s, k] = (m, n)
    return out


def number(text: str) -> int:
    """60 bits of a text's MD5, which Spark and other engines give alike."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def permutation(seed: int, key: tuple[str, int], n: int) -> tuple[int, int]:
    """a, c such that b -> (a b + c) mod n permutes the blocks."""
    a = number(f"{seed}/a/{key[0]}/{key[1]}") % n
    while math.gcd(a, n) != 1:
        a += 1
    return a % n, number(f"{seed}/c/{key[0]}/{key[1]}") % n


def _slim(docs: DataFrame, seed: int) -> DataFrame:
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), digest)), 1, 15), 16, 10).cast("long")
    return cut(docs.select("doc_id", source.alias("source"), token_count("text").alias("n_tokens"), order.alias("order")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, target: int | None = None, share: float = SHARE, shards: int = SHARDS) -> DataFrame:
    """The documents taken: (doc_id, source, shard, block, n_tokens, order).

    ``target`` is the number of tokens to take, in whole blocks; by default it
    is ``share`` of what there is.  What a source can't give is given by the
    others; ``shares`` says how far the weights are met.
    Quotas are met in blocks; as documents are taken whole, documents of many
    blocks make the tokens taken right on average only (README has figures).
    A token is a run without white space.  A null source is a source of its
    own, named ''.  Documents without tokens belong to the block where they
    fall and cost nothing; a source without tokens gives none.  Very long
    texts are counted whole.  The order of documents is that of a seeded hash
    of id and text, then the id; rows with the same id and text are taken
    together.  Null ids are taken like others.  Extra columns are ignored,
    whatever their names; no documents give no rows.
    """
    spark = docs.sparkSession
    weights = WEIGHTS if weights is None else weights
    slim = _slim(docs, seed)
    totals = {r[0]: r[1] for r in slim.groupBy("source").agg(F.sum("n_tokens")).collect()}
    size = max(shard, -(-sum(totals.values()) // shards))
    parts = spark.createDataFrame([(s, max(1, -(-n // size))) for s, n in totals.items()], "source string, parts long")
    # of all orders the low bits choose the shard and the whole number the place in it
    dealt = slim.join(parts, "source").withColumn("shard", F.pmod("order", "parts")).drop("parts")
    found = {(r[0], r[1]): r[2] for r in dealt.groupBy("source", "shard").agg(F.sum("n_tokens")).collect()}
    rows = []
    for k, (q, n) in quotas({k: n for k, n in found.items() if n}, weights, block, target, share).items():
        if q:
            rows.append((*k, q, n, *permutation(seed, k, n)))
    plan = spark.createDataFrame(rows, "source string, shard long, q long, n long, a long, c long")
    w = Window.partitionBy("source", "shard").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("start", F.sum("n_tokens").over(w) - F.col("n_tokens"))
    placed = placed.withColumn("start", F.min("start").over(Window.partitionBy("source", "shard", "order", "doc_id"))).join(plan, ["source", "shard"])
    placed = placed.withColumn("block", F.least(F.expr(f"start div {block}"), F.col("n") - 1))
    return placed.where(F.pmod(F.col("a") * F.col("block") + F.col("c"), F.col("n")) < F.col("q")).select("doc_id", "source", "shard", "block", "n_tokens", "order")


def shares(docs: DataFrame, weights: dict[str, float] | None = None, **how) -> DataFrame:
    """(source, there, taken, target_share, taken_share): tokens of each source, and how the mixture compares with the weights."""
    weights = WEIGHTS if weights is None else weights
    there = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.sum(token_count("text")).alias("there"))
    taken = mix(docs, weights, **how).groupBy("source").agg(F.sum("n_tokens").alias("taken"))
    weight = F.lit(1.0)
    for s, x in sorted(weights.items()):
        weight = F.when(F.col("source") == s, float(x)).otherwise(weight)
    both = there.join(taken, "source", "left").withColumn("taken", F.coalesce("taken", F.lit(0))).withColumn("_w", weight)
    all_ = Window.partitionBy()
    return both.select("source", "there", "taken", (F.col("_w") / F.sum("_w").over(all_)).alias("target_share"), (F.col("taken") / F.sum("taken").over(all_)).alias("taken_share"))


def keep_mixed(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """``docs`` with just the rows that ``mix`` takes, all columns kept, whatever their names."""
    id_, s, o = fresh(docs, "_id", "_s", "_o")
    taken = mix(docs, seed=seed, **how).select(F.col("doc_id").alias(id_), F.col("source").alias(s), F.col("order").alias(o)).distinct()
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit("/"), F.md5(F.coalesce(docs["text"].cast("string"), F.lit(""))))), 1, 15), 16, 10).cast("long")
    on = docs["doc_id"].eqNullSafe(taken[id_]) & (F.coalesce(docs["source"].cast("string"), F.lit("")) == taken[s]) & (order == taken[o])
    return docs.join(taken.hint("shuffle_hash"), on, "left_semi")


def sql(weights: dict[str, float] = WEIGHTS, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, share: float = SHARE, shards: int = SHARDS) -> str:
    """The same in DuckDB's SQL, seat by seat."""
    named = " ".join(f"WHEN '{s}' THEN {float(w)!r}" for s, w in sorted(weights.items()))
    bits = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
    key = "'{0}/{1}/' || source || '/' || shard"
    return f"""
WITH slim AS (
    SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\f\\r\\x0B]+')), 0) AS n_tokens,
        {bits.format(f"'{seed}/' || coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))")} AS ord
    FROM documents
), totals AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS n FROM slim GROUP BY source
), parts AS (
    SELECT source, CAST(greatest(1, (n + size - 1) // size) AS BIGINT) AS parts
    FROM totals, (SELECT CAST(greatest({shard}, (sum(n) + {shards - 1}) // {shards}) AS BIGINT) AS size FROM totals)
), dealt AS (SELECT s.*, ord % parts AS shard FROM slim s JOIN parts USING (source)
), there AS (
    SELECT source, shard, CAST((sum(n_tokens) + {block - 1}) // {block} AS BIGINT) AS n FROM dealt GROUP BY source, shard HAVING sum(n_tokens) > 0
), supply AS (
    SELECT source, CAST(sum(n) AS BIGINT) AS n, CAST(CASE source {named} ELSE 1.0 END AS DOUBLE) AS w FROM there GROUP BY source
), seat AS (
    SELECT source, row_number() OVER (ORDER BY w / (2 * s + 1) DESC, source) AS nth FROM supply, unnest(range(n)) AS r(s) WHERE w > 0
), won AS (
    SELECT source, count(*) AS q FROM seat WHERE nth <= (SELECT ceil(CAST({share} AS DOUBLE) * CAST(sum(n) AS DOUBLE)) FROM supply WHERE w > 0) GROUP BY source
), own AS (
    SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY CAST(n AS DOUBLE) / (2 * s + 1) DESC, shard) AS nth FROM there, unnest(range(n)) AS r(s)
), quota AS (SELECT o.source, o.shard, count(*) AS q FROM own o JOIN won w ON o.source = w.source AND o.nth <= w.q GROUP BY o.source, o.shard
), plan AS (
    SELECT source, shard, n, q, {bits.format(key.format(seed, "a"))} % n AS r, {bits.format(key.format(seed, "c"))} % n AS c FROM quota JOIN there USING (source, shard)
), step AS (SELECT *, (SELECT min(x) FROM (SELECT unnest(range(r, r + 1000)) AS x) WHERE gcd(x, n) = 1) % n AS a FROM plan
), sums AS (
    SELECT *, sum(n_tokens) OVER (PARTITION BY source, shard ORDER BY ord, doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS own_start FROM dealt
), starts AS (SELECT *, CAST(min(own_start) OVER (PARTITION BY source, shard, ord, doc_id) AS BIGINT) AS start FROM sums
), placed AS (SELECT d.*, least(start // {block}, p.n - 1) AS block, p.n, p.q, p.a, p.c FROM starts d JOIN step p ON d.source = p.source AND d.shard = p.shard)
SELECT doc_id, source, CAST(shard AS BIGINT) AS shard, CAST(block AS BIGINT) AS block, CAST(n_tokens AS BIGINT) AS n_tokens FROM placed WHERE (a * block + c) % n < q
"""
