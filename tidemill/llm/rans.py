"""Token ids as compressed blocks, by a static range asymmetric numeral system.

All documents are tokenised once; one table of symbol frequencies, scaled to
2**22, serves all blocks.  A block holds whole documents.  Its tokens are dealt
to 64 interleaved lanes, each with a state of 63 bits that gives off words of
32 bits; blocks don't depend on each other, and many are coded side by side.
Every 256 steps a checkpoint keeps the lanes' states and the place in the
stream, so that stretches between checkpoints can be decoded side by side
too.  A checksum covers the block's token ids.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, pieces, scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK, LANES, STEP, SCALE = 1 << 16, 64, 256, 22
_LOW = np.uint64(1 << 31)
_UP = np.uint64(31 - SCALE + 32)
_CODERS: dict[str, object] = {}


def coder(path: str):
    """The byte-pair encoder of a file of ranks, made once in each process."""
    if path not in _CODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _CODERS[path]


def tokenise(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All token ids one text after the other, and how many each text has; null has none."""
    encode_ordinary, ids = coder(path).encode_ordinary, array("i")
    n = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts.to_pylist()):
        if text:
            own = encode_ordinary(text)
            n[k] = len(own)
            ids.extend(own)
    return np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32), n


def quantise(count: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale, at least 1 for each symbol that occurs."""
    total, want = int(count.sum()), 1 << scale
    if not total:
        return np.zeros(len(count), np.uint32)
    f = np.where(count > 0, np.maximum(1, np.floor(count * (want / total))), 0).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    gap = want - int(f.sum())
    if gap > 0:
        f[order[0]] += gap
    for i in order:
        if gap >= 0:
            break
        give = min(int(f[i]) - 1, -gap)
        f[i] -= give
        gap += give
    return f.astype(np.uint32)


def encode(blocks: list[np.ndarray], freq: np.ndarray) -> list[tuple[bytes, bytes, list[int]]]:
    """For each block its stream, the states at its checkpoints, and the stream's words before each."""
    f64 = freq.astype(np.uint64)
    cum = np.cumsum(f64) - f64
    steps = [-(-len(b) // LANES) for b in blocks]
    t_max, lanes = max(steps, default=0), LANES * len(blocks)
    symbol = np.zeros((t_max, lanes), np.int32)
    live = np.zeros((t_max, lanes), bool)
    for k, b in enumerate(blocks):
        flat = np.zeros(steps[k] * LANES, np.int32)
        flat[: len(b)] = b
        symbol[: steps[k], k * LANES : (k + 1) * LANES] = flat.reshape(-1, LANES)
        live[: steps[k], k * LANES : (k + 1) * LANES] = (np.arange(steps[k] * LANES) < len(b)).reshape(-1, LANES)
    x = np.full(lanes, _LOW)
    word = np.zeros((t_max, lanes), np.uint32)
    out = np.zeros((t_max, lanes), bool)
    kept = {}
    full = live.all(axis=1)
    for t in range(t_max - 1, -1, -1):
        f, c = f64[symbol[t]], cum[symbol[t]]
        give = x >= (f << _UP)
        if not full[t]:
            give &= live[t]
            f = np.where(live[t], f, np.uint64(1))
        word[t] = x
        out[t] = give
        y = np.where(give, x >> np.uint64(32), x)
        q = y // f
        y = (q << np.uint64(SCALE)) + (y - q * f) + c
        x = y if full[t] else np.where(live[t], y, x)
        if t % STEP == 0:
            kept[t] = x
    result = []
    for k in range(len(blocks)):
        own = slice(k * LANES, (k + 1) * LANES)
        mask = out[: steps[k], own]
        marks = range(0, steps[k], STEP)
        before = np.append(0, np.cumsum(mask.sum(axis=1)))
        states = np.stack([kept[t][own] for t in marks]) if steps[k] else np.zeros((0, LANES), np.uint64)
        result.append((word[: steps[k], own][mask].astype("<u4").tobytes(), states.astype("<u8").tobytes(), [int(before[t]) for t in marks]))
    return result


def decode(stream: bytes, states: bytes, offsets: list[int], n: int, freq: np.ndarray, checksum: int | None = None) -> np.ndarray:
    """The block's token ids; all stretches between checkpoints at once.  Raises if the checksum differs."""
    f64 = freq.astype(np.uint64)
    cum = np.cumsum(f64) - f64
    slot = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    words = np.frombuffer(stream, "<u4").astype(np.uint64)
    x = np.frombuffer(states, "<u8").astype(np.uint64).reshape(-1, LANES).copy()
    at = np.array(offsets, np.int64)
    steps = -(-n // LANES)
    out = np.zeros((len(x), STEP, LANES), np.int32)
    index = np.arange(len(x)) * STEP
    for t in range(min(STEP, steps)):
        live = (((index + t) * LANES)[:, None] + np.arange(LANES)) < n
        low = x & np.uint64((1 << SCALE) - 1)
        s = slot[low.astype(np.int64)]
        y = f64[s] * (x >> np.uint64(SCALE)) + low - cum[s]
        take = live & (y < _LOW)
        nth = at[:, None] + np.cumsum(take, axis=1) - take
        if take.any():
            y[take] = (y[take] << np.uint64(32)) | words[nth[take]]
        x = np.where(live, y, x)
        at += take.sum(axis=1)
        out[:, t] = s
    ids = out.reshape(-1)[:n]
    if checksum is not None and zlib.crc32(ids.astype("<i4").tobytes()) != checksum:
        raise ValueError("checksum differs")
    return ids


BLOCKS = "kind string, doc_ids array<long>, doc_tokens array<int>, n_tokens long, checksum long, stream binary, states binary, offsets array<long>"
_SCHEMA = pa.schema([("kind", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("checksum", pa.int64()), ("stream", pa.binary()), ("states", pa.binary()), ("offsets", pa.list_(pa.int64()))])


def compress(docs: DataFrame, path: str = VOCABULARY, side_by_side: int = 24) -> DataFrame:
    """A row of kind 'table' with the frequencies (32-bit, in stream), and rows of kind 'block'.

    A block lists its documents in order with their numbers of tokens: -1 for
    a null text, 0 for an empty one.  Blocks hold about 65,536 tokens; a longer
    document has a block of its own, whole, and is coded by itself, so that
    others don't take its room.  Null ids and repeated rows are kept as they
    are; extra columns are ignored, whatever their names.  No documents give
    the table only, all zeros.  ``path`` names the tokenizer's ranks; every executor needs
    that file.
    """
    spark = docs.sparkSession
    size = len(coder(path).token_byte_values())
    top = max(coder(path).encode_single_token(b) for b in coder(path).token_byte_values())
    size = max(size, top + 1)
    kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<i4")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())])
        for part in pieces(batches):
            ids, n = tokenise(part.column("text"), path)
            cuts = np.append(0, np.cumsum(n) * kind.itemsize).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(ids.astype(kind).tobytes())])
            count = np.where(pc.is_null(part.column("text")).to_numpy(zero_copy_only=False), -1, n).astype(np.int32)
            yield batch(schema, part.column("doc_id"), count, blob)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for part in batches:
            total += np.bincount(raw_bytes(part.column("ids")).view(kind), minlength=size)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], ["symbol", "n"])

    where = scratch(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(tokens, "doc_id long, n int, ids binary").write.option("parquet.enable.dictionary", "false").parquet(where)
    ids = spark.read.parquet(where)
    count = np.zeros(size, np.int64)
    for s, n in ids.select("ids").mapInArrow(tally, "symbol int, n long").groupBy("symbol").agg(F.sum("n")).toLocalIterator():
        count[s] = n
    freq = quantise(count)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[list[int], list[int], np.ndarray]] = []
        docs_, lens, parts, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            coded: list = [None] * len(done)
            long = [k for k, (_, _, b) in enumerate(done) if len(b) > BLOCK]
            for some in ([k for k in range(len(done)) if k not in long], *([k] for k in long)):
                for k, c in zip(some, encode([done[k][2] for k in some], freq)):
                    coded[k] = c
            cols = zip(*(("block", d, n, len(b), zlib.crc32(b.astype("<i4").tobytes()), *c) for (d, n, b), c in zip(done, coded)))
            return batch(_SCHEMA, *(list(c) for c in cols))

        def close() -> None:
            nonlocal docs_, lens, parts, total
            if docs_:
                done.append((docs_, lens, np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)))
            docs_, lens, parts, total = [], [], [], 0

        for rows_ in batches:
            who, n = rows_.column("doc_id").to_pylist(), rows_.column("n").to_pylist()
            flat = raw_bytes(rows_.column("ids")).view(kind)
            at = 0
            for d, m in zip(who, n):
                own = max(m, 0)
                if docs_ and total + own > BLOCK:
                    close()
                docs_.append(d)
                lens.append(m)
                if own:
                    parts.append(flat[at : at + own])
                at += own
                total += own
                if total > BLOCK:
                    close()
                if len(done) >= side_by_side:
                    yield flush()
                    done.clear()
            parts = [p.copy() for p in parts]
        close()
        if done:
            yield flush()

    table = spark.createDataFrame([("table", [], [], size, zlib.crc32(freq.astype("<u4").tobytes()), bytearray(freq.astype("<u4").tobytes()), bytearray(), [])], BLOCKS)
    return table.unionByName(ids.mapInArrow(blocks, BLOCKS))


def raw_bytes(column: pa.Array) -> np.ndarray:
    """The values of a binary array one after the other."""
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]


def expand(blocks: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of all documents in ``blocks``, decoded in parallel; raises where a checksum differs."""
    row = blocks.where("kind = 'table'").select("stream", "checksum").first()
    if zlib.crc32(bytes(row[0])) != row[1]:
        raise ValueError("checksum of the table differs")
    freq = np.frombuffer(bytes(row[0]), "<u4")
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = coder(path)
        for rows in batches:
            for r in rows.to_pylist():
                ids = decode(r["stream"], r["states"], r["offsets"], r["n_tokens"], freq, r["checksum"]).tolist()
                texts, at = [], 0
                for n in r["doc_tokens"]:
                    texts.append(None if n < 0 else enc.decode(ids[at : at + n], errors="strict"))
                    at += max(n, 0)
                yield batch(schema, r["doc_ids"], texts)

    return blocks.where("kind = 'block'").drop("kind").mapInArrow(run, "doc_id long, text string")
