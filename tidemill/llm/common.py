"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters trimmed from both ends of a word when words are normalised.
PUNCTUATION = ".,;:!?\"'()[]{}<>|*&%$#"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir.

    Only where the setting is absent and the session runs on one machine, as
    in tests, a folder is made; on a cluster that raises.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if sc.getCheckpointDir() is None:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        return sc.getCheckpointDir()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder; the files go when it is collected."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't use, whatever its extra columns are called."""
    used = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def token_count(text: Column | str) -> Column:
    """Number of runs without ASCII white space; null text counts 0."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0)).cast("long")


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            done = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array one after the other, and each text's offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: distinct values, code of each word, first word of each text, first byte of each word.

    A word is a maximal run without ASCII white space; a value still has the
    white space that follows it.
    """
    data, off = raw(texts)
    solid = ~_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    edge = off[:-1][off[:-1] < len(data)]
    start[edge] = solid[edge]
    at = np.flatnonzero(start)
    first = np.searchsorted(at, off)
    if not len(at):
        return pa.array([], pa.string()), np.zeros(0, np.int64), first, at
    cuts = np.append(at, len(data)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(cuts.tobytes()), pa.py_buffer(data))
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), first, at


def normal(values: pa.Array) -> pa.Array:
    """Lower case, without white space and punctuation at the ends."""
    return pc.utf8_trim(pc.utf8_lower(pc.utf8_trim_whitespace(values)), characters=PUNCTUATION)


def hashes(values: pa.Array) -> np.ndarray:
    """64 hash bits of each string, the same in every process."""
    if not len(values):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
