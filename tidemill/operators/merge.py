"""Keyed merge and upsert: rows of the source win over the target's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, in_order, one_per_key, same, tie_break, unused, without


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], duplicates: str = "keep", delta: str | None = None, where: Column | str | None = None) -> DataFrame:
    """Source rows, and target rows whose key the source lacks; null keys are equal.

    An anti-join and a union: ``keep`` keeps all rows of a key on whichever
    side wins.  ``drop`` leaves one row for each key, of the target's too; ties
    go by the delta field downward and then by all columns.  For that the
    source, which is small, is ranked; of the target only rows of keys that
    repeat in it are, which a count by key tells.  ``where`` filters the source only.
    """
    rows = in_order(source if where is None else source.where(where), target)
    rest = without(target, rows, keys)
    if duplicates == "keep":
        return rows.unionByName(rest)
    if duplicates != "drop":
        raise ValueError("duplicates is 'keep' or 'drop'")
    return one_per_key(rows, keys, tie_break(target, delta, keys)).unionByName(one_of_repeated(rest, keys, delta))


def one_of_repeated(df: DataFrame, keys: Sequence[str], delta: str | None = None) -> DataFrame:
    """The first row of each key, ranking only rows whose key isn't alone."""
    n, twice = unused(df, "_n", "_twice")
    again = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).drop(n)
    right, names = aside(again.withColumn(twice, F.lit(True)), df, [*keys, twice])
    marked = df.join(right, same(keys, names), "left")
    alone = marked.where(F.col(f"`{names[twice]}`").isNull()).select(*df.columns)
    more = marked.where(F.col(f"`{names[twice]}`")).select(*df.columns)
    return alone.unionByName(one_per_key(more, keys, tie_break(df, delta, keys)))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], dedup: bool = False, delta: str | None = None, where: Column | str | None = None, nulls_last: bool = False) -> DataFrame:
    """Target rows without a key of the source, and the source's rows.

    ``dedup`` keeps the source row with the greatest delta value of each key, a
    null value counting as the greatest unless ``nulls_last``.
    """
    rows = in_order(source if where is None else source.where(where), target)
    rest = without(target, rows, keys)
    if dedup:
        rows = one_per_key(rows, keys, tie_break(rows, delta, keys, nulls_last))
    return rest.unionByName(rows)
