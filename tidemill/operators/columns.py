"""Updates of some columns by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, in_order, one_per_key, same, tie_break, unused, without
from .merge import upsert


def update_by_query(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str], delta: str | None = None) -> DataFrame:
    """All target rows, with ``columns`` from the source where the key is equal; null keys never are.

    Of several source rows with a key one counts: the one with the greatest
    delta value, then by all columns.
    """
    if wrong := set(columns) & set(keys):
        raise ValueError(f"a key isn't updated: {', '.join(sorted(wrong))}")
    new, names = aside(one_per_key(source, keys, tie_break(source, delta, keys)), target, [*keys, *columns])
    (hit,) = unused(target, "_hit")
    both = target.join(new.withColumn(hit, F.lit(True)), same(keys, names, null_safe=False), "left")
    taken = lambda c: F.when(F.col(hit), F.col(f"`{names[c]}`").cast(target.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c)
    return both.select(*[taken(c) if c in columns else F.col(f"`{c}`") for c in target.columns])


def update_by_key(target: DataFrame, source: DataFrame, keys: Sequence[str], delta: str | None = None, bdate: str | None = None, where: Column | str | None = None) -> DataFrame:
    """``update_by_query`` of all columns but the key, the delta field and the business date."""
    rows = source if where is None else source.where(where)
    fixed = {*keys, *(x for x in (delta, bdate) if x)}
    return update_by_query(target, rows, keys, [c for c in target.columns if c not in fixed], delta)


def refresh_columns(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str], delta: str | None = None) -> DataFrame:
    """The refreshed rows, to be merged by key: target rows met by the source, ``columns`` taken from it.

    Of several source rows with a key one counts, as in ``update_by_query``, so
    no target row is multiplied; null keys meet nothing.
    """
    if wrong := set(columns) & set(keys):
        raise ValueError(f"a key isn't updated: {', '.join(sorted(wrong))}")
    new, names = aside(one_per_key(source, keys, tie_break(source, delta, keys)), target, [*keys, *columns])
    both = target.join(new, same(keys, names, null_safe=False), "inner")
    return both.select(*[F.col(f"`{names[c]}`").cast(target.schema[c].dataType).alias(c) if c in columns else F.col(f"`{c}`") for c in target.columns])


def delete_by_query(target: DataFrame, query: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose key the query lacks; null keys are equal."""
    return without(target, query, keys)


def keep_by_query(target: DataFrame, query: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose key the query has, each once however often it has it; null keys are equal."""
    new, names = aside(query, target, keys)
    return target.join(new, same(keys, names), "left_semi")


def upsert_by_query(target: DataFrame, query: DataFrame, keys: Sequence[str]) -> DataFrame:
    return upsert(target, in_order(query, target), keys)
