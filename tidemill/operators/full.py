"""Full replacement and append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from .common import in_order, without


def replace_all(target: DataFrame, source: DataFrame, empty: bool | None = None) -> DataFrame:
    """The source's rows; those of the target if the source has none.

    ``empty`` saves the look at the source if it is known already.
    """
    if source.isEmpty() if empty is None else empty:
        return target
    return in_order(source, target)


def append(target: DataFrame, source: DataFrame, where: Column | str | None = None, new_keys_only: list[str] | None = None) -> DataFrame:
    """Rows to add to the target.

    The first moment of a window is read again with the next one; with
    ``new_keys_only``, rows whose key the target has are left out.
    """
    rows = in_order(source if where is None else source.where(where), target)
    if new_keys_only:
        rows = without(rows, target, new_keys_only)
    return rows


def united(frames: Sequence[DataFrame], distinct: bool = False) -> DataFrame:
    """Rows of several tables by the names, order and types of the first; ``distinct`` leaves each row once."""
    first, *rest = frames
    for df in rest:
        first = first.unionByName(in_order(df, first))
    return first.distinct() if distinct else first
