"""Loads by calendar partition.

Only partitions that the source touches are read of the target and returned;
a store puts them in place of the old ones.  All of them are one plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.partitions import DEFAULT, key, of_value, start_of
from .common import in_order, unused
from .merge import merge


class OutOfRange(ValueError):
    """Rows without a partition."""


def touched(source: DataFrame, field: str, period: str) -> list[str]:
    """Partitions that the source has rows for; as many as its calendar periods, not its rows."""
    days = source.select(start_of(F.col(f"`{field}`"), period).alias("p")).distinct().collect()
    return sorted(DEFAULT if r[0] is None else r[0].isoformat() for r in days)


def _inside(field: Column, parts: Sequence[str], period: str) -> Column:
    """Rows of these partitions, for a scan: a plain range on the date prunes files and row groups, which the derived day can't."""
    days = sorted(date.fromisoformat(p) for p in parts if p != DEFAULT)
    own = F.lit(False)
    if days:
        end = of_value(datetime.combine(days[-1], time()), period).end
        lo, hi = datetime.combine(days[0], time()), end
        own = (field >= F.lit(lo)) & (field < F.lit(hi)) & start_of(field, period).isin(days)
    return own | start_of(field, period).isNull() if DEFAULT in parts else own


def placed(rows: DataFrame, field: str, period: str, out_of_range: str = "default", first: datetime | None = None) -> DataFrame:
    """Rows that a partition load takes: rows without a partition stay, are left out or raise."""
    inside = start_of(F.col(f"`{field}`"), period).isNotNull()
    if first is not None:
        inside &= F.col(f"`{field}`") >= F.lit(first)
    if out_of_range == "skip":
        return rows.where(inside)
    if out_of_range == "raise" and not rows.where(~F.coalesce(inside, F.lit(False))).isEmpty():
        raise OutOfRange(f"rows without a partition by {field}")
    return rows


def load_partitions(
    target: DataFrame,
    source: DataFrame,
    field: str,
    period: str = "month",
    keys: Sequence[str] | None = None,
    duplicates: str = "keep",
    delta: str | None = None,
    where: Column | str | None = None,
    distinct: bool = False,
    out_of_range: str = "default",
    first: datetime | None = None,
    global_key: bool = False,
    parts: Sequence[str] | None = None,
) -> DataFrame:
    """New rows of the partitions touched by the source.

    Without ``keys`` each touched partition is replaced by its slice of the
    source, even if that covers a part of it; with ``keys`` the slice is merged
    with what is there.  Keys are compared within a partition: a row whose date
    moved leaves its old copy where it was, unless ``global_key``.

    Rows with null dates, or before ``first``, raise, are skipped, or go to the
    default partition, as ``out_of_range`` says.  ``parts`` saves the look at
    which partitions the source touches, if that is known.
    """
    if out_of_range not in ("default", "skip", "raise"):
        raise ValueError("out_of_range is 'default', 'skip' or 'raise'")
    rows = placed(in_order(source if where is None else source.where(where), target), field, period, out_of_range, first)
    if not keys:
        return rows.distinct() if distinct else rows
    if global_key:
        return merge(target, rows, list(keys), duplicates, delta)
    parts = touched(rows, field, period) if parts is None else parts
    (p,) = unused(target, "_part")
    c = F.col(f"`{field}`")
    part = start_of(c, period)
    if first is not None:
        part = F.when(c >= F.lit(first), part)
        old = target.where(_inside(c, parts, period) | (c < F.lit(first)) if DEFAULT in parts else _inside(c, parts, period))
    else:
        old = target.where(_inside(c, parts, period))
    return merge(old.withColumn(p, part), rows.withColumn(p, part), [p, *keys], duplicates, delta).drop(p)


def untouched(target: DataFrame, field: str, period: str, parts: Sequence[str]) -> DataFrame:
    """Target rows outside the partitions."""
    return target.where(~F.coalesce(_inside(F.col(f"`{field}`"), parts, period), F.lit(False)))


def whole(target: DataFrame, source: DataFrame, field: str, period: str = "month", **how) -> DataFrame:
    """The table after ``load_partitions``: what the source doesn't touch, and the new rows of what it does.

    With a global key the new rows are all there is.  ``parts`` saves the look
    at which partitions the source touches, if that is known or cheaper to find elsewhere.
    """
    if how.get("global_key"):
        return load_partitions(target, source, field, period, **how)
    parts = how.pop("parts", None) or touched(source if how.get("where") is None else source.where(how["where"]), field, period)
    return untouched(target, field, period, parts).unionByName(load_partitions(target, source, field, period, parts=parts, **how))


def swap_default(target: DataFrame, source: DataFrame, field: str, period: str = "month", partitions: Sequence[str] = ()) -> DataFrame:
    """The table with its default partition (rows in none of ``partitions``) replaced; unchanged if the source is empty."""
    if source.isEmpty():
        return target
    part = key(F.col(f"`{field}`"), period)
    return target.where(part.isin(list(partitions))).unionByName(in_order(source, target))


def drop_range(target: DataFrame, field: str, start: datetime, end: datetime, period: str = "month") -> DataFrame:
    """Rows outside all partitions that share a point with [start, end]."""
    c = F.col(f"`{field}`")
    lo, hi = (F.date_trunc(period, F.lit(x)) for x in (start, end))
    return target.where(c.isNull() | (F.date_trunc(period, c) < lo) | (F.date_trunc(period, c) > hi))


def truncate_range(target: DataFrame, field: str, start: datetime, end: datetime, period: str = "month") -> DataFrame:
    """The same rows: as a table of rows has no empty partitions, emptying them and dropping them are one."""
    return drop_range(target, field, start, end, period)
