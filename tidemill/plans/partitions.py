"""Range partitions by calendar period: bounds, names, widths, overlaps."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .periods import Period, floor

PERIODS = {"day": Period.of(1, "day"), "month": Period.of(1, "month"), "quarter": Period.of(1, "quarter"), "year": Period.of(1, "year")}
#: Rows without a date, or out of all partitions.
DEFAULT = "default"


@dataclass(frozen=True, order=True)
class Partition:
    start: datetime
    end: datetime

    @property
    def period(self) -> str:
        return infer(self.start, self.end)

    @property
    def name(self) -> str:
        s = self.start
        return {"day": f"d_{s:%d_%m_%Y}", "month": f"m_{s:%m_%Y}", "quarter": f"q_{(s.month + 2) // 3}_{s:%Y}", "year": f"y_{s:%Y}"}[self.period]

    def holds(self, t: datetime) -> bool:
        return self.start <= t < self.end

    def condition(self, column: Column) -> Column:
        return (column >= F.lit(self.start)) & (column < F.lit(self.end))


def infer(start: datetime, end: datetime) -> str:
    """The period that a partition of this width has."""
    days = (end - start).days
    return "day" if days < 28 else "month" if days < 32 else "quarter" if days <= 92 else "year"


def segments(period: str) -> list[tuple[datetime, str]]:
    """The period in force from each date on.

    A period is one of ``PERIODS`` or, for tables whose partitions aren't all
    equally wide, such as ``2024-01-01=month;2024-03-01=day``.  Rows before the
    first date have no partition.
    """
    out = []
    for x in period.split(";"):
        day, _, unit = x.strip().rpartition("=")
        if unit not in PERIODS:
            raise ValueError(f"a period is one of {', '.join(PERIODS)}, not {unit!r}")
        out.append((datetime.fromisoformat(day) if day else datetime.min, unit))
    if out != sorted(out, key=lambda x: x[0]) or any(d != datetime.min and floor(d, u) != d for d, u in out):
        raise ValueError(f"{period!r}: dates must rise, each the start of one of its periods")
    return out


def of_value(t: datetime, period: str) -> Partition | None:
    """The partition that holds ``t``, None before the first one; a partition ends where another period begins."""
    all_ = segments(period)
    k = max((k for k, (day, _) in enumerate(all_) if day <= t), default=None)
    if k is None:
        return None
    start = floor(t, all_[k][1])
    end = PERIODS[all_[k][1]].after(start)
    return Partition(start, min([end, *(day for day, _ in all_[k + 1 :])]))


def extend(partitions: Iterable[Partition], value: datetime, limit: datetime | None = None) -> list[Partition]:
    """Partitions to add so that ``value`` has one, as wide as the last.

    Partitions from ``limit`` on (such as one for open rows in the far future)
    don't count when the last is looked up.  Fewer than two partitions, or a
    value before the end of the last, give none: tables grow upward only.
    """
    if value is None:
        raise ValueError("a value is needed to extend partitions")
    known = sorted(p for p in partitions if limit is None or p.start < limit)
    if len(known) < 2:
        return []
    last, out = known[-1], []
    step = PERIODS[last.period]
    while last.end <= value and (limit is None or last.end < limit):
        last = Partition(last.end, step.after(last.end))
        out.append(last)
    return out


def overlapping(partitions: Iterable[Partition], start: datetime, end: datetime) -> list[Partition]:
    """Partitions that share a point with [start, end], both ends included, at whole seconds."""
    lo, hi = start.replace(microsecond=0), end.replace(microsecond=0)
    return sorted(p for p in partitions if p.start <= hi and p.end > lo)


def by_value(partitions: Iterable[Partition], value: datetime) -> Partition | None:
    return next((p for p in partitions if p.holds(value)), None)


def start_of(column: Column | str, period: str) -> Column:
    """The first day of each row's partition, null if it has none; no time zone takes part."""
    c = F.col(column) if isinstance(column, str) else column
    out = None
    for day, unit in segments(period):
        own = c.cast("date") if unit == "day" else F.trunc(c.cast("date"), unit)
        if day != datetime.min:
            own = F.when(c >= F.lit(day), own)
            own = own if out is None else own.otherwise(out)
        out = own
    return out


def key(column: Column | str, period: str) -> Column:
    """The same as text, such as 2001-05-01; DEFAULT if there is none."""
    return F.coalesce(start_of(column, period).cast("string"), F.lit(DEFAULT))


def enumerate_days(field: str, pattern: str, start: datetime | None, end: datetime | None) -> list[str]:
    """One predicate for each day from start to end, both included; none if anything is missing."""
    if not field or not pattern or start is None or end is None:
        return []
    day, out = floor(start, "day"), []
    while day <= end:
        out.append(f"{field} = '{day.strftime(pattern)}'")
        day = Period.of(1, "day").after(day)
    return out


def split(start: datetime, end: datetime, parts: int = 16) -> list[tuple[datetime, datetime]]:
    """About ``parts`` ranges of whole days that cover [start, end), each a day at least."""
    days = max(1, (end - start).days // parts)
    out = []
    while start < end:
        nxt = min(end, Period.of(days, "day").after(start))
        out.append((start, nxt))
        start = nxt
    return out
