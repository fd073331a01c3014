"""Calendar periods with a unit, so that no interval is known by its text."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import datetime, timedelta


@dataclass(frozen=True)
class Period:
    """So many months plus an exact time span."""

    months: int = 0
    span: timedelta = timedelta()

    @staticmethod
    def of(n: int, unit: str) -> Period:
        unit = unit.rstrip("s")
        if unit in ("month", "quarter", "year"):
            return Period(months=n * {"month": 1, "quarter": 3, "year": 12}[unit])
        return Period(span=timedelta(**{f"{unit}s": n}))

    @property
    def unit(self) -> str | None:
        """The unit that windows are cut by, None for periods that aren't whole units."""
        if self.months and self.span:
            return None
        if self.months:
            return "month" if self.months % 12 else "year"
        if self.span and not self.span % timedelta(days=1):
            return "day"
        if self.span and not self.span % timedelta(hours=1):
            return "hour"
        return None

    def __bool__(self) -> bool:
        return bool(self.months or self.span)

    def after(self, t: datetime) -> datetime:
        return add_months(t, self.months) + self.span

    def before(self, t: datetime) -> datetime:
        return add_months(t, -self.months) - self.span


def add_months(t: datetime, n: int) -> datetime:
    """n months on; the day is that of the month's end if it doesn't exist."""
    if not n:
        return t
    year, month = divmod(t.year * 12 + t.month - 1 + n, 12)
    return t.replace(year=year, month=month + 1, day=min(t.day, calendar.monthrange(year, month + 1)[1]))


def floor(t: datetime, unit: str) -> datetime:
    """The start of the hour, day, month, quarter or year that holds t."""
    t = t.replace(minute=0, second=0, microsecond=0)
    if unit == "hour":
        return t
    t = t.replace(hour=0)
    if unit == "day":
        return t
    t = t.replace(day=1)
    if unit == "month":
        return t
    if unit == "quarter":
        return t.replace(month=(t.month - 1) // 3 * 3 + 1)
    if unit == "year":
        return t.replace(month=1)
    raise ValueError(f"unknown unit {unit!r}")
