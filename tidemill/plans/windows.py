"""Load windows of an object, from its last watermark on.

A window is half open.  FULL and DELTA give one; ITER gives one for each
interval.  Bounds are widened to whole units of the interval first.  What a
safety period adds in front is read again, for rows that came late.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from ..spec import Extraction, LoadSpec, Mode, SpecError
from .periods import Period, floor

FIRST = {Mode.DELTA: datetime(1900, 1, 1), Mode.FULL: datetime(1900, 1, 1), Mode.ITER: datetime(2000, 1, 1)}


@dataclass(frozen=True)
class LoadWindow:
    start: datetime
    end: datetime


def widen(start: datetime, end: datetime, interval: Period | None) -> tuple[datetime, datetime]:
    """Whole units around start and end; by days, the end is the next day whatever the interval's length."""
    unit = interval.unit if interval else None
    if unit is None:
        return start, end
    if unit == "day":
        return floor(start, "day"), floor(end, "day") + timedelta(days=1)
    return floor(start, unit), interval.after(floor(end, unit))


def cut_windows(mode: Mode, start: datetime, end: datetime, interval: Period | None = None, safety: Period = Period()) -> list[LoadWindow]:
    """Windows between the bounds.  Daily windows stop before the day of the end, which isn't over yet."""
    mode = Mode(mode)
    start, end = widen(start, end, interval)
    if mode is Mode.FULL:
        return [LoadWindow(start, end)]
    if mode is Mode.DELTA:
        return [LoadWindow(safety.before(start), end)]
    if not interval:
        raise SpecError("ITER needs an interval")
    out = []
    if interval == Period(span=timedelta(days=1)):
        end -= timedelta(days=1)
    while start < end:
        nxt = interval.after(start)
        out.append(LoadWindow(safety.before(start), nxt))
        start = nxt
    return out


def first_start(spec: LoadSpec) -> datetime:
    own = spec.load_start if spec.extraction is Extraction.PARTITION else spec.delta_start
    return own or FIRST[spec.mode]


def safety(spec: LoadSpec) -> Period:
    return spec.bdate_safety if spec.extraction is Extraction.PARTITION else spec.delta_safety


def bounds(spec: LoadSpec, watermarks: list[datetime], now: datetime, start: datetime | None = None, end: datetime | None = None) -> tuple[datetime, datetime]:
    """The arguments if given, else from the last watermark before tomorrow (or the first start) to now."""
    tomorrow = floor(now, "day") + timedelta(days=1)
    past = [w for w in watermarks if w < tomorrow]
    return start or (max(past) if past else first_start(spec)), end or now
