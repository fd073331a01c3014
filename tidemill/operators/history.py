"""Type-2 history: one full outer join of open rows with a snapshot.

Rows of the target have a period [start, end]; open ones end at a far date.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, in_order, one_per_key, same, tie_break, unused

FAR = date(2999, 1, 1)


@dataclass(frozen=True)
class Scd2:
    keys: Sequence[str]
    as_of: date
    ignore: Sequence[str] = field(default_factory=tuple)
    start: str = "date_from"
    end: str = "date_to"
    far: date = FAR
    #: Open rows whose key the source lacks are closed; only right if the source is a whole snapshot.
    detect_deleted: bool = True
    #: Of several source rows with a key, the one with the greatest value of this column counts, then by all columns.
    delta: str | None = None

    def attributes(self, target: DataFrame) -> list[str]:
        fixed = {*self.keys, *self.ignore, self.start, self.end}
        return [c for c in target.columns if c not in fixed]


def _sides(target: DataFrame, source: DataFrame, how: Scd2):
    open_ = target.where(F.col(how.end) == F.lit(how.far))
    body = [f for f in target.schema if f.name not in (how.start, how.end)]
    rows = in_order(source, type(target.schema)(body))
    # a key that a snapshot repeats opens one row; null keys are keys
    return open_, one_per_key(rows, how.keys, tie_break(rows, how.delta, how.keys))


def classify(target: DataFrame, source: DataFrame, how: Scd2) -> tuple[DataFrame, dict[str, str], str]:
    """The join of open rows and source, the names of the source's columns in it, and that of the pair's state.

    changed: in both, an attribute differs; new: in the source only; deleted:
    in the target only; same: the rest.  A difference in ignored attributes
    only is none, and the target's values stay.  Null equals null, in keys too.
    """
    open_, rows = _sides(target, source, how)
    new, names = aside(rows, target)
    here, there, state = unused(target, "_here", "_there", "_state")
    both = open_.withColumn(here, F.lit(True)).join(new.withColumn(there, F.lit(True)), same(how.keys, names), "full_outer")
    differs = reduce(lambda a, b: a | b, [~F.col(f"`{n}`").eqNullSafe(F.col(f"`{names[n]}`")) for n in how.attributes(target)], F.lit(False))
    kind = F.when(F.col(here).isNull(), "new").when(F.col(there).isNull(), "deleted" if how.detect_deleted else "same").when(differs, "changed").otherwise("same")
    return both.withColumn(state, kind), names, state


def _access(names: dict[str, str]):
    return (lambda n: F.col(f"`{n}`")), (lambda n: F.col(f"`{names[n]}`"))


def scd2(target: DataFrame, source: DataFrame, how: Scd2) -> DataFrame:
    """The target's history with the source as of ``how.as_of``.

    Changed rows close the day before and open anew; if they opened that same
    day they are overwritten without history.  Deleted rows close the day
    before; if they opened that same day they go, as they never held for a whole day.
    Closed rows stay as they are.
    """
    both, names, state = classify(target, source, how)
    c, s = _access(names)
    day, before, far = F.lit(how.as_of), F.date_sub(F.lit(how.as_of), 1), F.lit(how.far)
    kind = {f.name: f.dataType for f in target.schema}
    old = lambda end: F.struct(*[(end.cast(kind[n]) if n == how.end else c(n)).alias(n) for n in target.columns])
    new = F.struct(*[(day.cast(kind[n]) if n == how.start else far.cast(kind[n]) if n == how.end else s(n)).alias(n) for n in target.columns])
    earlier = c(how.start) < day.cast(kind[how.start])
    rows = (
        F.when(F.col(state) == "same", F.array(old(far)))
        .when(F.col(state) == "new", F.array(new))
        .when((F.col(state) == "changed") & earlier, F.array(old(before), new))
        .when(F.col(state) == "changed", F.array(new))
        .when(earlier, F.array(old(before)))
    )
    fresh = both.select(F.inline(rows)).select(*target.columns)
    closed = target.where(~F.col(how.end).eqNullSafe(F.lit(how.far)))
    return closed.unionByName(fresh)


def part(target: DataFrame, source: DataFrame, how: Scd2, which: str) -> DataFrame:
    """One of the sets of a history load: changed, new, deleted, history, actual."""
    both, names, state = classify(target, source, how)
    c, s = _access(names)
    if which in ("changed", "new"):
        own = both.where(F.col(state) == which)
        return own.select(*[(F.lit(how.as_of) if n == how.start else F.lit(how.far) if n == how.end else s(n)).cast(target.schema[n].dataType).alias(n) for n in target.columns])
    closing = F.date_sub(F.lit(how.as_of), 1)
    close = lambda df: df.select(*[closing.cast(target.schema[n].dataType).alias(n) if n == how.end else c(n).alias(n) for n in target.columns])
    earlier = c(how.start) < F.lit(how.as_of).cast(target.schema[how.start].dataType)
    if which == "deleted":
        return close(both.where((F.col(state) == "deleted") & earlier))
    if which == "history":
        return close(both.where(F.col(state).isin("changed", "deleted") & earlier))
    if which == "actual":
        return scd2(target.where(F.col(how.end) == F.lit(how.far)), source, how).where(F.col(how.end) == F.lit(how.far))
    raise ValueError(f"unknown set {which!r}")
