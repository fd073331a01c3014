"""Keys and orders that the strategies share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def aside(df: DataFrame, other: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns renamed so that ``other`` has none of their names, and the new names.

    Strategies join tables that may come from the same reader; by names that
    are on one side only, no reference is ambiguous.
    """
    columns = list(columns or df.columns)
    names = dict(zip(columns, unused(other, *[f"_new_{c}" for c in columns])))
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def same(keys: Sequence[str], names: dict[str, str], null_safe: bool = True) -> Column:
    """Keys of both sides are equal; null equals null if ``null_safe``."""
    if not keys:
        raise ValueError("a merge key is needed")
    pairs = [F.col(f"`{k}`").eqNullSafe(F.col(f"`{names[k]}`")) if null_safe else F.col(f"`{k}`") == F.col(f"`{names[k]}`") for k in keys]
    return reduce(lambda a, b: a & b, pairs)


def without(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key ``other`` lacks; null keys are equal."""
    if not keys:
        raise ValueError("a merge key is needed")
    right, names = aside(other, df, keys)
    return df.join(right.distinct(), same(keys, names), "left_anti")


def in_order(df: DataFrame, target: DataFrame | T.StructType) -> DataFrame:
    """Columns of ``df`` by the target's names, in its order and types; one that is missing raises."""
    schema = target if isinstance(target, T.StructType) else target.schema
    have = {c.lower() for c in df.columns}
    if missing := [f.name for f in schema if f.name.lower() not in have]:
        raise ValueError(f"the source has no column {', '.join(missing)}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) if df.schema[[c for c in df.columns if c.lower() == f.name.lower()][0]].dataType != f.dataType else df[f.name].alias(f.name) for f in schema])


def sortable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType)) and not (isinstance(kind, T.ArrayType) and not sortable(kind.elementType)) and not (isinstance(kind, T.StructType) and not all(sortable(f.dataType) for f in kind))


def tie_break(df: DataFrame, delta: str | None = None, keys: Sequence[str] = (), nulls_last: bool = False) -> list[Column]:
    """A total order within a key: the delta field downward (nulls first unless asked), then all other columns downward."""
    down = lambda c: c.desc_nulls_last() if nulls_last else c.desc_nulls_first()
    rest = [F.col(f"`{f.name}`").desc_nulls_first() for f in df.schema if f.name != delta and f.name not in keys and sortable(f.dataType)]
    return [*([down(F.col(f"`{delta}`"))] if delta else []), *rest]


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``; null keys are keys."""
    (n,) = unused(df, "_nth")
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*(order or [F.lit(1)]))
    return df.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def unused(df: DataFrame, *names: str) -> list[str]:
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
