"""Select lists and window predicates as Columns."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import Extraction, Grouping, Load, LoadSpec, SpecError
from .variables import literals

#: Types that a source may not have, and what it gives instead.
RELAXED = {"char": "string", "varchar": "string", "interval": "string", "array": "string", "variant": "string", "date": "timestamp_ntz", "timestamp": "timestamp_ntz", "time": "timestamp_ntz"}


def text_array(c: Column) -> Column:
    """`{a,b,"c,d",NULL}` as an array of texts; null for null, and for text without braces."""
    inner = F.regexp_extract(F.trim(c), r"^\{(.*)\}$", 1)
    items = F.regexp_extract_all(inner, F.lit(r'("(?:[^"\\]|\\.)*"|[^,]+)'), 1)
    plain = lambda x: F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, r'^"|"$', ""), r"\\(.)", "$1")).otherwise(F.when(F.upper(F.trim(x)) != "NULL", F.trim(x)))
    return F.when(F.trim(c).rlike(r"(?s)^\{.*\}$"), F.transform(items, plain))


def cast(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """``c`` as the target's type; texts become arrays through their elements."""
    if source == target:
        return c
    if isinstance(target, T.ArrayType) and isinstance(source, T.StringType):
        return text_array(c).cast(target)
    if isinstance(target, T.VariantType) and isinstance(source, T.StringType):
        return F.parse_json(c)
    return c.cast(target)


def select_list(source: DataFrame, target: T.StructType, transforms: Mapping[str, str] = {}, rename: Mapping[str, str] = {}) -> list[Column]:
    """Target columns in order: the transformation if there is one, else the source's column, cast.

    A target column that the source lacks raises at once.
    """
    have = {c.lower(): c for c in source.columns}
    out, missing = [], []
    for f in target:
        if f.name in transforms:
            out.append(F.expr(transforms[f.name]).cast(f.dataType).alias(f.name))
        elif (name := rename.get(f.name, f.name)).lower() in have:
            own = have[name.lower()]
            out.append(cast(F.col(f"`{own}`"), source.schema[own].dataType, f.dataType).alias(f.name))
        else:
            missing.append(name)
    if missing:
        raise SpecError(f"the source has no column {', '.join(missing)}")
    return out


def project(source: DataFrame, target: T.StructType, transforms: Mapping[str, str] = {}, grouping: Grouping | None = None, rename: Mapping[str, str] = {}, where: Column | None = None) -> DataFrame:
    """The select list over the filtered source; with a grouping, transformations may be aggregates."""
    df = source if where is None else source.where(where)
    columns = select_list(df, target, transforms, rename)
    if grouping is None:
        return df.select(*columns)
    if grouping.by:
        keys = [F.expr(transforms.get(k, f"`{rename.get(k, k)}`")).alias(k) for k in grouping.by]
        if missing := [f.name for f in target if f.name not in grouping.by and f.name not in transforms]:
            raise SpecError(f"neither grouped nor aggregated: {', '.join(missing)}")
        out = df.groupBy(*keys).agg(*[c for f, c in zip(target, columns) if f.name not in grouping.by])
        out = out.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in target])
    else:
        out = df.select(*columns)
    if grouping.having:
        out = out.where(grouping.having)
    if grouping.order_by:
        out = out.orderBy(*[F.expr(o[:-5]).desc_nulls_first() if o.lower().endswith(" desc") else F.expr(o).asc_nulls_last() for o in grouping.order_by])
    return out.limit(grouping.limit) if grouping.limit is not None else out


def between(field: Column, start: datetime, end: datetime) -> Column:
    """Half open."""
    return (field >= F.lit(start)) & (field < F.lit(end))


def _field(spec: LoadSpec, name: str, alias: str | None) -> Column:
    own = spec.source.rename.get(name, name)
    return F.col(f"{alias}.`{own}`" if alias else f"`{own}`")


def _qualified(text: str, spec: LoadSpec, alias: str | None) -> str:
    """Target names in a condition replaced by the source's, as whole words outside quotes."""
    names = spec.source.rename
    parts = re.split(r"('(?:[^']|'')*')", text)
    swap = lambda p: re.sub(r"(?<![\w.`])(\w+)(?![\w`(])", lambda m: f"{alias + '.' if alias else ''}`{names[m[1]]}`" if m[1] in names else m[1], p)
    return "".join(p if k % 2 else swap(p) for k, p in enumerate(parts))


def extract_condition(spec: LoadSpec, start: datetime | None, end: datetime | None, values: Mapping[str, object] = {}, extraction: Extraction | None = None, alias: str | None = None) -> Column | None:
    """What the source is filtered by; None for no filter.  A condition of the object replaces the window."""
    if spec.where:
        return F.expr(literals(_qualified(spec.where, spec, alias), values))
    kind = extraction or spec.extraction
    field = {Extraction.DELTA: spec.delta_field, Extraction.PARTITION: spec.bdate_field}.get(kind)
    if not field or start is None or end is None:
        return None
    return between(_field(spec, field, alias), start, end)


def load_condition(spec: LoadSpec, start: datetime | None, end: datetime | None, values: Mapping[str, object] = {}, load: Load | None = None, alias: str | None = None) -> Column | None:
    """What staged rows are filtered by when they are loaded; None without bounds or field."""
    if spec.where:
        return F.expr(literals(_qualified(spec.where, spec, alias), values))
    kind = load or spec.load
    field = spec.bdate_field if kind in (Load.PARTITION, Load.UPDATE_PARTITION) else None if kind is Load.FULL else spec.delta_field
    if not field or start is None or end is None:
        return None
    return between(_field(spec, field, alias), start, end)


def extent(df: DataFrame, *fields: str) -> tuple[int, dict[str, tuple]]:
    """Rows, and least and greatest value of each field, in one pass."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, f in enumerate(fields):
        aggs += [F.min(f).alias(f"lo{k}"), F.max(f).alias(f"hi{k}")]
    r = df.agg(*aggs).first()
    return r["n"], {f: (r[f"lo{k}"], r[f"hi{k}"]) for k, f in enumerate(fields)}


def min_value(df: DataFrame, field: str, where: str | None = None) -> str | None:
    v = (df.where(where) if where else df).agg(F.min(field).cast("string")).first()
    return v[0]


def max_value(df: DataFrame, field: str, where: str | None = None) -> str | None:
    v = (df.where(where) if where else df).agg(F.max(field).cast("string")).first()
    return v[0]


def external_schema(target: T.StructType, rename: Mapping[str, str] = {}, relaxed: Mapping[str, str] = {}) -> T.StructType:
    """The schema to read a source with: renamed, with types it may not have relaxed."""
    out = T.StructType()
    for f in target:
        kind = f.dataType.typeName() if not isinstance(f.dataType, (T.CharType, T.VarcharType)) else "char"
        text = relaxed.get(f.name) or RELAXED.get(kind if kind in RELAXED else "") or f.dataType.simpleString()
        out.add(rename.get(f.name, f.name), T._parse_datatype_string(text) if not isinstance(text, T.DataType) else text, True)
    return out
