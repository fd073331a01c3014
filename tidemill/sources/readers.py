"""Sources as lazy DataFrames: files, JDBC in ranges, pages, views, callables."""

from __future__ import annotations

import re
from contextlib import contextmanager
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.expressions import external_schema
from ..operators.common import unused
from ..functions.variables import expand
from ..plans.partitions import enumerate_days, split
from ..spec import Extraction, LoadSpec, SpecError
from ..store import TableStore
from . import embedded

CORRUPT = "_corrupt_record"


class Rejected(RuntimeError):
    """More bad rows than the source may have."""


@contextmanager
def rejecting(name: str) -> Iterator[None]:
    """Jobs in which a bad row of a text file raises ``Rejected``."""
    try:
        yield
    except Exception as e:
        if "MALFORMED_RECORD" in str(e):
            raise Rejected(f"{name}: a bad row, none allowed") from e
        raise


def connection(spec: LoadSpec, values: Mapping[str, object], override: Mapping[str, str] | None = None) -> dict[str, str]:
    """Reader options: an active override beats the object's own; $variables are replaced."""
    own = dict(override) if override is not None else dict(spec.source.options)
    return {k: expand(v, values) for k, v in own.items()}


def ranges(spec: LoadSpec, start: datetime | None, end: datetime | None) -> list[str]:
    """Predicates that cut an extraction window, read side by side; none for full extractions."""
    name = {Extraction.DELTA: spec.delta_field, Extraction.PARTITION: spec.bdate_field}.get(spec.extraction)
    if not name or start is None or end is None:
        return []
    field = spec.source.rename.get(name, name)
    if spec.source.enumerate_days:
        return enumerate_days(field, spec.source.enumerate_days, start, end)
    return [f"{field} >= '{a:%Y-%m-%d %H:%M:%S}' AND {field} < '{b:%Y-%m-%d %H:%M:%S}'" for a, b in split(start, end, spec.source.splits)]


def read_files(spark: SparkSession, spec: LoadSpec, schema: T.StructType | None, values: Mapping[str, object] = {}) -> DataFrame:
    """Parquet, ORC, CSV or JSON by explicit schema.

    Bad rows of text formats are counted against the limit, for which they are
    parsed twice; without a limit they are parsed once, and a bad one makes the
    job fail that reads it (see ``rejecting``).
    """
    options, path, kind = connection(spec, values), expand(spec.source.path, values), spec.source.format
    if not path:
        raise SpecError(f"{spec.name}: no path")
    if schema is not None:
        schema = external_schema(schema, spec.source.rename, spec.source.relaxed)
    if kind in ("csv", "json"):
        if schema is None:
            raise SpecError(f"{spec.name}: {kind} needs a schema")
        reader = spark.read.options(**options).format(kind).option("columnPruning", "false")
        if not spec.source.reject_limit:
            # one pass: the first bad row ends the job that reads it
            return reader.schema(schema).option("mode", "FAILFAST").load(path)
        rows = reader.schema(T.StructType([*schema, T.StructField(CORRUPT, T.StringType())])).option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE").load(path)
        # all columns are looked at, as a row is bad by any of them; nothing is kept between the two passes
        bad = rows.agg(F.count(F.when(F.col(CORRUPT).isNotNull(), 1)), F.max(F.xxhash64(*[F.col(f"`{f.name}`") for f in schema]))).first()[0]
        if bad > spec.source.reject_limit:
            raise Rejected(f"{spec.name}: {bad} bad rows, {spec.source.reject_limit} allowed")
        return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    reader = spark.read.options(**options).format(kind)
    return (reader.schema(schema) if schema is not None and spec.source.relaxed else reader).load(path)


def read_jdbc(spark: SparkSession, spec: LoadSpec, values: Mapping[str, object], start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """A partition for each range of the window, so that no connection reads it all.

    A database inside the driver's process is read there, range by range, before this returns.
    """
    options = connection(spec, values)
    predicates = ranges(spec, start, end)
    if embedded.driver_only(spark, options.get("url", "")):
        return embedded.read(spark, options, predicates)
    if not predicates:
        return spark.read.format("jdbc").options(**options).load()
    url, table = options.pop("url"), options.pop("dbtable")
    return spark.read.jdbc(url, table, predicates=predicates, properties=options)


def split_reads(df: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """The same of a DataFrame: rows of any of the ranges.

    One scan, as Spark splits files among tasks by itself; the predicates
    reach it together and prune files and row groups.
    """
    return df.where(" OR ".join(f"({p})" for p in predicates)) if predicates else df


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class PagedReader(DataSourceReader):
    def __init__(self, fetch: Callable[[int], Sequence[tuple]], pages: int):
        self.fetch, self.pages = fetch, pages

    def partitions(self) -> list[InputPartition]:
        return [Page(k) for k in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.fetch(partition.value)


def paged(name: str, schema: str, fetch: Callable[[int], Sequence[tuple]], pages: int) -> type[DataSource]:
    """A data source with a task for each page; a page that fails is fetched again by Spark's retries.

    Register it with ``spark.dataSource.register`` and read it by ``name``.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return PagedReader(fetch, pages)

    return Paged


def read_pages(store: TableStore, name: str, fetch: Callable[[int], Sequence[tuple]], wave: int = 16, progress: Callable[[int], None] | None = None) -> int:
    """Append the pages of a source to a table until one is empty; the number of rows.

    The number of pages need not be known.  Pages of a wave are fetched side by
    side, a task for each, and become current together.  ``progress`` is told the
    running number of rows after each wave; -1 if a page fails, and then no later
    page is fetched.
    """
    spark, schema = store.spark, store.version(name).schema
    (page,) = unused(store.read(name), "_page")
    kind = to_arrow_schema(T.StructType([T.StructField(page, T.LongType()), *schema]))
    staged = f"{name}__wave"
    total, first = 0, 0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in b.column(0).to_pylist():
                got = [(n, *r) for r in fetch(n)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), kind)], schema=kind)

    while True:
        tasks = spark.range(first, first + wave, 1, wave).mapInArrow(rows, T.StructType([T.StructField(page, T.LongType()), *schema]))
        try:
            store.create_as(staged, tasks)
        except Exception:
            if progress:
                progress(-1)
            raise
        found = {r[0]: r[1] for r in store.read(staged).groupBy(page).count().collect()}
        last = next((n for n in range(first, first + wave) if n not in found), None)
        new = store.read(staged).where(F.col(page) < (first + wave if last is None else last)).drop(page)
        store.append(name, new)
        total += sum(c for n, c in found.items() if last is None or n < last)
        if progress:
            progress(total)
        if last is not None:
            store.drop(staged)
            return total
        first += wave


class Functions:
    """Callables that configurations name; nothing is imported or run by text."""

    def __init__(self):
        self._known: dict[str, Callable] = {}

    def register(self, name: str, f: Callable) -> Callable:
        self._known[name] = f
        return f

    def __getitem__(self, name: str) -> Callable:
        if name not in self._known:
            raise SpecError(f"unknown function {name!r}")
        return self._known[name]

    def call(self, text: str, context) -> object:
        """Call `name` or `name(a, 'b', $variable)`: the context first, then the arguments as texts, variables replaced."""
        m = re.fullmatch(r"\s*([\w.]+)\s*(?:\((.*)\))?\s*", text, re.S)
        if not m:
            raise SpecError(f"{text!r} names no function")
        given = re.findall(r"'((?:[^']|'')*)'|([^,'\s][^,']*)", m[2] or "")
        args = [a.replace("''", "'") if a else b.strip() for a, b in given]
        return self[m[1]](context, *[expand(a, context.values) for a in args])

    def __contains__(self, name: str) -> bool:
        return name in self._known
