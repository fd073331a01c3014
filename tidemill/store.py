"""Versioned Parquet tables on a path.

A version is a manifest: for each partition, the folders that hold its rows.
Data goes to new folders first; then the manifest is written, and one rename
makes it the current one.  A crash before that leaves the old version as it
was.  Partitions that a load doesn't touch keep their folders, so they are
neither read nor copied.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import Files
from .operators.common import in_order, unused
from .plans.partitions import DEFAULT, Partition, key, of_value, overlapping, segments

CURRENT = "CURRENT"


class TableMissing(KeyError):
    pass


@dataclass(frozen=True)
class Version:
    number: int
    schema: T.StructType
    field: str | None = None
    period: str | None = None
    parts: dict[str, list[str]] = dataclasses.field(default_factory=dict)
    previous: int | None = None
    #: Columns by which rows are spread over files and sorted in them.
    keys: tuple[str, ...] = ()
    #: What a writer wants to keep with the data, such as the last batch of a stream.
    marks: dict[str, int] = dataclasses.field(default_factory=dict)
    #: Of this table's files, if it isn't that of the store.
    compression: str | None = None

    def text(self) -> str:
        return json.dumps({"number": self.number, "schema": self.schema.jsonValue(), "field": self.field, "period": self.period, "parts": self.parts, "previous": self.previous, "keys": list(self.keys), "marks": self.marks, "compression": self.compression})

    @staticmethod
    def of(text: str) -> Version:
        x = json.loads(text)
        return Version(**x | {"schema": T.StructType.fromJson(x["schema"]), "keys": tuple(x.get("keys", ()))})


class TableStore:
    """Tables below a folder.  One writer for each table at a time; readers need no lock."""

    def __init__(self, spark: SparkSession, root: str, compression: str = "zstd", rows_per_file: int = 0):
        self.spark, self.root, self.compression, self.rows_per_file = spark, root.rstrip("/"), compression, rows_per_file
        self._temporary: set[str] = set()

    def _files(self, name: str) -> Files:
        return Files(self.spark, f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._files(name).exists(CURRENT)

    def version(self, name: str, number: int | None = None) -> Version:
        files = self._files(name)
        if not files.exists(CURRENT):
            raise TableMissing(name)
        return Version.of(files.read(f"v{number}.json" if number is not None else CURRENT))

    def create(self, name: str, schema: T.StructType, field: str | None = None, period: str | None = None, replace: bool = False, keys: Sequence[str] = (), compression: str | None = None, temporary: bool = False) -> None:
        """An empty table, partitioned by a period of ``field`` if one is named.

        ``keys`` spread rows over files and sort them there, so that readers of
        a few keys skip what the files' statistics exclude.  ``temporary`` tables
        go with ``close``.
        """
        if field:
            segments(period or "")
        if unknown := {*keys, *([field] if field else [])} - set(schema.names):
            raise ValueError(f"{name} has no column {', '.join(sorted(unknown))}")
        if self.exists(name) and not replace:
            raise ValueError(f"{name} exists")
        number = self.version(name).number + 1 if self.exists(name) else 1
        self._publish(name, Version(number, schema, field, period, {}, number - 1 or None, tuple(keys), compression=compression))
        if temporary:
            self._temporary.add(name)

    def close(self) -> None:
        """Drop the temporary tables that this store made."""
        while self._temporary:
            self.drop(self._temporary.pop())

    def create_like(self, name: str, other: str, replace: bool = True) -> None:
        if name == other:
            raise ValueError("a table can't be made like itself")
        v = self.version(other)
        self.create(name, v.schema, v.field, v.period, replace, v.keys, v.compression)

    def create_as(self, name: str, df: DataFrame, field: str | None = None, period: str | None = None) -> int:
        """A table of a query's rows; the number of rows."""
        self.create(name, df.schema, field, period, replace=True)
        before = self.version(name)
        self.replace(name, df)
        return self.written(name, before)

    def written(self, name: str, since: Version) -> int:
        """Rows in the folders that were added after a version: their files' footers tell, others aren't opened."""
        v, old = self.version(name), {d for ds in since.parts.values() for d in ds}
        new = [f"{self.root}/{name}/{d}" for ds in v.parts.values() for d in ds if d not in old]
        return self.spark.read.schema(v.schema).parquet(*new).count() if new else 0

    def read(self, name: str, parts: Sequence[str] | None = None, number: int | None = None) -> DataFrame:
        """The rows, or those of some partitions: other partitions aren't looked at."""
        v = self.version(name, number)
        where = [f"{self.root}/{name}/{d}" for p, ds in sorted(v.parts.items()) if parts is None or p in parts for d in ds]
        if not where:
            return self.spark.createDataFrame([], v.schema)
        return self.spark.read.schema(v.schema).parquet(*where)

    def partitions(self, name: str) -> list[Partition]:
        v = self.version(name)
        return sorted(of_value(datetime.fromisoformat(p), v.period) for p in v.parts if v.period and p != DEFAULT)

    def _write(self, name: str, v: Version, df: DataFrame) -> dict[str, list[str]]:
        """New folders by partition; all partitions are written by one job."""
        batch = f"data/{uuid.uuid4().hex}"
        rows = in_order(df, v.schema)
        if v.keys:
            by = [F.col(f"`{k}`") for k in v.keys]
            rows = rows.repartition(*by).sortWithinPartitions(*([key(F.col(f"`{v.field}`"), v.period)] if v.field else []), *by)
        writer = lambda x: x.write.option("compression", v.compression or self.compression).option("maxRecordsPerFile", self.rows_per_file)
        if not v.field:
            writer(rows).parquet(f"{self.root}/{name}/{batch}")
            return {"": [batch]}
        (p,) = unused(rows, "_part")
        placed = rows.withColumn(p, key(F.col(f"`{v.field}`"), v.period))
        # partitions are split and joined to tasks of the session's advised size, as the rows that arrive have it
        writer(placed if v.keys else placed.hint("rebalance", p)).partitionBy(p).parquet(f"{self.root}/{name}/{batch}")
        made = [x for x in self._files(name).names(batch) if x.startswith(f"{p}=")]
        return {x.partition("=")[2]: [f"{batch}/{x}"] for x in made}

    def _publish(self, name: str, v: Version) -> None:
        files = self._files(name)
        if not files.create(f"v{v.number}.json", v.text()):
            if files.exists(CURRENT) and Version.of(files.read(CURRENT)).number >= v.number:
                raise RuntimeError(f"{name}: version {v.number} was published by another writer")
            files.replace(f"v{v.number}.json", v.text())  # left by a writer that died before the next line
        files.replace(CURRENT, v.text())

    def _next(self, v: Version, parts: dict[str, list[str]]) -> Version:
        return dataclasses.replace(v, number=v.number + 1, parts=parts, previous=v.number)

    def replace(self, name: str, df: DataFrame, **marks: int) -> None:
        """All rows; the version before stays readable as the backup."""
        v = self._marked(name, marks)
        self._publish(name, self._next(v, self._write(name, v, df)))

    def _marked(self, name: str, marks: dict[str, int]) -> Version:
        v = self.version(name)
        return dataclasses.replace(v, marks={**v.marks, **marks})

    def append(self, name: str, df: DataFrame, **marks: int) -> None:
        """Further rows; ``marks`` become current with them, in one step."""
        v = self._marked(name, marks)
        parts = {p: list(d) for p, d in v.parts.items()}
        for p, d in self._write(name, v, df).items():
            parts.setdefault(p, []).extend(d)
        self._publish(name, self._next(v, parts))

    def insert(self, name: str, df: DataFrame, where: str | None = None, truncate: bool = False) -> int:
        """Add rows by position of their columns, not by name; the number of rows.  ``truncate`` replaces all rows."""
        v = self.version(name)
        if len(df.columns) != len(v.schema):
            raise ValueError(f"{name} has {len(v.schema)} columns, the rows {len(df.columns)}")
        rows = (df.where(where) if where else df).toDF(*v.schema.names)
        (self.replace if truncate else self.append)(name, rows)
        return self.written(name, v)

    def insert_query(self, name: str, query: str, truncate: bool = False) -> int:
        return self.insert(name, self.spark.sql(query), truncate=truncate)

    def switch_default(self, name: str, other: str) -> bool:
        """Put another table's rows in place of the default partition; False, and nothing done, if it has none."""
        v, rows = self.version(name), self.read(other)
        if rows.isEmpty():
            return False
        if v.field and not rows.where(key(F.col(f"`{v.field}`"), v.period) != DEFAULT).isEmpty():
            raise ValueError(f"{other} has rows that belong to other partitions of {name}")
        new = self._write(name, v, rows)
        self._publish(name, self._next(v, {**v.parts, **new}))
        return True

    def statistics(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        """(column, rows, nulls, about how many distinct, least, greatest) in one pass."""
        df = self.read(name)
        names = [f.name for f in df.schema if (columns is None or f.name in columns) and isinstance(f.dataType, T.AtomicType)]
        each = [F.struct(F.lit(n).alias("column"), F.count(F.lit(1)).alias("rows"), F.sum(F.col(f"`{n}`").isNull().cast("long")).alias("nulls"), F.approx_count_distinct(f"`{n}`").alias("distinct"), F.min(f"`{n}`").cast("string").alias("least"), F.max(f"`{n}`").cast("string").alias("greatest")) for n in names]
        return df.agg(F.array(*each).alias("s")).select(F.inline("s"))

    def analyze(self, name: str, columns: Sequence[str] | None = None) -> dict[str, dict]:
        """Compute ``statistics`` and keep them with the table, with the number of the version they hold for."""
        rows = {r["column"]: r.asDict() for r in self.statistics(name, columns).collect()}
        self._files(name).replace("STATISTICS", json.dumps({"version": self.version(name).number, "columns": rows}))
        return rows

    def known_statistics(self, name: str) -> dict | None:
        """What ``analyze`` kept, None if nothing was kept or the table has changed since."""
        files = self._files(name)
        x = json.loads(files.read("STATISTICS")) if files.exists("STATISTICS") else None
        return x["columns"] if x and x["version"] == self.version(name).number else None

    def distribution_key(self, name: str) -> tuple[str, ...]:
        """The columns by which rows are spread and sorted."""
        return self.version(name).keys

    def describe(self, name: str) -> dict[str, object]:
        v = self.version(name)
        return {"format": "parquet", "compression": v.compression or self.compression, "version": v.number, "partition_key": v.field, "period": v.period, "partitions": len(v.parts), "keys": list(v.keys), "columns": {f.name: f.dataType.simpleString() for f in v.schema}}

    def replace_partitions(self, name: str, df: DataFrame, **marks: int) -> list[str]:
        """Partitions for which ``df`` has rows; the others keep their files.  The names of those replaced."""
        v = self._marked(name, marks)
        if not v.field:
            raise ValueError(f"{name} has no partitions")
        new = self._write(name, v, df)
        self._publish(name, self._next(v, {**v.parts, **new}))
        return sorted(new)

    def switch_partition(self, name: str, part: str | datetime, other: str) -> None:
        """Put another table's rows in place of one partition, once they are found to belong there."""
        v = self.version(name)
        p = self._named(v, part)
        rows = self.read(other)
        if not rows.where(key(F.col(f"`{v.field}`"), v.period) != p).isEmpty():
            raise ValueError(f"{other} has rows outside partition {p} of {name}")
        new = self._write(name, v, rows)
        self._publish(name, self._next(v, {**{k: d for k, d in v.parts.items() if k != p}, **new}))

    def _named(self, v: Version, part: str | datetime) -> str:
        if not v.field:
            raise ValueError("the table has no partitions")
        found = of_value(part, v.period) if isinstance(part, datetime) else None
        p = part if isinstance(part, str) else found.start.strftime("%Y-%m-%d") if found else DEFAULT
        if p not in v.parts:
            raise KeyError(f"no partition {p}")
        return p

    def drop_range(self, name: str, start: datetime, end: datetime) -> list[str]:
        """Forget the partitions that overlap [start, end]; a step of the manifest, no data is read."""
        v = self.version(name)
        gone = {p.start.strftime("%Y-%m-%d") for p in overlapping(self.partitions(name), start, end)}
        self._publish(name, self._next(v, {p: d for p, d in v.parts.items() if p not in gone}))
        return sorted(gone)

    def truncate_range(self, name: str, start: datetime, end: datetime) -> list[str]:
        """Empty those partitions but keep them known."""
        v = self.version(name)
        gone = {p.start.strftime("%Y-%m-%d") for p in overlapping(self.partitions(name), start, end)}
        self._publish(name, self._next(v, {p: [] if p in gone else d for p, d in v.parts.items()}))
        return sorted(gone)

    def truncate(self, name: str) -> None:
        v = self.version(name)
        self._publish(name, self._next(v, {}))

    def rollback(self, name: str) -> None:
        """The version before the current one becomes a new version."""
        v = self.version(name)
        if v.previous is None:
            raise ValueError(f"{name} has one version only")
        self._publish(name, self._next(v, self.version(name, v.previous).parts))

    def drop(self, name: str) -> bool:
        return self._files(name).delete("")

    def vacuum(self, name: str, keep: int = 2) -> int:
        """Delete data that none of the last ``keep`` versions names; the number of folders deleted."""
        v, used, files = self.version(name), set(), self._files(name)
        for n in range(max(1, v.number - keep + 1), v.number + 1):
            used |= {d.split("/")[1] for ds in self.version(name, n).parts.values() for d in ds}
        gone = [d for d in files.names("data") if d not in used]
        for d in gone:
            files.delete(f"data/{d}")
        for n in range(1, v.number - keep + 1):
            files.delete(f"v{n}.json")
        return len(gone)

    def tables(self) -> list[str]:
        return [t for t in Files(self.spark, self.root).names() if self.exists(t)]

    def view(self, name: str) -> None:
        self.read(name).createOrReplaceTempView(name.replace(".", "_"))
