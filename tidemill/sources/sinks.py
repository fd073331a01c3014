"""Export of a table's rows and their publication at the sink."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from ..functions.expressions import extent, extract_condition
from ..operators import load_partitions, replace_all, upsert
from ..operators.ranges import touched
from ..spec import Load, LoadSpec, SpecError
from ..store import TableStore
from . import embedded

EXPORTS = (Load.FULL, Load.DELTA_UPSERT, Load.UPDATE_PARTITION)


def check(spec: LoadSpec) -> LoadSpec:
    if spec.load not in EXPORTS:
        raise SpecError(f"{spec.name}: an export is one of {', '.join(x.value for x in EXPORTS)}")
    return spec.check()


def exported(table: DataFrame, spec: LoadSpec, start: datetime | None = None, end: datetime | None = None, values: Mapping[str, object] = {}) -> DataFrame:
    """The table's rows of the window, all columns."""
    condition = extract_condition(spec, start, end, values)
    return table if condition is None else table.where(condition)


def published(sink: DataFrame, rows: DataFrame, spec: LoadSpec) -> DataFrame:
    """What the sink holds, or its touched partitions hold, after the export."""
    check(spec)
    if spec.load is Load.FULL:
        return replace_all(sink, rows)
    if spec.load is Load.DELTA_UPSERT:
        return upsert(sink, rows, spec.merge_key)
    return load_partitions(sink, rows, spec.bdate_field, spec.period, spec.merge_key)


def to_store(store: TableStore, name: str, rows: DataFrame, spec: LoadSpec) -> None:
    """Publish at another store; of its partitions only touched ones are opened."""
    v = store.version(name)
    if spec.load is Load.UPDATE_PARTITION and v.field:
        parts = touched(rows, v.field, v.period)
        store.replace_partitions(name, load_partitions(store.read(name, parts), rows, v.field, v.period, spec.merge_key, parts=parts))
    else:
        store.replace(name, published(store.read(name), rows, spec))


class JdbcSink:
    """Tables of a database that an export's load type keeps up to date.

    Rows go to a stage table by a bounded number of connections.  One
    transaction then takes the rows that they replace out of the table and
    puts them in, so readers of the database see the old rows or the new ones.
    A database inside the driver's process has one connection in a cluster.
    """

    def __init__(self, spark: SparkSession, url: str, properties: Mapping[str, str] = {}, connections: int = 8):
        self.spark, self.url, self.properties, self.connections = spark, url, dict(properties), connections

    def read(self, table: str) -> DataFrame:
        if embedded.driver_only(self.spark, self.url):
            return embedded.read(self.spark, {**self.properties, "url": self.url, "dbtable": table})
        return self.spark.read.jdbc(self.url, table, properties=self.properties)

    def statements(self, table: str, stage: str, columns: Sequence[str], spec: LoadSpec, nulls: Sequence[str] | None = None) -> list[str]:
        """SQL that replaces what the staged rows replace: all rows, those of their keys, or of their keys in their partitions.

        nulls: the keys that are null in some staged row; any of them, if it isn't given.
        """
        names = ", ".join(f'"{c}"' for c in columns)
        insert = f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage}"
        if spec.load is Load.FULL:
            return [f"DELETE FROM {table}", insert]
        part = f" AND {self._same_part(table, spec)}" if spec.load is Load.UPDATE_PARTITION else ""
        index = f"CREATE INDEX {stage}_keys ON {stage} ({', '.join(f'"{k}"' for k in spec.merge_key)})"
        return [index, *(f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {stage} s WHERE {same}{part})" for same in self._equal(table, spec.merge_key, spec.merge_key if nulls is None else nulls)), insert]

    @staticmethod
    def _equal(table: str, keys: Sequence[str], nulls: Sequence[str]) -> list[str]:
        """Equal keys, null ones included: a condition for each choice of null ones, as an index doesn't serve an OR."""
        return [" AND ".join(f'{table}."{k}" IS NULL AND s."{k}" IS NULL' if null else f'{table}."{k}" = s."{k}"' for k, null in zip(keys, chosen)) for chosen in product(*[(False, True) if k in nulls else (False,) for k in keys])]

    @staticmethod
    def _same_part(table: str, spec: LoadSpec) -> str:
        units = {"day": ("YEAR", "MONTH", "DAY"), "month": ("YEAR", "MONTH"), "year": ("YEAR",)}.get(spec.period)
        if units is None:
            raise SpecError(f"{spec.name}: a database sink has partitions of a day, month or year")
        c = spec.bdate_field
        same = " AND ".join(f'{u}({table}."{c}") = {u}(s."{c}")' for u in units)
        return f'(({same}) OR ({table}."{c}" IS NULL AND s."{c}" IS NULL))'

    def publish(self, table: str, rows: DataFrame, spec: LoadSpec) -> None:
        check(spec)
        table = table.replace(".", "_")
        stage = f"{table}_stage"
        to_jdbc(rows, self.url, stage, self.properties, "overwrite", self.connections)
        connection = self._connect()
        try:
            connection.setAutoCommit(False)
            if not self._exists(connection, table):
                names = ", ".join(f'"{c}"' for c in rows.columns)
                self._run(connection, f"CREATE TABLE {table} AS SELECT {names} FROM {stage} WITH NO DATA")
            nulls = [] if spec.load is Load.FULL else self._nulls(connection, stage, spec.merge_key)
            for text in self.statements(table, stage, rows.columns, spec, nulls):
                self._run(connection, text)
            connection.commit()
            self._run(connection, f"DROP TABLE {stage}")
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def _connect(self):
        jvm = self.spark.sparkContext._jvm
        properties = jvm.java.util.Properties()
        for k, v in self.properties.items():
            properties.setProperty(k, v)
        return jvm.java.sql.DriverManager.getConnection(self.url, properties)

    @staticmethod
    def _exists(connection, table: str) -> bool:
        found = connection.getMetaData().getTables(None, None, None, None)
        try:
            while found.next():
                if found.getString("TABLE_NAME").lower() == table.lower():
                    return True
            return False
        finally:
            found.close()

    @staticmethod
    def _nulls(connection, stage: str, keys: Sequence[str]) -> list[str]:
        statement = connection.createStatement()
        try:
            found = statement.executeQuery(f"SELECT {', '.join(['COUNT(*)', *(f'COUNT("{k}")' for k in keys)])} FROM {stage}")
            found.next()
            return [k for i, k in enumerate(keys) if found.getLong(i + 2) < found.getLong(1)]
        finally:
            statement.close()

    @staticmethod
    def _run(connection, text: str) -> None:
        statement = connection.createStatement()
        try:
            statement.execute(text)
        finally:
            statement.close()


def to_jdbc(rows: DataFrame, url: str, table: str, properties: Mapping[str, str] = {}, mode: str = "append", connections: int = 8) -> None:
    """Rows by a bounded number of connections; by one of the driver's if tasks can't reach the database."""
    if embedded.driver_only(rows.sparkSession, url):
        return embedded.write(rows, url, table, properties, mode)
    rows.coalesce(connections).write.jdbc(url, table, mode=mode, properties=dict(properties))


def to_files(rows: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite", **options: str) -> None:
    rows.write.format(format).mode(mode).options(**options).save(path)


def watermark(rows: DataFrame, field: str | None, start: datetime | None) -> tuple[int, datetime | None]:
    """(rows, greatest value of the field); the window's start if there are none, so that it doesn't move."""
    n, found = extent(rows, *([field] if field else []))
    return n, (found[field][1] if field and n and found[field][1] is not None else start)
