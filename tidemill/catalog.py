"""Dump of definitions: tables, views, specifications, chains and dictionaries as files."""

from __future__ import annotations

import dataclasses
import json
from datetime import datetime
from enum import Enum
from pathlib import Path

from pyspark.sql import SparkSession

from .files import Files, LocalFiles
from .registry import Registry
from .spec import Extraction, Load, Method, Mode, Status
from .store import TableStore


def _plain(x):
    if isinstance(x, Enum):
        return x.value
    if isinstance(x, datetime):
        return x.isoformat()
    if dataclasses.is_dataclass(x):
        return {f.name: _plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return str(x) if not isinstance(x, (int, float, str, bool, type(None))) else x


def ddl(store: TableStore, name: str) -> str:
    v = store.version(name)
    columns = ",\n".join(f"    {f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in v.schema)
    part = f"\n-- partitioned by {v.period} of {v.field}" if v.field else ""
    return f"CREATE TABLE {name} (\n{columns}\n) USING PARQUET;{part}\n"


def dump(root: str | Path, store: TableStore | None = None, registry: Registry | None = None, spark: SparkSession | None = None) -> list[str]:
    """Write a folder for each kind of object and a changelog that includes all files; their names.

    With a session, the path may name any file system, and the catalog's tables and views are written too.
    """
    files, made = Files(spark, str(root)) if spark else LocalFiles(root), []

    def put(name: str, text: str) -> None:
        files.replace(name, text)
        made.append(name)

    if store:
        for t in store.tables():
            put(f"tables/{t}.sql", ddl(store, t))
    if spark:
        for t in spark.catalog.listTables():
            if not t.isTemporary:
                put(f"{'views' if t.tableType == 'VIEW' else 'tables'}/{t.name}.sql", spark.sql(f"SHOW CREATE TABLE `{t.name}`").first()[0] + ";\n")
    if registry:
        for s in registry.active():
            put(f"objects/{s.object_id}.json", json.dumps(_plain(s), indent=1))
        put("chains.json", json.dumps(_plain(list(registry.chains.values())), indent=1))
        put("dependencies.json", json.dumps([list(e) for e in registry.dependencies], indent=1))
        put("constants.json", json.dumps(registry.constants, indent=1))
        for kind in (Extraction, Load, Mode, Method, Status):
            put(f"dictionaries/{kind.__name__.lower()}.json", json.dumps({x.name: x.value for x in kind}, indent=1))
    put("changelog.yaml", "databaseChangeLog:\n" + "".join(f"  - include:\n      file: {n}\n" for n in sorted(made)))
    return made
