"""Names of tables and the objects derived from them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def unify(name: str) -> str:
    """Lower case, without ; / ' and outer blanks."""
    return name.translate(str.maketrans("", "", ";/'")).strip(" ").lower()


def unify_column(c: Column) -> Column:
    return F.lower(F.trim(F.translate(c, ";/'", "")))


def schema_of(name: str) -> str:
    """The part before the dot, '' if there is none."""
    left, dot, _ = unify(name).partition(".")
    return left if dot else ""


def table_of(name: str) -> str:
    left, dot, right = unify(name).partition(".")
    return right if dot else left


def _stage(name: str, object_id: int, prefix: str) -> str:
    schema = re.sub(r"^(src|stg|load)_", "", schema_of(name))
    return f"stg_{schema}.{prefix}{table_of(name)}_{object_id}"


def external(name: str, object_id: int) -> str:
    """Of the view over an object's source."""
    return _stage(name, object_id, "ext_")


def delta(name: str, object_id: int) -> str:
    """Of an object's staged rows."""
    return _stage(name, object_id, "delta_")


def export(name: str, object_id: int, schema: str | None = None) -> str:
    """Of an object's export; its schema is one setting for making and finding it."""
    return f"{schema or schema_of(name)}.ext_{table_of(name)}_{object_id}"


def backup(name: str) -> str:
    return f"{schema_of(name)}.bkp_{table_of(name)}" if schema_of(name) else f"bkp_{table_of(name)}"


def buffer(name: str, suffix: str = "") -> str:
    own = f"buffer_{table_of(name)}{'_' + suffix if suffix else ''}"
    return f"{schema_of(name)}.{own}" if schema_of(name) else own
