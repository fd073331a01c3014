"""What to load and how: typed specifications and their dictionaries."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from datetime import datetime, timedelta
from enum import Enum, IntEnum

from .plans.periods import Period


class Extraction(str, Enum):
    FULL = "FULL"
    DELTA = "DELTA"
    PARTITION = "PARTITION"


class Load(str, Enum):
    FULL = "FULL"
    DELTA = "DELTA"
    DELTA_MERGE = "DELTA_MERGE"
    DELTA_UPSERT = "DELTA_UPSERT"
    DELTA_UPDATE = "DELTA_UPDATE"
    PARTITION = "PARTITION"
    UPDATE_PARTITION = "UPDATE_PARTITION"
    #: Some columns of known keys, partition by partition.
    COLUMNS = "COLUMNS"
    #: Type-2 history as of the run's day.
    HISTORY = "HISTORY"


class Mode(str, Enum):
    FULL = "FULL"
    DELTA = "DELTA"
    ITER = "ITER"


class Method(str, Enum):
    """Where rows come from; EXPORT sends the target's rows to a sink instead."""

    FILES = "files"
    JDBC = "jdbc"
    PAGED = "paged"
    FUNCTION = "function"
    PYTHON = "python"
    EXPORT = "export"


class Status(IntEnum):
    ERROR = -1
    NEW = 1
    IN_PROCESS = 2
    SUCCESS = 3


class SpecError(ValueError):
    """A specification that can't be carried out."""


@dataclass(frozen=True)
class SourceSpec:
    """Reader options; texts may hold $variables of the run.

    ``splits`` cuts a window into so many ranges that are read in parallel.
    ``rename`` maps target columns to the source's names; ``relaxed`` maps
    target columns to the type that the source gives and that is cast back.
    """

    format: str = "parquet"
    path: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    splits: int = 16
    enumerate_days: str | None = None
    rename: dict[str, str] = field(default_factory=dict)
    relaxed: dict[str, str] = field(default_factory=dict)
    reject_limit: int = 0


@dataclass(frozen=True)
class Grouping:
    """What may follow the select list of a transformation."""

    by: tuple[str, ...] = ()
    having: str | None = None
    order_by: tuple[str, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class LoadSpec:
    object_id: int
    name: str
    extraction: Extraction = Extraction.FULL
    load: Load = Load.FULL
    merge_key: tuple[str, ...] = ()
    delta_field: str | None = None
    bdate_field: str | None = None
    mode: Mode = Mode.FULL
    method: Method = Method.FUNCTION
    source: SourceSpec = field(default_factory=SourceSpec)
    where: str | None = None
    transforms: dict[str, str] = field(default_factory=dict)
    grouping: Grouping | None = None
    interval: Period | None = None
    delta_safety: Period = Period()
    bdate_safety: Period = Period()
    delta_start: datetime | None = None
    load_start: datetime | None = None
    period: str = "month"
    duplicates: str = "keep"
    load_function: str | None = None
    after_load: str | None = None
    group: str | None = None
    active: bool = True
    connect: str | None = None
    #: Columns that a COLUMNS load takes from the source.
    columns: tuple[str, ...] = ()
    #: Columns whose changes open no new row of a HISTORY load, its period's columns, and whether missing keys are closed.
    ignore: tuple[str, ...] = ()
    valid: tuple[str, str] = ("date_from", "date_to")
    detect_deleted: bool = True
    #: Of a DELTA load, rows whose key the table has are left out.
    new_keys_only: bool = False
    #: Of partition loads: rows without a date or before ``first`` go to the default partition, are skipped, or raise.
    out_of_range: str = "default"
    first: datetime | None = None
    #: Of UPDATE_PARTITION: keys are compared with the whole table, not within a partition.
    global_key: bool = False

    def __post_init__(self):
        for name, kind in (("extraction", Extraction), ("load", Load), ("mode", Mode), ("method", Method)):
            try:
                object.__setattr__(self, name, kind(getattr(self, name)))
            except ValueError as e:
                raise SpecError(f"{self.name}: unknown {name} {getattr(self, name)!r}") from e
        for name in ("merge_key", "columns", "ignore", "valid"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if self.out_of_range not in ("default", "skip", "raise"):
            raise SpecError(f"{self.name}: out_of_range is 'default', 'skip' or 'raise', not {self.out_of_range!r}")
        if self.duplicates not in ("keep", "drop"):
            raise SpecError(f"{self.name}: duplicates is 'keep' or 'drop', not {self.duplicates!r}")

    def check(self) -> LoadSpec:
        """Raise if what the load type needs is missing."""
        need = {
            Load.DELTA_MERGE: ("merge_key",),
            Load.DELTA_UPSERT: ("merge_key",),
            Load.DELTA_UPDATE: ("merge_key",),
            Load.PARTITION: ("bdate_field",),
            Load.UPDATE_PARTITION: ("merge_key", "bdate_field"),
            Load.COLUMNS: ("merge_key", "columns"),
            Load.HISTORY: ("merge_key",),
        }.get(self.load, ())
        need += {Extraction.DELTA: ("delta_field",), Extraction.PARTITION: ("bdate_field",)}.get(self.extraction, ())
        missing = sorted({n for n in need if not getattr(self, n) and not (n in ("delta_field", "bdate_field") and self.where)})
        if missing:
            raise SpecError(f"{self.name}: {self.load.value} with extraction {self.extraction.value} needs {', '.join(missing)}")
        return self

    def plain(self) -> dict:
        """What JSON can hold; ``of`` reads it again."""

        def text(x):
            if isinstance(x, Period):
                return {"months": x.months, "seconds": x.span.total_seconds()}
            if isinstance(x, (SourceSpec, Grouping)):
                return {f.name: text(getattr(x, f.name)) for f in fields(x)}
            return x.value if isinstance(x, Enum) else x.isoformat() if isinstance(x, datetime) else list(x) if isinstance(x, tuple) else x

        return {f.name: text(getattr(self, f.name)) for f in fields(self)}

    @staticmethod
    def of(x: dict) -> LoadSpec:
        own = {f.name for f in fields(LoadSpec)}
        x = {k: v for k, v in x.items() if k in own}
        for k in ("interval", "delta_safety", "bdate_safety"):
            if x.get(k) is not None:
                x[k] = Period(x[k]["months"], timedelta(seconds=x[k]["seconds"]))
        for k in ("delta_start", "load_start", "first"):
            if x.get(k) is not None:
                x[k] = datetime.fromisoformat(x[k])
        if x.get("grouping") is not None:
            x["grouping"] = Grouping(**{k: tuple(v) if isinstance(v, list) else v for k, v in x["grouping"].items()})
        if x.get("source") is not None:
            x["source"] = SourceSpec(**x["source"])
        return LoadSpec(**x)

    def but(self, **changes) -> LoadSpec:
        return replace(self, **changes)
