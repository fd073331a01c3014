"""State: specifications and their history, runs, watermarks, locks, logs, chains and chain runs.

State is small (rows for each run, not for each data row) and lives in one
folder, on the driver's disk or, if a session is given, on whatever file
system the folder's path names: a JSON file for each run, found by object, so
runs of different objects don't touch the same file; locks are files whose
creation fails if they exist; logs are written apart from data, and so survive
a load that fails.  Whoever opens the folder again finds all of it.
"""

from __future__ import annotations

import json
import logging
import os
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, replace
from datetime import datetime
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from .files import Files, LocalFiles
from .plans.periods import Period
from .plans.windows import LoadWindow, bounds, cut_windows, safety
from .spec import Extraction, Load, LoadSpec, Mode, Status

LOG_TYPES = ("ERROR", "INFO", "WARN", "DEBUG", "SERVICE")


class RegistryError(LookupError):
    pass


class Locked(RuntimeError):
    pass


@dataclass(frozen=True)
class Run:
    load_id: int
    object_id: int
    status: Status = Status.NEW
    extraction: Extraction = Extraction.FULL
    load: Load = Load.FULL
    extraction_from: datetime | None = None
    extraction_to: datetime | None = None
    load_from: datetime | None = None
    load_to: datetime | None = None
    row_cnt: int | None = None
    written: int | None = None
    created: datetime | None = None
    updated: datetime | None = None


@dataclass(frozen=True)
class Instance:
    instance_id: int
    chain: str
    load_from: datetime | None = None
    load_to: datetime | None = None
    status: Status = Status.NEW
    started: datetime | None = None
    finished: datetime | None = None


@dataclass(frozen=True)
class Chain:
    name: str
    sequence: str
    active: bool = True
    schedule: str | None = None
    description: str = ""


_TYPES = {"status": Status, "extraction": Extraction, "load": Load}


def _dump(x) -> str:
    return json.dumps({k: v.isoformat() if isinstance(v, datetime) else v for k, v in asdict(x).items()})


def _load(kind, text: str):
    x = json.loads(text)
    for f in kind.__dataclass_fields__.values():
        v = x.get(f.name)
        if v is not None and "datetime" in str(f.type):
            x[f.name] = datetime.fromisoformat(v)
        elif v is not None and f.name in _TYPES:
            x[f.name] = _TYPES[f.name](v)
    return kind(**x)


class _Kept(dict):
    """A dictionary that is written with every change."""

    def __init__(self, items: dict, save: Callable, forget: Callable):
        super().__init__(items)
        self._save, self._forget = save, forget

    def __setitem__(self, key, value) -> None:
        self._save(key, value)
        super().__setitem__(key, value)

    def __delitem__(self, key) -> None:
        super().__delitem__(key)
        self._forget(key)


class Registry:
    def __init__(self, root: str | Path, clock=datetime.now, spark: SparkSession | None = None):
        self.root, self.clock = str(root), clock
        self.files = Files(spark, str(root)) if spark is not None else LocalFiles(root)
        self._mutex = threading.RLock()
        path = lambda kind, key: f"{kind}/{quote(str(key), safe='')}.json"

        def kept(kind: str, dump: Callable, load: Callable, known: dict) -> _Kept:
            own = [load(self.files.read(f"{kind}/{n}")) for n in self.files.names(kind) if n.endswith(".json")]
            return _Kept(known | dict(own), lambda k, v: self.files.replace(path(kind, k), dump(k, v)), lambda k: self.files.delete(path(kind, k)))

        self.specs: dict[int, LoadSpec] = kept("specs", lambda _, v: json.dumps(v.plain()), lambda x: ((s := LoadSpec.of(json.loads(x))).object_id, s), {})
        self.chains: dict[str, Chain] = kept("chains", lambda _, v: _dump(v), lambda x: ((c := _load(Chain, x)).name, c), {})
        pair = lambda x: (x["name"], x["value"])
        constants = {"bkp": "bkp_", "buffer": "buffer_", "delta": "delta_", "ext": "ext_", "stg": "stg_"}
        self.constants: dict[str, str] = kept("constants", lambda k, v: json.dumps({"name": k, "value": v}), lambda x: pair(json.loads(x)), constants)

    # -- specifications

    @property
    def dependencies(self) -> list[tuple[int, int]]:
        """Pairs (object, object that it waits for)."""
        return [tuple(e) for e in json.loads(self.files.read("dependencies.json"))] if self.files.exists("dependencies.json") else []

    @dependencies.setter
    def dependencies(self, pairs: Iterable[tuple[int, int]]) -> None:
        self.files.replace("dependencies.json", json.dumps(sorted({tuple(e) for e in pairs})))

    @property
    def history(self) -> list[dict]:
        """What was inserted, updated and deleted among the specifications, as it was before."""
        out = []
        for n in sorted(int(x.removesuffix(".json")) for x in self.files.names("history")):
            x = json.loads(self.files.read(f"history/{n}.json"))
            out.append(x | {"change_timestamp": datetime.fromisoformat(x["change_timestamp"]), "spec": LoadSpec.of(x["spec"])})
        return out

    def _changed(self, kind: str, user: str, spec: LoadSpec) -> None:
        row = {"change_type": kind, "change_timestamp": self.clock().isoformat(), "change_username": user, "object_id": spec.object_id, "spec": spec.plain()}
        self.files.create(f"history/{self._next('history')}.json", json.dumps(row))

    def add(self, spec: LoadSpec, user: str = "") -> LoadSpec:
        """Insert or replace a specification; what changed goes to the history."""
        with self._mutex:
            self._changed("UPDATE" if spec.object_id in self.specs else "INSERT", user, self.specs.get(spec.object_id, spec))
            self.specs[spec.object_id] = spec
        return spec

    def remove(self, object_id: int, user: str = "") -> None:
        with self._mutex:
            self._changed("DELETE", user, self.spec(object_id))
            del self.specs[object_id]

    def spec(self, object_id: int) -> LoadSpec:
        if object_id not in self.specs:
            raise RegistryError(f"unknown object {object_id}")
        return self.specs[object_id]

    def merge_key(self, object_id: int) -> tuple[str, ...]:
        return self.spec(object_id).merge_key

    def load_function(self, object_id: int) -> str | None:
        return self.spec(object_id).load_function

    def where_clause(self, object_id: int) -> str | None:
        return (self.spec(object_id).where or "").strip() or None

    def constant(self, name: str) -> str | None:
        return self.constants.get(name)

    # -- counters

    def _next(self, name: str) -> int:
        """1, 2, 3 ... across processes: a number is whoever's file for it was made first."""
        folder = f"sequences/{name}"
        own = [int(x) for x in self.files.names(folder) if x.isdigit()]
        n = max(own, default=0) + 1
        while not self.files.create(f"{folder}/{n}", ""):
            n += 1
        for x in own:
            if x < n - 16:
                self.files.delete(f"{folder}/{x}")
        return n

    def _write(self, kind: str, id_: int, x) -> None:
        if kind == "runs":
            self.files.create(f"objects/{x.object_id}/{id_}", "")
        self.files.replace(f"{kind}/{id_}.json", _dump(x))

    # -- runs

    def run(self, load_id: int) -> Run:
        if not self.files.exists(f"runs/{load_id}.json"):
            raise RegistryError(f"unknown run {load_id}")
        return _load(Run, self.files.read(f"runs/{load_id}.json"))

    def runs(self, object_id: int | None = None) -> list[Run]:
        """All runs, or those of one object: others' files aren't opened."""
        if object_id is None:
            ids = [n.removesuffix(".json") for n in self.files.names("runs") if n.endswith(".json")]
        else:
            ids = [n for n in self.files.names(f"objects/{object_id}") if n.isdigit() and self.files.exists(f"runs/{n}.json")]
        return [self.run(n) for n in sorted(map(int, ids))]

    def update(self, load_id: int, **fields) -> Run:
        """Set fields of a run; a name that isn't one, or a value of another type, raises."""
        with self._mutex:
            r = self.run(load_id)
            for k, v in fields.items():
                if k not in Run.__dataclass_fields__:
                    raise RegistryError(f"a run has no field {k!r}")
                want = str(Run.__dataclass_fields__[k].type)
                if v is not None and ("datetime" in want) != isinstance(v, datetime):
                    raise TypeError(f"{k} is {want}, not {v!r}")
            r = replace(r, **fields, updated=self.clock())
            self._write("runs", load_id, r)
            return r

    def set_in_process(self, load_id: int) -> Run:
        return self.update(load_id, status=Status.IN_PROCESS)

    def set_success(self, load_id: int) -> Run:
        return self.update(load_id, status=Status.SUCCESS)

    def set_error(self, load_id: int) -> Run:
        return self.update(load_id, status=Status.ERROR)

    def watermarks(self, object_id: int) -> list[datetime]:
        """Ends of windows that succeeded, none beyond the start of one that is open or failed."""
        runs = self.runs(object_id)
        least = min((r.extraction_from for r in runs if r.status is not Status.SUCCESS and r.extraction_from), default=None)
        return [r.extraction_to if least is None else min(r.extraction_to, least) for r in runs if r.status is Status.SUCCESS and r.extraction_to]

    def exists(self, object_id: int, window: LoadWindow, extraction: Extraction, periodic: bool) -> bool:
        """An open run covers the window already.  A periodic one must have just these bounds, a full one any."""
        for r in self.runs(object_id):
            if r.status not in (Status.NEW, Status.IN_PROCESS):
                continue
            if extraction is Extraction.FULL and not periodic:
                return True
            if periodic and (r.extraction_from, r.extraction_to) == (window.start, window.end):
                return True
            if not periodic and r.extraction_from and r.extraction_to and r.extraction_from <= window.start and r.extraction_to >= window.end:
                return True
        return False

    def open_runs(self, object_id: int, start: datetime | None = None, end: datetime | None = None) -> list[Run]:
        """Runs not begun whose window lies within the bounds, the earliest window first."""
        own = [r for r in self.runs(object_id) if r.status is Status.NEW and (start is None or (r.extraction_from and r.extraction_from >= start)) and (end is None or (r.extraction_to and r.extraction_to <= end))]
        return sorted(own, key=lambda r: (r.extraction_from or datetime.min, r.load_id))

    def open_run(self, object_id: int, start: datetime | None = None, end: datetime | None = None) -> Run | None:
        return next(iter(self.open_runs(object_id, start, end)), None)

    def reopen(self, object_id: int) -> list[Run]:
        """Runs that failed, or whose process is gone (in process, but without a lock), are to be done again."""
        holders = {x["load_id"] for x in self.locks(self.spec(object_id).name)}
        gone = lambda r: r.status is Status.ERROR or (r.status is Status.IN_PROCESS and r.load_id not in holders)
        return [self.update(r.load_id, status=Status.NEW) for r in self.runs(object_id) if gone(r)]

    def plan(self, object_id: int, start: datetime | None = None, end: datetime | None = None, extraction: Extraction | None = None, load: Load | None = None, mode: Mode | None = None, interval: Period | None = None) -> list[Run]:
        """Runs for the windows due, in order.

        Windows that failed are due again, so none is lost when later ones
        succeed; open ones within the bounds are used again.  New windows
        follow if windows are cut by an interval, or if there is none open.
        """
        spec = self.spec(object_id)
        spec = spec.but(extraction=extraction or spec.extraction, load=load or spec.load, mode=mode or spec.mode, interval=interval or spec.interval)
        with self._mutex:
            self.reopen(object_id)
            out = self.open_runs(object_id, start, end)
            if out and spec.mode is not Mode.ITER:
                return out
            lo, hi = bounds(spec, self.watermarks(object_id), self.clock(), start, end)
            done = [r for r in self.runs(object_id) if r.status is Status.SUCCESS] if out else []
            for w in cut_windows(spec.mode, lo, hi, spec.interval, safety(spec)):
                if self.exists(object_id, w, spec.extraction, spec.mode is Mode.ITER):
                    continue
                # windows behind a failed one that were loaded already
                if any(r.extraction_from == w.start and r.load_id > out[0].load_id for r in done):
                    continue
                r = Run(self._next("load_id"), object_id, Status.NEW, spec.extraction, spec.load, w.start, w.end, created=self.clock(), updated=self.clock())
                self._write("runs", r.load_id, r)
                out.append(r)
        return sorted(out, key=lambda r: (r.extraction_from or datetime.min, r.load_id))

    def plan_group(self, group: str, **how) -> dict[int, list[Run]]:
        """Runs of all active objects of a group."""
        return {s.object_id: self.plan(s.object_id, **how) for s in self.active(group)}

    def active(self, group: str | None = None) -> list[LoadSpec]:
        return sorted((s for s in self.specs.values() if s.active and (group is None or s.group == group)), key=lambda s: s.object_id)

    # -- locks

    def _lock(self, name: str) -> str:
        return f"locks/{quote(name, safe='')}"

    def lock(self, load_id: int, name: str, kind: str = "LOAD") -> bool:
        """Of several that ask at once one gets it."""
        row = {"load_id": load_id, "pid": os.getpid(), "lock_type": kind, "object_name": name, "timestamp": self.clock().isoformat()}
        with self._mutex:
            return self.files.create(self._lock(name), json.dumps(row))

    def unlock(self, load_id: int | None = None, name: str | None = None) -> int:
        """Release by run, name or both; without either, all."""
        n = 0
        for x in self.locks(name):
            if load_id is None or x["load_id"] == load_id:
                n += self.files.delete(self._lock(x["object_name"]))
        return n

    def locks(self, name: str | None = None) -> list[dict]:
        out = []
        for p in self.files.names("locks") if name is None else [quote(name, safe="")]:
            if not self.files.exists(f"locks/{p}"):
                continue
            try:
                out.append(json.loads(self.files.read(f"locks/{p}")))
            except (OSError, ValueError):
                continue
        return sorted(out, key=lambda x: x["object_name"])

    def wait_lock(self, load_id: int, name: str, tries: int = 20, pause: float = 60.0, take_over: bool = False) -> None:
        """Take the lock, asking ``tries`` times at most; ``take_over`` removes the holder's first."""
        if take_over:
            self.unlock(name=name)
        for k in range(max(1, tries)):
            if self.lock(load_id, name):
                return
            if k + 1 < tries:
                time.sleep(pause)
        raise Locked(f"{name} is locked by {self.locks(name)}")

    # -- logs

    def log(self, kind: str, message: str, location: str = "", load_id: int | None = None, instance_id: int | None = None) -> None:
        if kind not in LOG_TYPES:
            raise ValueError(f"a log is one of {', '.join(LOG_TYPES)}, not {kind!r}")
        row = {"log_id": self._next("log_id"), "timestamp": self.clock().isoformat(), "type": kind, "msg": message, "location": location, "is_error": kind == "ERROR", "load_id": load_id, "instance_id": instance_id}
        self.files.create(f"logs/{row['log_id']:012d}.json", json.dumps(row))
        logging.getLogger("tidemill").log({"ERROR": 40, "WARN": 30, "DEBUG": 10}.get(kind, 20), "%s %s", location, message)

    def logs(self, load_id: int | None = None, instance_id: int | None = None) -> list[dict]:
        rows = [json.loads(self.files.read(f"logs/{n}")) for n in self.files.names("logs")]
        return [r for r in rows if (load_id is None or r["load_id"] == load_id) and (instance_id is None or r["instance_id"] == instance_id)]

    # -- chain runs

    def open_instance(self, chain: str, start: datetime | None = None, end: datetime | None = None) -> Instance:
        if chain not in self.chains:
            raise RegistryError(f"unknown chain {chain!r}")
        i = Instance(self._next("instance_id"), chain, start, end)
        self._write("instances", i.instance_id, i)
        return i

    def instance(self, instance_id: int) -> Instance:
        return _load(Instance, self.files.read(f"instances/{instance_id}.json"))

    def instances(self) -> list[Instance]:
        return [self.instance(n) for n in sorted(int(x.removesuffix(".json")) for x in self.files.names("instances") if x.endswith(".json"))]

    def update_instance(self, instance_id: int, **fields) -> Instance:
        if wrong := set(fields) - set(Instance.__dataclass_fields__):
            raise RegistryError(f"a chain run has no field {', '.join(wrong)}")
        i = replace(self.instance(instance_id), **fields)
        self._write("instances", instance_id, i)
        return i

    def instance_in_process(self, instance_id: int) -> Instance:
        return self.update_instance(instance_id, status=Status.IN_PROCESS, started=self.clock())

    def instance_success(self, instance_id: int) -> Instance:
        return self.update_instance(instance_id, status=Status.SUCCESS, finished=self.clock())

    def instance_error(self, instance_id: int) -> Instance:
        return self.update_instance(instance_id, status=Status.ERROR, finished=self.clock())

    # -- as tables

    def frame(self, spark: SparkSession, rows: Iterable[Run | Instance]) -> DataFrame:
        """Runs as a DataFrame, for joins with data."""
        fields = "load_id long, object_id long, status int, extraction string, load string, extraction_from timestamp_ntz, extraction_to timestamp_ntz, load_from timestamp_ntz, load_to timestamp_ntz, row_cnt long, written long, created timestamp_ntz, updated timestamp_ntz"
        data = [tuple(int(v) if isinstance(v, Status) else v.value if isinstance(v, (Extraction, Load)) else v for v in (getattr(r, n) for n in Run.__dataclass_fields__)) for r in rows]
        return spark.createDataFrame(data, fields)
