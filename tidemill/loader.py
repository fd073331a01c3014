"""From a specification to a published table: plan, extract, load, finish."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions import names
from .functions.expressions import extent, external_schema, extract_condition, project
from .functions.variables import of_run
from .operators import Scd2, append, load_partitions, merge, refresh_columns, replace_all, scd2, update_by_key, update_by_query, upsert
from .operators.ranges import placed, touched
from .plans import chains
from .registry import Locked, Registry, Run
from .sources.readers import Functions, connection, read_files, read_jdbc, read_pages, rejecting
from .sources.sinks import check as check_export
from .sources.sinks import JdbcSink, exported, to_store
from .spec import Extraction, Load, LoadSpec, Method, SpecError, Status
from .store import TableStore


@dataclass(frozen=True)
class Context:
    """What a load function gets."""

    spark: SparkSession
    spec: LoadSpec
    run: Run
    store: TableStore
    values: Mapping[str, object] = field(default_factory=dict)


class LoadFailed(RuntimeError):
    pass


#: New rows of the table (or of its touched partitions) by load type; (target, staged rows, specification).
STRATEGIES: dict[Load, Callable[[DataFrame, DataFrame, LoadSpec], DataFrame]] = {
    Load.FULL: lambda t, s, x: replace_all(t, s, empty=False),
    Load.DELTA: lambda t, s, x: append(t, s, new_keys_only=list(x.merge_key) if only_new(x) else None),
    Load.DELTA_MERGE: lambda t, s, x: merge(t, s, x.merge_key, x.duplicates, x.delta_field),
    Load.DELTA_UPSERT: lambda t, s, x: upsert(t, s, x.merge_key, x.duplicates == "drop", x.delta_field),
    Load.DELTA_UPDATE: lambda t, s, x: update_by_key(t, s, x.merge_key, x.delta_field, x.bdate_field),
    Load.PARTITION: lambda t, s, x: load_partitions(t, s, x.bdate_field, x.period, distinct=x.duplicates == "drop"),
    Load.UPDATE_PARTITION: lambda t, s, x: load_partitions(t, s, x.bdate_field, x.period, x.merge_key, x.duplicates, x.delta_field, global_key=x.global_key),
    Load.COLUMNS: lambda t, s, x: update_by_query(t, s, x.merge_key, x.columns, x.delta_field if x.delta_field in s.columns else None),
}


def only_new(spec: LoadSpec) -> bool:
    """Whether an append leaves out rows whose key the table has, such as those of a boundary that is read twice."""
    return bool(spec.merge_key) and (spec.new_keys_only or spec.duplicates == "drop")


def apply(store: TableStore, spec: LoadSpec, rows: DataFrame, day: date | None = None, **marks: int) -> int:
    """Carry out a load type on a table and publish it; the rows that were written.

    A partition load looks once at which partitions the rows touch, and opens
    no other partition of the table.
    """
    name, before = spec.name, store.version(spec.name)
    if spec.load is Load.DELTA:
        store.append(name, STRATEGIES[spec.load](store.read(name), rows, spec), **marks)
    elif spec.load is Load.HISTORY:
        how = Scd2(spec.merge_key, day, spec.ignore, *spec.valid, detect_deleted=spec.detect_deleted and spec.extraction is Extraction.FULL, delta=spec.delta_field if spec.delta_field in rows.columns else None)
        store.replace(name, scd2(store.read(name), rows, how), **marks)
    elif before.field and spec.load is Load.COLUMNS:
        delta = spec.delta_field if spec.delta_field in rows.columns else None
        fresh = names.delta(f"{name}_columns", spec.object_id)
        store.create(fresh, before.schema, replace=True)
        store.replace(fresh, refresh_columns(store.read(name), rows, spec.merge_key, spec.columns, delta))
        new = store.read(fresh)
        parts = touched(new, before.field, before.period)
        store.replace_partitions(name, load_partitions(store.read(name, parts), new, before.field, before.period, spec.merge_key, parts=parts), **marks)
    elif spec.load in (Load.PARTITION, Load.UPDATE_PARTITION):
        if before.field != spec.bdate_field:
            raise SpecError(f"{name} isn't partitioned by {spec.bdate_field}")
        rows = placed(rows, before.field, before.period, spec.out_of_range, spec.first if spec.out_of_range != "default" else None)
        x = spec.but(period=before.period)
        if spec.load is Load.UPDATE_PARTITION and spec.global_key:
            store.replace(name, STRATEGIES[spec.load](store.read(name), rows, x), **marks)
        elif spec.load is Load.PARTITION:
            store.replace_partitions(name, STRATEGIES[spec.load](store.read(name, []), rows, x), **marks)
        else:
            parts = touched(rows, before.field, before.period)
            store.replace_partitions(name, load_partitions(store.read(name, parts), rows, before.field, before.period, spec.merge_key, spec.duplicates, spec.delta_field, parts=parts), **marks)
    else:
        store.replace(name, STRATEGIES[spec.load](store.read(name), rows, spec), **marks)
    return store.written(name, before)


class Loader:
    def __init__(self, spark: SparkSession, store: TableStore, registry: Registry, functions: Functions | None = None, sink: TableStore | JdbcSink | None = None, overrides: Mapping[int, Mapping[str, str]] | None = None, lock_tries: int = 20, lock_pause: float = 60.0):
        self.spark, self.store, self.registry, self.sink = spark, store, registry, sink
        self.functions = functions or Functions()
        self.overrides = dict(overrides or {})
        self.lock_tries, self.lock_pause = lock_tries, lock_pause

    # -- steps

    def prepare(self, run: Run) -> LoadSpec:
        """The specification as the run carries it out, checked against what its load type needs."""
        spec = self.registry.spec(run.object_id).but(extraction=run.extraction, load=run.load)
        if spec.method is Method.EXPORT:
            return check_export(spec)
        if spec.method in (Method.FUNCTION, Method.PYTHON) and not spec.load_function:
            raise SpecError(f"{spec.name}: method {spec.method.value} needs a load function")
        return spec.check()

    def source(self, spec: LoadSpec, run: Run) -> DataFrame:
        values = of_run(run, spec, self.registry.clock())
        schema = self.staged_schema(spec)
        if spec.method is Method.FILES:
            if spec.object_id in self.overrides:
                spec = spec.but(source=type(spec.source)(**{**spec.source.__dict__, "options": dict(self.overrides[spec.object_id])}))
            return read_files(self.spark, spec, schema if spec.source.format in ("csv", "json") or spec.source.relaxed else None, values)
        if spec.method is Method.JDBC:
            return read_jdbc(self.spark, spec, values, run.extraction_from, run.extraction_to)
        if spec.method is Method.PAGED and spec.source.format == "pages":
            name = names.delta(f"{spec.name}_pages", spec.object_id)
            self.store.create(name, external_schema(schema, spec.source.rename, spec.source.relaxed), replace=True)
            read_pages(self.store, name, self.functions[spec.load_function], spec.source.splits, lambda n: self.registry.update(run.load_id, row_cnt=n))
            return self.store.read(name)
        if spec.method is Method.PAGED:
            return self.spark.read.format(spec.source.format).options(**connection(spec, values, self.overrides.get(spec.object_id))).load()
        return self.functions.call(spec.load_function, Context(self.spark, spec, run, self.store, values))

    def extract(self, spec: LoadSpec, run: Run) -> DataFrame:
        """Staged rows: filtered at the source, transformed, in the target's columns.  Lazy."""
        rows = self.source(spec, run)
        if not isinstance(rows, DataFrame):
            raise LoadFailed(f"{spec.name}: the load function returned {type(rows).__name__}, not a DataFrame")
        condition = extract_condition(spec, run.extraction_from, run.extraction_to, of_run(run, spec, self.registry.clock()))
        return project(rows, self.staged_schema(spec), spec.transforms, spec.grouping, spec.source.rename, condition)

    def staged_schema(self, spec: LoadSpec) -> StructType:
        """The table's columns; without those of the period for history, key and refreshed ones for a refresh."""
        schema = self.store.version(spec.name).schema
        if spec.load is Load.HISTORY:
            return StructType([f for f in schema if f.name not in spec.valid])
        if spec.load is Load.COLUMNS:
            return StructType([f for f in schema if f.name in (*spec.merge_key, *spec.columns) or (spec.extraction is Extraction.DELTA and f.name == spec.delta_field)])
        return schema

    def staged(self, spec: LoadSpec, rows: DataFrame) -> DataFrame:
        """Rows written once in the store, so that they are counted and loaded without a second extraction."""
        name = names.delta(spec.name, spec.object_id)
        self.store.create(name, self.staged_schema(spec), replace=True)
        with rejecting(spec.name):
            self.store.replace(name, rows)
        return self.store.read(name)

    def commit(self, spec: LoadSpec, rows: DataFrame, run: Run) -> int:
        """Apply the load type and publish; the rows written, which a merge's target rows are part of."""
        return apply(self.store, spec, rows, (run.created or self.registry.clock()).date())

    # -- whole runs

    def run(self, load_id: int) -> Run:
        """Carry out a planned run.  An error leaves the table and the watermark as they were."""
        run = self.registry.run(load_id)
        name = self.registry.spec(run.object_id).name
        self.registry.log("INFO", f"start of {name}", "run", load_id)
        try:
            spec = self.prepare(run)
            # a run in process has its lock: one without is known to be dead
            self.registry.wait_lock(load_id, spec.name, self.lock_tries, self.lock_pause)
            try:
                self.registry.set_in_process(load_id)
                done = self._export(spec, run) if spec.method is Method.EXPORT else self._load(spec, run)
                if spec.after_load and self.functions.call(spec.after_load, Context(self.spark, spec, done, self.store, of_run(done, spec, self.registry.clock()))) is not True:
                    raise LoadFailed(f"{spec.name}: {spec.after_load} did not return True")
            finally:
                self.registry.unlock(load_id, spec.name)
        except Exception as e:
            self.registry.log("ERROR", f"{type(e).__name__}: {e}", "run", load_id)
            self.registry.set_error(load_id)
            raise
        self.registry.log("INFO", f"end of {name}: {done.row_cnt} rows", "run", load_id)
        return self.registry.set_success(load_id)

    def _load(self, spec: LoadSpec, run: Run) -> Run:
        if spec.method is Method.PYTHON:
            if self.functions.call(spec.load_function, Context(self.spark, spec, run, self.store, of_run(run, spec, self.registry.clock()))) is not True:
                raise LoadFailed(f"{spec.name}: {spec.load_function} did not return True")
            return self.registry.run(run.load_id)
        rows = self.staged(spec, self.extract(spec, run))
        mark = spec.bdate_field if spec.extraction is Extraction.PARTITION else spec.delta_field if spec.extraction is Extraction.DELTA else None
        have = [f for f in dict.fromkeys((mark, spec.bdate_field, spec.delta_field)) if f and f in rows.columns]
        n, found = extent(rows, *have)
        # nothing found: the watermark stays where it was
        to = run.extraction_from if not n else _time(found[mark][1]) if mark in found and found[mark][1] is not None else run.extraction_to
        load_field = spec.bdate_field if spec.load in (Load.PARTITION, Load.UPDATE_PARTITION) else spec.delta_field
        lo, hi = (_time(x) for x in found.get(load_field, (None, None)))
        self.registry.update(run.load_id, extraction_to=to, row_cnt=n, load_from=lo, load_to=hi)
        written = self.commit(spec, rows, run) if n else 0
        return self.registry.update(run.load_id, written=written)

    def _export(self, spec: LoadSpec, run: Run) -> Run:
        if self.sink is None:
            raise SpecError("no sink")
        rows = exported(self.store.read(spec.name), spec, run.extraction_from, run.extraction_to, of_run(run, spec))
        n, found = extent(rows, *([spec.delta_field] if spec.delta_field else []))
        top = found[spec.delta_field][1] if spec.delta_field and n else None
        if n and isinstance(self.sink, JdbcSink):
            self.sink.publish(spec.name, rows, spec)
        elif n:
            if not self.sink.exists(spec.name):
                v = self.store.version(spec.name)
                self.sink.create(spec.name, v.schema, v.field, v.period)
            to_store(self.sink, spec.name, rows, spec)
        return self.registry.update(run.load_id, row_cnt=n, written=n, extraction_to=_time(top) if top is not None else run.extraction_from if not n else run.extraction_to)

    def load(self, object_id: int, start: datetime | None = None, end: datetime | None = None, **how) -> list[Run]:
        """Plan the windows due and carry them out in order."""
        return [self.run(r.load_id) for r in self.registry.plan(object_id, start, end, **how)]

    # -- many objects

    def run_chain(self, name: str, start: datetime | None = None, end: datetime | None = None, workers: int = 3, retries: int = 1):
        """Carry out a chain, once at a time; its run is logged, and in error if one of its objects is.

        An object that fails is tried again ``retries`` times.
        """
        chain = self.registry.chains.get(name)
        if chain is not None and not chain.active:
            raise SpecError(f"chain {name} isn't active")
        instance = self.registry.open_instance(name, start, end)
        tree = chains.parse(chain.sequence)
        if wrong := set(chains.objects(tree)) - set(self.registry.specs):
            self.registry.instance_error(instance.instance_id)
            raise chains.ChainError(f"unknown objects: {sorted(wrong)}")
        if not self.registry.lock(instance.instance_id, f"chain {name}", "CHAIN"):
            self.registry.instance_error(instance.instance_id)
            raise Locked(f"chain {name} runs already")
        self.registry.instance_in_process(instance.instance_id)
        self.registry.log("INFO", f"start of chain {name}", "chain", instance_id=instance.instance_id)
        try:
            chains.run(tree, self._pooled(start, end, retries), workers)
        except Exception as e:
            self.registry.log("ERROR", str(e), "chain", instance_id=instance.instance_id)
            self.registry.instance_error(instance.instance_id)
            raise
        finally:
            self.registry.unlock(name=f"chain {name}")
        self.registry.log("INFO", f"end of chain {name}", "chain", instance_id=instance.instance_id)
        return self.registry.instance_success(instance.instance_id)

    def run_group(self, group: str | None, workers: int = 3, start: datetime | None = None, end: datetime | None = None) -> list[int]:
        """Objects with dependencies in their order, then the others in lanes; what was run."""
        active = [s.object_id for s in self.registry.active(group)]
        free, before = chains.order(active, self.registry.dependencies, self.registry.specs)
        work = self._pooled(start, end)
        done = chains.run_ordered(before, work, workers) if before else []
        if free:
            chains.run(chains.as_lanes(free, workers), work, workers)
        return done + free

    def _pooled(self, start: datetime | None, end: datetime | None, retries: int = 0):
        def work(object_id: int) -> None:
            sc = self.spark.sparkContext
            sc.setLocalProperty("spark.scheduler.pool", f"object-{object_id}")
            sc.setJobGroup(self.registry.spec(object_id).name, f"load of object {object_id}", interruptOnCancel=True)
            for left in range(retries, -1, -1):
                try:
                    self.load(object_id, start, end)
                    return
                except Exception as e:
                    if not left or isinstance(e, SpecError):
                        raise
                    self.registry.log("WARN", f"object {object_id} is tried again: {e}", "chain")

        return work

    def cancel(self, name: str) -> None:
        """Stop the Spark jobs that load a table, and free its lock."""
        self.spark.sparkContext.cancelJobGroup(name)
        self.registry.unlock(name=name)

    def activity(self) -> list[dict]:
        """Spark jobs that run now."""
        tracker = self.spark.sparkContext.statusTracker()
        return [{"job": j, "stages": list(i.stageIds), "status": i.status} for j in tracker.getActiveJobsIds() if (i := tracker.getJobInfo(j))]

    def status(self, day: datetime | None = None) -> DataFrame:
        """Active objects that have a group, with the day's runs and their state in words."""
        day = day or self.registry.clock()
        specs = self.spark.createDataFrame([(s.object_id, s.name, s.group) for s in self.registry.active() if s.group], "object_id long, object_name string, load_group string")
        today = [r for r in self.registry.runs() if r.created and r.created.date() == day.date()]
        words = self.spark.createDataFrame([(int(s), s.name) for s in Status], "status int, status_name string")
        runs = self.registry.frame(self.spark, today).select("object_id", "load_id", "status", "extraction_from", "extraction_to", "row_cnt", "updated")
        return specs.join(runs, "object_id", "left").join(F.broadcast(words), "status", "left").orderBy("object_id", "load_id")


def _time(x) -> datetime | None:
    return None if x is None else x if isinstance(x, datetime) else datetime(x.year, x.month, x.day) if hasattr(x, "year") else None
