import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemill import catalog, demo
from tidemill.functions.session import get_parameter, set_parameter
from tidemill.loader import Loader, LoadFailed
from tidemill.plans.chains import ChainError
from tidemill.registry import Chain, Locked, Registry
from tidemill.sources.readers import Functions, Rejected, connection, paged, ranges
from tidemill.sources.sinks import to_files
from tidemill.spec import LoadSpec, SourceSpec, SpecError, Status
from tidemill.store import TableStore
from tidemill.streaming import load_stream, sessions

D = datetime


@pytest.fixture
def world(spark, tmp_path):
    class World:
        now = D(2024, 3, 10)
        store = TableStore(spark, str(tmp_path / "store"))
        sink = TableStore(spark, str(tmp_path / "sink"))
        registry = Registry(tmp_path / "state", clock=lambda: World.now)
        functions = Functions()
        data = spark.createDataFrame([(1, D(2024, 1, 5), 1.0), (2, D(2024, 2, 5), 2.0), (3, D(2024, 2, 6), 3.0)], "k long, t timestamp_ntz, v double")

    w = World()
    w.loader = Loader(spark, w.store, w.registry, w.functions, w.sink, lock_tries=1, lock_pause=0)
    w.functions.register("data", lambda c: w.data)
    w.spec = LoadSpec(1, "demo.t", "DELTA", "DELTA_UPSERT", ("k",), "t", "t", "DELTA", "function", load_function="data", delta_start=D(2024, 1, 1), group="g")
    w.registry.add(w.spec)
    w.store.create("demo.t", w.data.schema, "t", "month")
    return w


def values(store, name="demo.t"):
    return sorted((r.k, r.v) for r in store.read(name).collect())


def test_runs_go_on_and_replays_change_nothing(world, spark):
    (r,) = world.loader.load(1)
    assert (r.status, r.row_cnt, r.written, r.extraction_to) == (Status.SUCCESS, 3, 3, D(2024, 2, 6))
    assert (r.load_from, r.load_to) == (D(2024, 1, 5), D(2024, 2, 6))
    world.data = world.data.withColumn("v", F.col("v") + 10).unionByName(spark.createDataFrame([(4, D(2024, 3, 1), 4.0)], world.data.schema))
    (r,) = world.loader.load(1)
    # the boundary row is read twice, older ones aren't
    assert (r.row_cnt, r.extraction_from, r.extraction_to) == (2, D(2024, 2, 6), D(2024, 3, 1))
    assert values(world.store) == [(1, 1.0), (2, 2.0), (3, 13.0), (4, 4.0)]
    world.loader.load(1, D(2024, 2, 1), D(2024, 3, 10))
    world.loader.load(1, D(2024, 2, 1), D(2024, 3, 10))
    assert values(world.store) == [(1, 1.0), (2, 12.0), (3, 13.0), (4, 4.0)]


def test_an_empty_window_leaves_the_watermark(world):
    world.loader.load(1)
    world.data = world.data.where("false")
    before = world.store.version("demo.t").number
    (r,) = world.loader.load(1)
    assert (r.row_cnt, r.extraction_to) == (0, D(2024, 2, 6)) and world.store.version("demo.t").number == before


def test_errors_leave_table_and_watermark(world):
    world.loader.load(1)
    world.functions.register("data", lambda c: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        world.loader.load(1)
    last = world.registry.runs(1)[-1]
    assert last.status is Status.ERROR and world.registry.locks() == [] and len(values(world.store)) == 3
    assert any(x["is_error"] for x in world.registry.logs(load_id=last.load_id))
    assert world.registry.watermarks(1) == [D(2024, 2, 6)]
    world.functions.register("data", lambda c: "rows")
    with pytest.raises(LoadFailed):
        world.loader.load(1)
    world.registry.add(world.spec.but(load_function="unknown"))
    with pytest.raises(SpecError):
        world.loader.load(1)


@pytest.mark.parametrize(
    ("load", "want"),
    [
        ("FULL", [(2, 20.0), (5, 50.0)]),
        ("DELTA", [(1, 1.0), (2, 2.0), (2, 20.0), (3, 3.0), (5, 50.0)]),
        ("DELTA_MERGE", [(1, 1.0), (2, 20.0), (3, 3.0), (5, 50.0)]),
        ("DELTA_UPSERT", [(1, 1.0), (2, 20.0), (3, 3.0), (5, 50.0)]),
        ("DELTA_UPDATE", [(1, 1.0), (2, 20.0), (3, 3.0)]),
        ("PARTITION", [(1, 1.0), (2, 20.0), (5, 50.0)]),
        ("UPDATE_PARTITION", [(1, 1.0), (2, 20.0), (3, 3.0), (5, 50.0)]),
    ],
)
def test_every_load_type(world, spark, load, want):
    world.store.replace("demo.t", world.data)
    world.data = spark.createDataFrame([(2, D(2024, 2, 7), 20.0), (5, D(2024, 2, 8), 50.0)], world.data.schema)
    world.registry.add(world.spec.but(load=load))
    (r,) = world.loader.load(1)
    assert values(world.store) == want and r.row_cnt == 2


def test_hooks_and_functions(world):
    seen = []
    world.functions.register("hook", lambda c: seen.append(c.run.row_cnt) or True)
    world.registry.add(world.spec.but(after_load="hook"))
    world.loader.load(1)
    assert seen == [3]
    world.functions.register("hook", lambda c: None)
    with pytest.raises(LoadFailed):
        world.loader.load(1)
    world.functions.register("job", lambda c: c.values["load_type"] == "FULL")
    world.registry.add(LoadSpec(2, "demo.t", method="python", load_function="job"))
    assert world.loader.load(2)[0].status is Status.SUCCESS


def test_files(world, spark, tmp_path):
    (tmp_path / "in.csv").write_text("key;t;v\n1;2024-01-01 00:00:00;1.5\nbad;row;x\n2;2024-01-02 00:00:00;2.5\n")
    source = SourceSpec("csv", str(tmp_path / "in.csv"), {"sep": ";", "header": "true"}, rename={"k": "key"}, reject_limit=1)
    world.registry.add(world.spec.but(method="files", source=source, load_function=None, extraction="FULL", load="FULL", mode="FULL"))
    world.loader.load(1)
    assert values(world.store) == [(1, 1.5), (2, 2.5)]
    strict = SourceSpec(**{**source.__dict__, "reject_limit": 0})
    world.registry.add(world.spec.but(method="files", source=strict, load_function=None, extraction="FULL", load="FULL", mode="FULL"))
    with pytest.raises(Rejected):
        world.loader.load(1)
    to_files(world.data, str(tmp_path / "pq"))
    world.registry.add(world.spec.but(method="files", source=SourceSpec("parquet", str(tmp_path / "pq")), load="FULL"))
    world.loader.load(1, D(2024, 2, 1), D(2024, 2, 6))
    assert values(world.store) == [(2, 2.0)]


def test_pages_and_splits(world, spark):
    spark.dataSource.register(paged("demo_pages", "k long, t timestamp, v double", lambda p: [(p * 10 + i, D(2024, 1, 1 + p), float(i)) for i in range(3)], 4))
    world.registry.add(world.spec.but(method="paged", source=SourceSpec("demo_pages"), load="FULL", extraction="FULL"))
    world.loader.load(1)
    assert len(values(world.store)) == 12
    spec = world.spec.but(source=SourceSpec("jdbc", rename={"t": "ts"}, options={"url": "u", "q": "from $extraction_from"}))
    assert len(ranges(spec, D(2024, 1, 1), D(2024, 7, 1))) in (16, 17) and ranges(spec, D(2024, 1, 1), D(2024, 1, 2)) == ["ts >= '2024-01-01 00:00:00' AND ts < '2024-01-02 00:00:00'"]
    assert ranges(spec.but(extraction="FULL"), D(2024, 1, 1), D(2024, 7, 1)) == []
    days = spec.but(source=SourceSpec("jdbc", rename={"t": "ts"}, enumerate_days="%Y%m%d"))
    assert ranges(days, D(2024, 1, 1), D(2024, 1, 2)) == ["ts = '20240101'", "ts = '20240102'"]
    assert connection(spec, {"extraction_from": 5}) == {"url": "u", "q": "from 5"}
    assert connection(spec, {}, {"url": "other"}) == {"url": "other"}


@pytest.mark.parametrize("load", ["FULL", "DELTA_UPSERT", "UPDATE_PARTITION"])
def test_export(world, load):
    world.store.replace("demo.t", world.data)
    world.registry.add(world.spec.but(method="export", load=load, mode="DELTA", extraction="DELTA" if load != "FULL" else "FULL"))
    (r,) = world.loader.load(1)
    assert values(world.sink) == values(world.store) and r.row_cnt == 3 and r.extraction_to == D(2024, 2, 6)
    world.loader.load(1)
    assert values(world.sink) == values(world.store)
    world.registry.add(world.spec.but(method="export", load="DELTA"))
    with pytest.raises(SpecError):
        world.loader.load(1)


def test_chains_groups_and_status(world):
    for i in (2, 3, 4):
        world.registry.add(world.spec.but(object_id=i, name=f"demo.t{i}"))
        world.store.create(f"demo.t{i}", world.data.schema, "t", "month")
    world.registry.chains["all"] = Chain("all", "1>>[2,3]>>4")
    i = world.loader.run_chain("all", D(2024, 1, 1), D(2024, 3, 1))
    assert i.status is Status.SUCCESS and all(len(values(world.store, n)) == 3 for n in ("demo.t", "demo.t2", "demo.t3", "demo.t4"))
    world.registry.dependencies += [(1, 4)]
    done = world.loader.run_group("g")
    assert sorted(done) == [1, 2, 3, 4] and done.index(4) < done.index(1)
    status = world.loader.status().collect()
    assert len(status) == 8 and {r.status_name for r in status} == {"SUCCESS"}
    world.registry.chains["bad"] = Chain("bad", "1>>77")
    with pytest.raises(ChainError):
        world.loader.run_chain("bad")
    world.registry.chains["off"] = Chain("off", "1", active=False)
    with pytest.raises(SpecError):
        world.loader.run_chain("off")
    world.functions.register("data", lambda c: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        world.loader.run_chain("all")
    assert world.registry.instances()[-1].status is Status.ERROR
    assert world.loader.activity() == []
    world.loader.cancel("demo.t")


def test_arguments_and_retries(world):
    got = []
    world.functions.register("args", lambda c, *a: got.append(a) or world.data)
    world.registry.add(world.spec.but(load_function="args($load_id, 'it''s, x', plain)"))
    (r,) = world.loader.load(1)
    assert got == [(str(r.load_id), "it's, x", "plain")]
    with pytest.raises(SpecError):
        world.functions.call("1 + 1; drop", None)
    tries = []

    def flaky(c):
        tries.append(1)
        if len(tries) < 2:
            raise OSError("once")
        return world.data

    world.functions.register("data", flaky)
    world.registry.add(world.spec)
    world.registry.chains["c"] = Chain("c", "1")
    assert world.loader.run_chain("c").status is Status.SUCCESS and len(tries) == 2
    world.registry.lock(0, "chain c")
    with pytest.raises(Locked):
        world.loader.run_chain("c")


def test_demo(world, spark, tmp_path):
    (tmp_path / "in.csv").write_text("int_column;text_column;decimal_column;date_column\n1;a;1.50;2024-01-01\n")
    ids = demo.install(world.loader, str(tmp_path / "in.csv"), rows=500, day=D(2024, 3, 9))
    assert ids == [1, 2, 3]
    world.loader.run_group("demo")
    assert world.store.read("demo.keyed").count() == 500 and world.store.read("demo.files").count() == 1
    total = world.store.read("demo.grouped").agg(F.sum("decimal_column_sum")).first()[0]
    assert total == demo.source(spark, 500, D(2024, 3, 9), keys=1000).agg(F.sum("decimal_column")).first()[0]
    assert len(world.store.partitions("demo.keyed")) == 4
    demo.uninstall(world.loader)
    assert world.registry.active("demo") == []
    set_parameter(spark, "tidemill.x", "1")
    assert get_parameter(spark, "tidemill.x") == "1" and get_parameter(spark, "tidemill.y") is None


def test_dump(world, tmp_path):
    made = catalog.dump(tmp_path / "dump", world.store, world.registry)
    assert "tables/demo.t.sql" in made and "changelog.yaml" in made
    assert "k bigint" in (tmp_path / "dump/tables/demo.t.sql").read_text()
    assert json.loads((tmp_path / "dump/objects/1.json").read_text())["load"] == "DELTA_UPSERT"


def test_streams(world, spark, tmp_path):
    world.data.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(world.data.schema).parquet(str(tmp_path / "in"))
    spec = world.spec.but(load="DELTA")
    load_stream(stream(), world.store, spec, str(tmp_path / "cp")).awaitTermination()
    assert len(values(world.store)) == 3
    # the same batch number again, as after a crash: nothing is added
    load_stream(stream(), world.store, spec, str(tmp_path / "cp2")).awaitTermination()
    assert len(values(world.store)) == 3
    world.data.withColumn("k", F.col("k") + 10).write.mode("append").parquet(str(tmp_path / "in"))
    load_stream(stream(), world.store, spec.but(load="UPDATE_PARTITION"), str(tmp_path / "cp")).awaitTermination()
    assert [k for k, _ in values(world.store)] == [1, 2, 3, 11, 12, 13]
    got = sessions(world.data.withColumn("t", F.col("t").cast("timestamp")), "t", "2 days", [], "1 day", n="count(*)").collect()
    assert sorted(r.n for r in got) == [1, 2]


def test_a_partition_load_opens_touched_partitions_only(world, spark, monkeypatch):
    world.store.replace("demo.t", world.data)
    world.data = spark.createDataFrame([(2, D(2024, 2, 7), 20.0)], world.data.schema)
    read = []
    real = world.store.read
    monkeypatch.setattr(world.store, "read", lambda name, parts=None, number=None: read.append((name, parts)) or real(name, parts, number))
    for load, parts in (("UPDATE_PARTITION", ["2024-02-01"]), ("PARTITION", [])):
        world.registry.add(world.spec.but(load=load))
        read.clear()
        (r,) = world.loader.load(1, D(2024, 2, 1), D(2024, 3, 1))
        assert [p for n, p in read if n == "demo.t"] == [parts]
        assert r.written == (2 if load == "UPDATE_PARTITION" else 1)


def test_written_counts_the_files_of_the_load(world, spark):
    world.registry.add(world.spec.but(load="DELTA", new_keys_only=True))
    assert world.loader.load(1)[0].written == 3
    world.data = world.data.unionByName(spark.createDataFrame([(4, D(2024, 3, 1), 4.0)], world.data.schema))
    (r,) = world.loader.load(1)
    assert (r.row_cnt, r.written) == (2, 1) and values(world.store) == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)]


def test_out_of_range_rows_raise_or_stay_out(world, spark):
    from tidemill.operators.ranges import OutOfRange

    world.data = spark.createDataFrame([(1, D(2024, 2, 1), 1.0), (2, None, 2.0), (3, D(1999, 1, 1), 3.0)], world.data.schema)
    how = dict(load="PARTITION", extraction="FULL", mode="FULL", first=D(2024, 1, 1))
    world.registry.add(world.spec.but(**how, out_of_range="raise"))
    with pytest.raises(OutOfRange):
        world.loader.load(1)
    world.registry.add(world.spec.but(**how, out_of_range="skip"))
    world.loader.load(1)
    assert values(world.store) == [(1, 1.0)]
    with pytest.raises(SpecError):
        world.spec.but(out_of_range="perhaps")


def test_pages_that_fail_block_later_ones(world):
    world.functions.register("page", lambda p: [(p * 10 + i, D(2024, 1, 1), float(i)) for i in range(3)] if p < 2 else 1 / 0)
    world.registry.add(world.spec.but(method="paged", load_function="page", source=SourceSpec("pages", splits=2), load="FULL", extraction="FULL"))
    with pytest.raises(Exception, match="division by zero"):
        world.loader.load(1)
    last = world.registry.runs(1)[-1]
    assert last.status is Status.ERROR and last.row_cnt == -1 and values(world.store) == []
    world.functions.register("page", lambda p: [(p * 10 + i, D(2024, 1, 1), float(i)) for i in range(3)] if p < 5 else [])
    world.loader.load(1)
    assert len(values(world.store)) == 15
