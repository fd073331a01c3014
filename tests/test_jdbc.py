"""Databases: exports by key, and a database that only the driver's process has."""

import os
import subprocess
import sys
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pyspark
import pytest

from tidemill.sources import embedded
from tidemill.sources.readers import read_jdbc
from tidemill.sources.sinks import JdbcSink, to_jdbc
from tidemill.spec import LoadSpec, SourceSpec

ROOT, DATA = Path(__file__).resolve().parent.parent, Path("/root/testdata/sf0.001")
CLUSTER = """
import sys
from pyspark.sql import SparkSession
name, data, out = sys.argv[1:]
conf = {"spark.executor.memory": "800m", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{out}/shared"}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=conf).getOrCreate()
import __spark_entry__
__spark_entry__.queries()[name](spark, data).write.parquet(f"{out}/rows")
"""


def on_a_cluster(name, tmp_path):
    """Differences between a query's rows, on executors that are processes of their own, and those of its SQL; the number of rows."""
    import duckdb

    import __spark_entry__

    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # executors' logs go to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", CLUSTER, name, str(DATA), str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-3000:]
    c = duckdb.connect()
    c.sql(f"create view orders as select * from '{DATA}/orders.parquet'")
    got, want = f"select * from '{tmp_path}/rows/*.parquet'", __spark_entry__.oracle_sql()[name]
    return c.sql(f"(({got}) except all ({want})) union all (({want}) except all ({got}))").fetchall(), len(c.sql(got).fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_export_where_tasks_run_in_other_processes(tmp_path):
    wrong, n = on_a_cluster("export_jdbc", tmp_path)
    assert not wrong and n


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_load_where_tasks_run_in_other_processes(tmp_path):
    wrong, n = on_a_cluster("load_jdbc", tmp_path)
    assert not wrong and n


@pytest.fixture
def url(tmp_path):
    return f"jdbc:derby:{tmp_path}/db;create=true"


@pytest.mark.parametrize("load", ["DELTA_UPSERT", "UPDATE_PARTITION"])
def test_null_keys_are_equal_and_found_by_index(spark, url, load):
    kind, day = "a long, b int, t timestamp_ntz, v double", datetime(2024, 1, 5)
    keys = [(1, 1), (1, None), (None, 1), (None, None), (2, 2)]
    sink = JdbcSink(spark, url, connections=2)
    spec = LoadSpec(1, "x.t", "FULL", load, ("a", "b"), "t", "t", "FULL", "export")
    sink.publish("x.t", spark.createDataFrame([(*k, day, 0.0) for k in keys] + [(3, None, day, 0.0), (None, 3, day, 0.0)], kind), spec.but(load="FULL"))
    later = datetime(2024, 2, 5)
    sink.publish("x.t", spark.createDataFrame([(*k, day, 1.0) for k in keys[:4]] + [(2, 2, later, 1.0)], kind), spec)
    want = {(*k, 1.0) for k in keys} | {(3, None, 0.0), (None, 3, 0.0)} | ({(2, 2, 0.0)} if load == "UPDATE_PARTITION" else set())
    got = [(r.a, r.b, r.v) for r in sink.read("x_t").collect()]
    assert set(got) == want and len(got) == len(want)
    gone = [x for x in sink.statements("x_t", "x_t_stage", ["a", "b", "t", "v"], spec.but(load="DELTA_UPSERT")) if x.startswith("DELETE")]
    assert len(gone) == 4 and not any(" OR " in x for x in gone)
    some = [x for x in sink.statements("x_t", "x_t_stage", ["a"], spec.but(load="DELTA_UPSERT", merge_key=tuple("abcdefghij")), ["c"]) if x.startswith("DELETE")]
    assert len(some) == 2 and "IS NULL" not in some[0] and 's."c" IS NULL' in some[1]


@pytest.mark.parametrize("java8", ["false", "true"])
def test_rows_by_way_of_the_driver(spark, url, monkeypatch, java8):
    kind = "`a key` long, s string, d date, t timestamp, n timestamp_ntz, p decimal(12,2), f double, b boolean, x binary"
    rows = [(i, f"ä{i}" * 50, date(2024, 1, 1 + i), datetime(2024, 1, 1, 3, i), datetime(2024, 7, 1, 2, i, 5), Decimal(i) / 4, i / 3, i % 2 == 0, bytes([i])) for i in range(8)] + [(None,) * 9]
    old = spark.conf.get(embedded.JAVA8)
    spark.conf.set(embedded.JAVA8, java8)
    try:
        df = spark.createDataFrame(rows, kind).repartition(3)
        to_jdbc(df, url, "plain", mode="overwrite", connections=1)
        monkeypatch.setattr(embedded, "driver_only", lambda *_: True)
        monkeypatch.setattr(embedded, "BLOCK", 2)
        for mode, times in (("overwrite", 1), ("append", 2), ("ignore", 2), ("overwrite", 1)):
            to_jdbc(df, url, "moved", mode=mode)
            assert spark.read.jdbc(url, "moved").count() == 9 * times
        for table in ("plain", "moved"):
            want, got = spark.read.jdbc(url, table), JdbcSink(spark, url).read(table)
            assert got.schema == want.schema and want.count() == 9
            assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        assert spark.read.jdbc(url, "plain").exceptAll(spark.read.jdbc(url, "moved")).isEmpty()
        to_jdbc(df.where("false"), url, "moved", mode="overwrite")
        assert JdbcSink(spark, url).read("moved").isEmpty()
        with pytest.raises(Exception, match="already exists"):
            to_jdbc(df, url, "moved", mode="error")
    finally:
        spark.conf.set(embedded.JAVA8, old)


def test_ranges_by_way_of_the_driver(spark, url, monkeypatch):
    """Each range by a query of its own; rows of no range, null ones among them, stay out."""
    rows = [(i, datetime(2024, 1, 1 + i, 12)) for i in range(20)] + [(99, None)]
    to_jdbc(spark.createDataFrame(rows, "k long, t timestamp_ntz"), url, "days", mode="overwrite", connections=1)
    source = SourceSpec("jdbc", options={"url": url, "dbtable": "days", "preferTimestampNTZ": "true"}, splits=4, rename={"t": '"t"'})
    spec = LoadSpec(1, "x.days", "DELTA", "DELTA", ("k",), "t", mode="DELTA", method="jdbc", source=source)
    window = datetime(2024, 1, 3), datetime(2024, 1, 13)
    there, whole = read_jdbc(spark, spec, {}, *window), read_jdbc(spark, spec, {})
    monkeypatch.setattr(embedded, "driver_only", lambda *_: True)
    monkeypatch.setattr(embedded, "BLOCK", 3)
    got = read_jdbc(spark, spec, {}, *window)
    assert got.schema == there.schema and sorted(got.collect()) == sorted(there.collect()) and sorted(r.k for r in got.collect()) == list(range(2, 12))
    assert sorted(r.k for r in read_jdbc(spark, spec, {}).collect()) == sorted(r.k for r in whole.collect()) == [*range(20), 99]
    query = spec.but(source=SourceSpec("jdbc", options={"url": url, "query": 'SELECT "k" FROM days WHERE "k" < 3'}))
    assert sorted(r.k for r in read_jdbc(spark, query, {}).collect()) == [0, 1, 2]


@pytest.mark.parametrize("url, inside", [("jdbc:derby:memory:x;create=true", True), ("jdbc:derby:/a/b", True), ("jdbc:derby://host:1527/b", False), ("jdbc:h2:mem:x", True), ("jdbc:h2:tcp://host/x", False), ("jdbc:hsqldb:file:x", True), ("jdbc:hsqldb:hsql://host/x", False), ("jdbc:sqlite:x", True), ("jdbc:postgresql://host/x", False)])
def test_urls_without_a_host(url, inside):
    class Context:
        master = "spark://host:7077"

    class Cluster:
        sparkContext = Context

    assert embedded.driver_only(Cluster, url) is inside
    Context.master = "local[4]"
    assert not embedded.driver_only(Cluster, url)
