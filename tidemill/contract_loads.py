"""Queries that carry out whole loads: specification, plan, source, table and registry, with SQL for the rows that come of it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog, demo
from .contract import query, t, ts
from .files import shared
from .functions import names, session
from .loader import Loader
from .operators import Scd2, keep_by_query, ranges, refresh_columns, scd2, united
from .plans.periods import Period
from .registry import Chain, Registry
from .sources.readers import Functions, read_jdbc, read_pages
from .sources.sinks import JdbcSink, to_jdbc
from .spec import LoadSpec, SourceSpec, Status
from .store import TableStore
from .streaming import sessions

NOW = ts(2024, 6, 1, 12)
EARLY = ts(1990, 1, 1)


class World:
    """A store, a registry and a loader in a new folder that executors share."""

    def __init__(self, spark: SparkSession, sink=None):
        self.spark, self.now, self.root = spark, NOW, shared(spark, "loads")
        self.store = TableStore(spark, f"{self.root}/store")
        self.sink = sink or TableStore(spark, f"{self.root}/sink")
        self.registry = Registry(f"{self.root}/state", lambda: self.now, spark)
        self.functions = Functions()
        self.loader = Loader(spark, self.store, self.registry, self.functions, self.sink, lock_tries=1, lock_pause=0)

    def table(self, name: str, rows: DataFrame, field: str | None = None, period: str | None = None, **how) -> None:
        self.store.create(name, rows.schema, field, period, **how)
        self.store.replace(name, rows)

    def source(self, rows: DataFrame, spec: LoadSpec) -> LoadSpec:
        self.functions.register("rows", lambda _: rows)
        return self.registry.add(spec.but(load_function="rows"))


ORDERS = LoadSpec(1, "demo.orders", "DELTA", "DELTA", ("o_orderkey",), "o_orderdate", "o_orderdate", "DELTA", delta_start=EARLY)


def raised(df: DataFrame) -> DataFrame:
    return df.withColumn("o_totalprice", F.col("o_totalprice") + 1)


_UP = "SELECT * REPLACE (o_totalprice + 1 AS o_totalprice) FROM orders"


# -- load types


@query("SELECT * FROM orders WHERE o_orderstatus = 'O'")
def load_full(spark, d):
    w, o = World(spark), t(spark, d, "orders")
    w.table("demo.orders", o.where("o_orderstatus = 'F'"))
    w.source(o.where("o_orderstatus = 'O'"), ORDERS.but(extraction="FULL", load="FULL", mode="FULL"))
    w.loader.load(1)
    w.source(o.where("false"), w.registry.spec(1))
    w.loader.load(1)
    return w.store.read("demo.orders")


@query("SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' UNION ALL SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' AND o_orderdate >= (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01')")
def load_delta(spark, d):
    """The moment up to which the first run came is read again by the second."""
    w, o = World(spark), t(spark, d, "orders")
    w.table("demo.orders", o.where("false"))
    w.source(o, ORDERS)
    for end in (ts(1999, 1, 1), ts(2001, 1, 1)):
        w.loader.load(1, end=end)
    return w.store.read("demo.orders")


@query("SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'")
def load_delta_new_keys(spark, d):
    w, o = World(spark), t(spark, d, "orders")
    w.table("demo.orders", o.where("false"))
    w.source(o, ORDERS.but(new_keys_only=True))
    for end in (ts(1999, 1, 1), ts(2001, 1, 1)):
        w.loader.load(1, end=end)
    return w.store.read("demo.orders")


@query(f"WITH src AS ({_UP} WHERE o_orderdate >= TIMESTAMP '2000-01-01') SELECT * FROM src UNION ALL SELECT * FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM src)")
def load_delta_merge(spark, d):
    w, o = World(spark), t(spark, d, "orders")
    w.table("demo.orders", o.where("o_orderkey % 7 <> 0"))
    w.source(raised(o), ORDERS.but(load="DELTA_MERGE"))
    w.loader.load(1, ts(2000, 1, 1))
    w.loader.load(1, ts(2001, 1, 1))
    return w.store.read("demo.orders")


_LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS FIRST, l_partkey DESC NULLS FIRST, l_suppkey DESC NULLS FIRST, l_quantity DESC NULLS FIRST, l_extendedprice DESC NULLS FIRST, l_discount DESC NULLS FIRST, l_tax DESC NULLS FIRST, l_returnflag DESC NULLS FIRST, l_linestatus DESC NULLS FIRST) AS nth FROM lineitem WHERE {}"


@query(f"WITH s AS ({_LINES.format("l_shipdate >= TIMESTAMP '2001-06-01'")}), t AS ({_LINES.format("l_shipdate >= TIMESTAMP '2001-05-01' AND l_shipdate < TIMESTAMP '2001-06-15'")}) SELECT * EXCLUDE nth FROM s WHERE nth = 1 UNION ALL SELECT * EXCLUDE nth FROM t WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber)")
def load_delta_merge_drop(spark, d):
    w, x = World(spark), t(spark, d, "lineitem")
    w.table("demo.lines", x.where((F.col("l_shipdate") >= F.lit(ts(2001, 5, 1))) & (F.col("l_shipdate") < F.lit(ts(2001, 6, 15)))))
    w.source(x, LoadSpec(1, "demo.lines", "DELTA", "DELTA_MERGE", ("l_orderkey", "l_linenumber"), "l_shipdate", mode="DELTA", duplicates="drop"))
    w.loader.load(1, ts(2001, 6, 1))
    return w.store.read("demo.lines")


@query("WITH src AS (SELECT * FROM events WHERE event_id % 3 = 0), one AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM src) WHERE r = 1) SELECT * FROM one UNION ALL SELECT * FROM events e WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM src WHERE src.user_id = e.user_id AND src.event_type = e.event_type)")
def load_delta_upsert(spark, d):
    w, e = World(spark), t(spark, d, "events")
    w.table("demo.events", e.where("event_id % 2 = 0"))
    w.source(e.where("event_id % 3 = 0"), LoadSpec(1, "demo.events", "DELTA", "DELTA_UPSERT", ("user_id", "event_type"), "ts", mode="DELTA", duplicates="drop", delta_start=EARLY))
    w.loader.load(1)
    w.loader.load(1)
    return w.store.read("demo.events")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderdate >= TIMESTAMP '2000-01-01' THEN 'U' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def load_delta_update(spark, d):
    w, o = World(spark), t(spark, d, "orders")
    w.table("demo.orders", o)
    w.source(o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("U")), ORDERS.but(load="DELTA_UPDATE"))
    w.loader.load(1, ts(2000, 1, 1))
    return w.store.read("demo.orders")


_M = "date_trunc('month', {}o_orderdate)"


@query(f"WITH src AS ({_UP} WHERE o_orderdate >= TIMESTAMP '2001-05-15') SELECT * FROM src UNION ALL SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2001-06-01' AND {_M.format('')} NOT IN (SELECT {_M.format('')} FROM src)")
def load_partition(spark, d):
    w, o = World(spark), t(spark, d, "orders")
    w.table("demo.orders", o.where(F.col("o_orderdate") < F.lit(ts(2001, 6, 1))), "o_orderdate", "month")
    w.source(raised(o), ORDERS.but(load="PARTITION"))
    w.loader.load(1, ts(2001, 5, 15))
    return w.store.read("demo.orders")


@query(f"WITH src AS ({_UP} WHERE o_orderdate >= TIMESTAMP '2001-05-15') SELECT * FROM src UNION ALL SELECT * FROM orders t WHERE o_orderdate < TIMESTAMP '2001-06-01' AND NOT EXISTS (SELECT 1 FROM src WHERE src.o_orderkey = t.o_orderkey AND {_M.format('src.')} = {_M.format('t.')})")
def load_update_partition(spark, d):
    w, o = World(spark), t(spark, d, "orders")
    w.table("demo.orders", o.where(F.col("o_orderdate") < F.lit(ts(2001, 6, 1))), "o_orderdate", "month", keys=["o_orderkey"])
    w.source(raised(o), ORDERS.but(load="UPDATE_PARTITION"))
    before = w.store.version("demo.orders")
    (run,) = w.loader.load(1, ts(2001, 5, 15))
    after = w.store.version("demo.orders")
    kept = [p for p, x in before.parts.items() if after.parts[p] == x]
    assert len(kept) == len(before.parts) - 1 and run.written == w.store.read("demo.orders", [p for p in after.parts if p not in kept]).count()
    return w.store.read("demo.orders")


@query("WITH src AS (SELECT * REPLACE (o_orderdate + INTERVAL 1 MONTH AS o_orderdate) FROM orders WHERE o_orderkey % 10 = 0) SELECT * FROM src UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 <> 0")
def load_global_key(spark, d):
    w, o = World(spark), t(spark, d, "orders")
    w.table("demo.orders", o, "o_orderdate", "month")
    w.source(o.where("o_orderkey % 10 = 0").withColumn("o_orderdate", F.expr("o_orderdate + interval 1 month")), ORDERS.but(load="UPDATE_PARTITION", extraction="FULL", mode="FULL", global_key=True))
    w.loader.load(1)
    return w.store.read("demo.orders")


@query("SELECT * FROM orders WHERE o_orderkey % 100 < 3 AND o_orderkey % 3 = 2 UNION ALL SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND date_trunc('month', o_orderdate) NOT IN (SELECT date_trunc('month', o_orderdate) FROM orders WHERE o_orderkey % 100 < 3 AND o_orderkey % 3 = 2)")
def load_out_of_range(spark, d):
    w, o = World(spark), t(spark, d, "orders")
    w.table("demo.orders", o.where(F.col("o_orderdate") < F.lit(ts(1996, 1, 1))), "o_orderdate", "month")
    odd = o.where("o_orderkey % 100 < 3").withColumn("o_orderdate", F.when(F.col("o_orderkey") % 3 == 0, None).when(F.col("o_orderkey") % 3 == 1, F.lit(ts(1980, 5, 5))).otherwise(F.col("o_orderdate")))
    w.source(odd, ORDERS.but(load="PARTITION", extraction="FULL", mode="FULL", out_of_range="skip", first=ts(1995, 1, 1)))
    w.loader.load(1)
    return w.store.read("demo.orders")


_TWICE = "SELECT o_orderkey, max(v) AS v FROM (SELECT o_orderkey, o_totalprice + k AS v FROM orders, range(2) AS r(k) WHERE o_orderkey % 6 = 0) GROUP BY o_orderkey"


@query(f"SELECT o.* REPLACE (coalesce(s.v, o.o_totalprice) AS o_totalprice) FROM orders o LEFT JOIN ({_TWICE}) s USING (o_orderkey)")
def load_columns(spark, d):
    """Every source key twice: the greater price counts, and no row of the table is multiplied."""
    w, o = World(spark), t(spark, d, "orders")
    w.table("demo.orders", o, "o_orderdate", "month")
    some = o.where("o_orderkey % 6 = 0").select("o_orderkey", "o_totalprice")
    w.source(some.unionByName(some.withColumn("o_totalprice", F.col("o_totalprice") + 1)), ORDERS.but(load="COLUMNS", extraction="FULL", mode="FULL", columns=("o_totalprice",)))
    w.loader.load(1)
    return w.store.read("demo.orders")


@query("WITH s AS (SELECT nullif(user_id, 3) AS user_id, max(value) AS value FROM events WHERE event_id % 4 = 0 GROUP BY 1) SELECT e.event_id, nullif(e.user_id, 3) AS user_id, s.value FROM events e JOIN s ON nullif(e.user_id, 3) = s.user_id")
def column_refresh_repeated(spark, d):
    e = t(spark, d, "events").select("event_id", F.expr("nullif(user_id, 3)").alias("user_id"), "value")
    return refresh_columns(e, e.where("event_id % 4 = 0").select("user_id", "value"), ["user_id"], ["value"])


_DAYS = "DATE '{}' AS date_from, DATE '{}' AS date_to"
_SNAP = "SELECT c_custkey, max(c_acctbal) AS c_acctbal FROM (SELECT nullif(c_custkey, 3) AS c_custkey, c_acctbal + k AS c_acctbal FROM customer, range({0}) AS r(k) WHERE c_custkey % {1} <> 0) GROUP BY c_custkey"


@query(f"""WITH a AS ({_SNAP.format(1, 13)}), b AS ({_SNAP.format(2, 17)})
SELECT *, {_DAYS.format('2024-06-01', '2024-06-08')} FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.c_custkey IS NOT DISTINCT FROM a.c_custkey AND b.c_acctbal = a.c_acctbal)
UNION ALL SELECT *, {_DAYS.format('2024-06-09', '2999-01-01')} FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.c_custkey IS NOT DISTINCT FROM a.c_custkey AND b.c_acctbal = a.c_acctbal)
UNION ALL SELECT a.*, {_DAYS.format('2024-06-01', '2999-01-01')} FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.c_custkey IS NOT DISTINCT FROM a.c_custkey AND b.c_acctbal = a.c_acctbal)""")
def load_history(spark, d):
    """Two snapshots eight days apart, the second with every key twice, and a null key in both."""
    w = World(spark)
    c = t(spark, d, "customer").select(F.expr("nullif(c_custkey, 3)").alias("c_custkey"), F.col("c_custkey").alias("k"), "c_acctbal")
    w.store.create("demo.history", spark.createDataFrame([], "c_custkey long, c_acctbal double, date_from date, date_to date").schema)
    spec = LoadSpec(1, "demo.history", "FULL", "HISTORY", ("c_custkey",), mode="FULL")
    w.source(c.where("k % 13 <> 0"), spec)
    w.loader.load(1)
    some = c.where("k % 17 <> 0")
    w.source(some.unionByName(some.withColumn("c_acctbal", F.col("c_acctbal") + 1)), spec)
    w.now = ts(2024, 6, 9)
    w.loader.load(1)
    return w.store.read("demo.history")


@query("SELECT c_custkey, max(c_acctbal) AS c_acctbal, DATE '2024-06-01' AS date_from, DATE '2999-01-01' AS date_to FROM (SELECT nullif(c_custkey, 3) AS c_custkey, c_acctbal + k AS c_acctbal FROM customer, range(2) AS r(k) WHERE c_custkey % 13 <> 0) GROUP BY c_custkey UNION ALL SELECT nullif(c_custkey, 3), c_acctbal, DATE '2024-01-01', DATE '2024-05-31' FROM customer WHERE c_custkey % 13 <> 0")
def scd2_repeated(spark, d):
    c = t(spark, d, "customer").where("c_custkey % 13 <> 0").select(F.expr("nullif(c_custkey, 3)").alias("c_custkey"), "c_acctbal")
    old = c.withColumns({"date_from": F.lit(date(2024, 1, 1)), "date_to": F.lit(date(2999, 1, 1))})
    return scd2(old, c.unionByName(c.withColumn("c_acctbal", F.col("c_acctbal") + 1)), Scd2(["c_custkey"], date(2024, 6, 1)))


# -- planning, retries, chains


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-01'")
def load_after_failure(spark, d):
    """Windows by month; the first fails once.  It comes again before the others, and none is lost."""
    w, o = World(spark), t(spark, d, "orders")
    w.table("demo.orders", o.where("false"))
    failed = []

    def rows(context):
        if not failed:
            failed.append(context.run.load_id)
            raise OSError("the source is away")
        return o

    w.functions.register("rows", rows)
    w.now = ts(1995, 3, 20)
    w.registry.add(ORDERS.but(mode="ITER", interval=Period.of(1, "month"), load_function="rows", delta_start=ts(1995, 1, 1), new_keys_only=True))
    for _ in range(3):
        try:
            w.loader.load(1)
        except OSError:
            continue
    return w.store.read("demo.orders")


@query("SELECT CAST(row_number() OVER (ORDER BY s) AS BIGINT) AS load_id, CAST(s AS TIMESTAMP) AS extraction_from, CAST(s + INTERVAL 1 MONTH AS TIMESTAMP) AS extraction_to, CASE month(s) WHEN 1 THEN 'ERROR' WHEN 2 THEN 'SUCCESS' ELSE 'NEW' END AS before_plan, CASE month(s) WHEN 2 THEN 'SUCCESS' ELSE 'NEW' END AS after_plan FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-04-01', INTERVAL 1 MONTH) AS g(s)")
def plan_after_failure(spark, d):
    """January failed, February succeeded by hand: January is due again, with what was open, and one more month."""
    w = World(spark)
    w.now = ts(2024, 3, 20)
    w.registry.add(ORDERS.but(mode="ITER", interval=Period.of(1, "month"), delta_start=ts(2024, 1, 1)))
    w.registry.plan(1)
    w.registry.set_error(1)
    w.registry.set_success(2)
    before = {r.load_id: r for r in w.registry.runs(1)} | {4: None}
    w.now = ts(2024, 4, 20)
    due = [r.load_id for r in w.registry.plan(1)]
    assert due == [1, 3, 4]
    rows = [(r.load_id, r.extraction_from, r.extraction_to, before[r.load_id].status.name if before[r.load_id] else "NEW", r.status.name) for r in w.registry.runs(1)]
    return spark.createDataFrame(rows, "load_id long, extraction_from timestamp_ntz, extraction_to timestamp_ntz, before_plan string, after_plan string")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'SUCCESS', CAST(25 AS BIGINT)), (2, 'SUCCESS', 25), (3, 'ERROR', NULL), (4, 'SUCCESS', 25)) AS v(object_id, status, row_cnt)")
def chain_run(spark, d):
    """1>>[2,3]>>4, of which 3 fails; then 4 alone, as those behind an error aren't begun."""
    w, n = World(spark), t(spark, d, "nation")
    w.functions.register("rows", lambda _: n)
    w.functions.register("away", lambda _: 1 / 0)
    for k in (1, 2, 3, 4):
        w.store.create(f"demo.n{k}", n.schema)
        w.registry.add(LoadSpec(k, f"demo.n{k}", load_function="away" if k == 3 else "rows"))
    w.registry.chains["all"] = Chain("all", "1>>[2,3]>>4")
    w.registry.chains["last"] = Chain("last", "4")
    for name in ("all", "last"):
        try:
            w.loader.run_chain(name, retries=0)
        except ZeroDivisionError:
            assert name == "all" and not w.registry.runs(4)
    assert [i.status for i in w.registry.instances()] == [Status.ERROR, Status.SUCCESS]
    rows = [(r.object_id, r.status.name, r.row_cnt) for r in w.registry.runs()]
    return spark.createDataFrame(rows, "object_id long, status string, row_cnt long")


@query("SELECT * FROM (VALUES (CAST(3 AS BIGINT), CAST(1 AS BIGINT)), (1, 2), (2, 3)) AS v(object_id, nth)")
def group_order(spark, d):
    w, n, done = World(spark), t(spark, d, "nation"), []
    w.functions.register("rows", lambda c: done.append(c.spec.object_id) or n)
    for k in (1, 2, 3):
        w.store.create(f"demo.n{k}", n.schema)
        w.registry.add(LoadSpec(k, f"demo.n{k}", load_function="rows", group="g"))
    w.registry.dependencies = [(1, 3), (2, 1)]
    w.loader.run_group("g", workers=1)
    return spark.createDataFrame([(k, n + 1) for n, k in enumerate(done)], "object_id long, nth long")


@query("SELECT * FROM (VALUES ('demo.a', CAST(7 AS BIGINT), 'LOAD'), ('demo.b', 8, 'CHAIN')) AS v(object_name, load_id, lock_type)")
def load_locks(spark, d):
    w = World(spark)
    assert w.registry.lock(7, "demo.a") and not w.registry.lock(9, "demo.a") and w.registry.lock(8, "demo.b", "CHAIN") and w.registry.lock(9, "demo.c")
    w.registry.unlock(load_id=9)
    return spark.createDataFrame([(x["object_name"], x["load_id"], x["lock_type"]) for x in w.registry.locks()], "object_name string, load_id long, lock_type string")


@query("SELECT * FROM (VALUES ('INFO', 'start', FALSE, CAST(3 AS BIGINT)), ('ERROR', 'broken', TRUE, 3)) AS v(type, msg, is_error, load_id)")
def load_logs(spark, d):
    w = World(spark)
    w.registry.log("INFO", "start", "run", 3)
    w.registry.log("ERROR", "broken", "run", 3)
    w.registry.log("INFO", "other", "run", 4)
    return spark.createDataFrame([(x["type"], x["msg"], x["is_error"], x["load_id"]) for x in w.registry.logs(load_id=3)], "type string, msg string, is_error boolean, load_id long")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'demo.orders', 'DELTA_MERGE', 'o_orderkey', 'rows', '1>>2', CAST(2 AS BIGINT), 'ext_', CAST(3 AS BIGINT))) AS v(object_id, name, load, merge_key, load_function, chain, depends_on, prefix, changes)")
def registry_reopened(spark, d):
    """Specifications, chains, dependencies, constants and the history of changes, as another process finds them."""
    w = World(spark)
    w.registry.add(ORDERS)
    w.registry.add(ORDERS.but(load="DELTA_MERGE", load_function="rows", interval=Period.of(1, "month"), source=SourceSpec(rename={"a": "b"})))
    w.registry.add(ORDERS.but(object_id=2))
    w.registry.chains["c"] = Chain("c", "1>>2")
    w.registry.dependencies = [(1, 2)]
    again = Registry(f"{w.root}/state", lambda: NOW, spark)
    s = again.spec(1)
    assert s == w.registry.spec(1)
    return spark.createDataFrame([(1, s.name, s.load.value, ",".join(again.merge_key(1)), again.load_function(1), again.chains["c"].sequence, again.dependencies[0][1], again.constant("ext"), len(again.history))], "object_id long, name string, load string, merge_key string, load_function string, chain string, depends_on long, prefix string, changes long")


@query("SELECT 'a value' AS own, CAST(NULL AS VARCHAR) AS other")
def session_parameters(spark, d):
    session.set_parameter(spark, "tidemill.contract", "a value")
    return spark.createDataFrame([(session.get_parameter(spark, "tidemill.contract"), session.get_parameter(spark, "tidemill.unknown"))], "own string, other string")


# -- the store


def _orders(spark, d, period="month"):
    w, o = World(spark), t(spark, d, "orders")
    w.table("demo.orders", o, "o_orderdate", period)
    return w, o


@query("SELECT * FROM orders WHERE date_trunc('month', o_orderdate) <> TIMESTAMP '1996-03-01' UNION ALL SELECT * REPLACE (TIMESTAMP '1996-03-09' AS o_orderdate) FROM orders WHERE o_orderkey % 50 = 0")
def store_switch_partition(spark, d):
    w, o = _orders(spark, d)
    w.store.create_like("demo.new", "demo.orders")
    w.store.replace("demo.new", o.where("o_orderkey % 50 = 0").withColumn("o_orderdate", F.lit(ts(1996, 3, 9))))
    w.store.switch_partition("demo.orders", ts(1996, 3, 20), "demo.new")
    return w.store.read("demo.orders")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 50 = 1")
def store_switch_default(spark, d):
    w = World(spark)
    o = t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    w.table("demo.orders", o.withColumn("o_orderdate", F.expr("case when o_orderkey % 9 <> 0 then o_orderdate end")), "o_orderdate", "month")
    w.table("demo.new", o.where("o_orderkey % 50 = 1").withColumn("o_orderdate", F.lit(None).cast("timestamp_ntz")), "o_orderdate", "month")
    assert w.store.switch_default("demo.orders", "demo.new")
    return w.store.read("demo.orders")


@query("SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-02-01' OR o_orderdate >= TIMESTAMP '1997-06-01'")
def store_drop_range(spark, d):
    w, _ = _orders(spark, d)
    w.store.drop_range("demo.orders", ts(1997, 2, 11), ts(1997, 5, 2))
    return w.store.read("demo.orders")


@query("SELECT 'm_' || strftime(m, '%m_%Y') AS name, CASE WHEN m >= TIMESTAMP '1997-02-01' AND m < TIMESTAMP '1997-06-01' THEN 0 ELSE n END AS n FROM (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1)")
def store_truncate_range(spark, d):
    """Emptied partitions stay known."""
    w, _ = _orders(spark, d)
    w.store.truncate_range("demo.orders", ts(1997, 2, 11), ts(1997, 5, 2))
    have = {r[0]: r[1] for r in w.store.read("demo.orders").groupBy(F.date_format("o_orderdate", "'m_'MM_yyyy")).count().collect()}
    return spark.createDataFrame([(p.name, have.get(p.name, 0)) for p in w.store.partitions("demo.orders")], "name string, n long")


@query("SELECT CASE WHEN m < TIMESTAMP '2001-06-01' THEN 'm_' || strftime(m, '%m_%Y') ELSE 'd_' || strftime(m, '%d_%m_%Y') END AS name, n FROM (SELECT CASE WHEN o_orderdate < TIMESTAMP '2001-06-01' THEN date_trunc('month', o_orderdate) ELSE date_trunc('day', o_orderdate) END AS m, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1) UNION ALL SELECT 'default', count(*) FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'")
def store_mixed_periods(spark, d):
    """Months, then days; what lies before the first month is in the default partition."""
    w, _ = _orders(spark, d, "2000-01-01=month;2001-06-01=day")
    rows = [(p.name, w.store.read("demo.orders", [p.start.strftime("%Y-%m-%d")]).count()) for p in w.store.partitions("demo.orders") if p.start.month < 3 or p.start >= ts(2001, 6, 1)]
    first = {r[0] for r in rows}
    rest = w.store.read("demo.orders").select(ranges.start_of(F.col("o_orderdate"), "2000-01-01=month;2001-06-01=day").alias("p")).groupBy("p").count().collect()
    known = {p.start.date(): p.name for p in w.store.partitions("demo.orders")}
    rows += [(known[r[0]] if r[0] else "default", r[1]) for r in rest if r[0] is None or known[r[0]] not in first]
    return spark.createDataFrame(rows, "name string, n long")


@query(f"WITH src AS ({_UP} WHERE o_orderdate >= TIMESTAMP '2001-05-20' AND o_orderdate < TIMESTAMP '2001-06-10') SELECT * FROM src UNION ALL SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src)")
def load_mixed_periods(spark, d):
    w, o = _orders(spark, d, "2000-01-01=month;2001-06-01=day")
    w.source(raised(o), ORDERS.but(load="UPDATE_PARTITION"))
    w.loader.load(1, ts(2001, 5, 20), ts(2001, 6, 10))
    return w.store.read("demo.orders")


@query("SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def store_insert(spark, d):
    w, n = World(spark), t(spark, d, "nation")
    w.table("demo.nation", n)
    n.createOrReplaceTempView("contract_nation")
    assert w.store.insert_query("demo.nation", "select n_nationkey + 100 as a, n_name as b, n_regionkey as c from contract_nation where n_regionkey = 1") == n.where("n_regionkey = 1").count()
    return w.store.read("demo.nation")


@query("SELECT * FROM nation WHERE n_regionkey = 1")
def store_rollback(spark, d):
    w, n = World(spark), t(spark, d, "nation")
    w.table("demo.nation", n.where("n_regionkey = 1"))
    w.store.append("demo.nation", n)
    w.store.rollback("demo.nation")
    return w.store.read("demo.nation")


@query("SELECT * FROM nation WHERE n_regionkey = 2")
def store_create_like(spark, d):
    w, n = World(spark), t(spark, d, "nation")
    w.table("demo.nation", n)
    w.store.create_like("demo.tmp", "demo.nation")
    w.store.truncate("demo.nation")
    w.store.append("demo.tmp", n.where("n_regionkey = 2"))
    assert w.store.exists("demo.tmp") and w.store.read("demo.nation").isEmpty()
    return w.store.read("demo.tmp")


@query("SELECT * FROM (SELECT 'n_nationkey' AS \"column\", count(*) AS rows, CAST(0 AS BIGINT) AS nulls, CAST(min(n_nationkey) AS VARCHAR) AS least, CAST(max(n_nationkey) AS VARCHAR) AS greatest FROM nation UNION ALL SELECT 'n_name', count(*), 0, min(n_name), max(n_name) FROM nation)")
def store_statistics(spark, d):
    w = World(spark)
    w.table("demo.nation", t(spark, d, "nation"))
    w.store.analyze("demo.nation", ["n_nationkey", "n_name"])
    kept = w.store.known_statistics("demo.nation")
    return spark.createDataFrame([(c, x["rows"], x["nulls"], x["least"], x["greatest"]) for c, x in kept.items()], "column string, rows long, nulls long, least string, greatest string")


@query("SELECT 'o_orderdate' AS partition_key, 'month' AS period, 'o_orderkey' AS distribution_key, CAST(6 AS BIGINT) AS columns")
def store_describe(spark, d):
    w = World(spark)
    w.store.create("demo.orders", t(spark, d, "orders").schema, "o_orderdate", "month", keys=["o_orderkey"])
    x = w.store.describe("demo.orders")
    return spark.createDataFrame([(x["partition_key"], x["period"], ",".join(w.store.distribution_key("demo.orders")), len(x["columns"]))], "partition_key string, period string, distribution_key string, columns long")


# -- sources and sinks


@query("SELECT * FROM orders WHERE o_orderkey % 20 = 0")
def load_csv(spark, d):
    w, o = World(spark), t(spark, d, "orders")
    w.store.create("demo.orders", o.schema)
    o.where("o_orderkey % 20 = 0").withColumnRenamed("o_orderkey", "key").write.option("header", "true").option("sep", ";").csv(f"{w.root}/in")
    w.registry.add(LoadSpec(1, "demo.orders", method="files", source=SourceSpec("csv", f"{w.root}/in", {"header": "true", "sep": ";"}, rename={"o_orderkey": "key"})))
    w.loader.load(1)
    return w.store.read("demo.orders")


@query("SELECT * FROM orders WHERE o_orderkey % 20 = 1")
def load_json(spark, d):
    """With a bad row, which the limit allows."""
    w, o = World(spark), t(spark, d, "orders")
    w.store.create("demo.orders", o.schema)
    o.where("o_orderkey % 20 = 1").write.json(f"{w.root}/in")
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(f"{w.root}/in")
    w.registry.add(LoadSpec(1, "demo.orders", method="files", source=SourceSpec("json", f"{w.root}/in", reject_limit=1)))
    w.loader.load(1)
    return w.store.read("demo.orders")


def _database(w: World) -> str:
    """On the driver's disk, so that its memory doesn't grow with the rows."""
    folder = tempfile.mkdtemp(prefix="derby-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"jdbc:derby:{folder}/{w.root.rpartition('/')[2]};create=true"


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-07-01'")
def load_jdbc(spark, d):
    """A connection for each part of the window; the database runs in the session's own process."""
    w = World(spark)
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate").where(F.year("o_orderdate") == 1998)
    url = _database(w)
    to_jdbc(o, url, "orders", mode="error", connections=1)
    w.store.create("demo.orders", o.schema)
    source = SourceSpec("jdbc", options={"url": url, "dbtable": "orders", "preferTimestampNTZ": "true"}, splits=4, rename={"o_orderdate": '"o_orderdate"'})
    w.registry.add(ORDERS.but(method="jdbc", source=source, where=None, load="DELTA"))
    spec = w.registry.spec(1)
    rows = read_jdbc(spark, spec, {}, ts(1998, 1, 1), ts(1998, 7, 1))
    w.store.replace("demo.orders", rows)
    return w.store.read("demo.orders")


@query("SELECT o_orderkey, o_totalprice + CASE WHEN o_orderdate >= TIMESTAMP '1998-06-10' THEN 1 ELSE 0 END AS o_totalprice, o_orderdate FROM orders WHERE year(o_orderdate) = 1998")
def export_jdbc(spark, d):
    """A table at a database: filled in full, then by key, then by key within months."""
    w = World(spark)
    sink = w.loader.sink = JdbcSink(spark, _database(w), connections=2)
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate").where(F.year("o_orderdate") == 1998)
    w.table("demo.orders", o.where(F.col("o_orderdate") < F.lit(ts(1998, 9, 1))))
    export = ORDERS.but(method="export")
    w.registry.add(export.but(load="FULL", extraction="FULL", mode="FULL"))
    w.loader.load(1)
    w.store.replace("demo.orders", o.withColumn("o_totalprice", F.when(F.col("o_orderdate") >= F.lit(ts(1998, 6, 10)), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))))
    w.registry.add(export.but(load="DELTA_UPSERT"))
    w.loader.load(1, ts(1998, 6, 10), ts(1998, 10, 1))
    w.registry.add(export.but(load="UPDATE_PARTITION"))
    w.loader.load(1, ts(1998, 8, 15), ts(1999, 1, 1))
    return sink.read("demo_orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 0 OR o_orderdate >= TIMESTAMP '2001-01-01'")
def load_export(spark, d):
    w, o = World(spark), t(spark, d, "orders")
    w.table("demo.orders", o)
    w.sink.create("demo.orders", o.schema, "o_orderdate", "month")
    w.sink.replace("demo.orders", o.where("o_orderkey % 2 = 0"))
    w.registry.add(ORDERS.but(method="export", load="UPDATE_PARTITION"))
    w.loader.load(1, ts(2001, 1, 1), ts(2002, 1, 1))
    return w.sink.read("demo.orders")


@query("SELECT CAST(p * 100 + i AS BIGINT) AS id, 'page ' || p AS page FROM range(7) AS a(p), range(20) AS b(i)")
def paged_until_empty(spark, d):
    """Nobody says how many pages there are."""
    w = World(spark)
    w.store.create("demo.pages", spark.createDataFrame([], "id long, page string").schema)
    counts = []
    read_pages(w.store, "demo.pages", lambda p: [(p * 100 + i, f"page {p}") for i in range(20)] if p < 7 else [], 3, counts.append)
    assert counts == [60, 120, 140]
    return w.store.read("demo.pages")


@query("SELECT * FROM (VALUES ('demo', 'orders', 'stg_demo.ext_orders_7', 'stg_demo.delta_orders_7', 'sink.ext_orders_7', 'src_demo.bkp_orders', 'src_demo.buffer_orders_x')) AS v(schema_name, table_name, external, delta, export, backup, buffer)")
def table_names(spark, d):
    n = "src_Demo.'Orders'"
    row = (names.schema_of(" Demo.orders"), names.table_of(n), names.external(n, 7), names.delta(n, 7), names.export(n, 7, "sink"), names.backup(n), names.buffer(n, "x"))
    return spark.createDataFrame([row], "schema_name string, table_name string, external string, delta string, export string, backup string, buffer string")


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 2 DAY OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM e) SELECT CAST(min(ts) AS TIMESTAMP) AS session_start, CAST(max(ts) + INTERVAL 2 DAY AS TIMESTAMP) AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, nth")
def stream_sessions(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = sessions(e, "ts", "2 days", ["user_id"], "1 day", n="count(*)")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})



# -- demo loads, hooks, and what is left of the inventory


@query("SELECT 'star.customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'star.lineitem', count(*) FROM lineitem UNION ALL SELECT 'star.nation', count(*) FROM nation UNION ALL SELECT 'star.orders', count(*) FROM orders UNION ALL SELECT 'star.part', count(*) FROM part UNION ALL SELECT 'star.region', count(*) FROM region UNION ALL SELECT 'star.supplier', count(*) FROM supplier")
def demo_star(spark, d):
    w = World(spark)
    demo.install_star(w.loader, d)
    w.loader.run_chain("star")
    out = [(n, w.store.read(n).count()) for n in w.store.tables() if n.startswith("star.")]
    return spark.createDataFrame(out, "name string, n long")


@query("SELECT CAST(p * 20 + i AS BIGINT) AS id, 'page ' || p AS page FROM range(5) AS a(p), range(20) AS b(i)")
def demo_paged(spark, d):
    w = World(spark)
    demo.install_paged(w.loader)
    w.loader.run_group("demo", workers=1)
    return w.store.read("demo.paged")


@query("SELECT CAST(2000 AS BIGINT) AS n, CAST(2000 AS BIGINT) AS keys, TRUE AS dates_in_range, TRUE AS prices_in_range, TRUE AS same_again")
def demo_rows(spark, d):
    rows, again = demo.source(spark, 2000), demo.source(spark, 2000).repartition(7)
    near = F.max(F.datediff(F.lit(date(2024, 6, 1)), "date_column")) <= 90
    same = rows.exceptAll(again).isEmpty()
    return rows.agg(F.count("*").alias("n"), F.countDistinct("int_column").alias("keys"), near.alias("dates_in_range"), (F.max("decimal_column") <= 1000).alias("prices_in_range")).withColumn("same_again", F.lit(same))


@query("SELECT * FROM (VALUES ('chains.json'), ('changelog.yaml'), ('constants.json'), ('dependencies.json'), ('dictionaries/extraction.json'), ('dictionaries/load.json'), ('dictionaries/method.json'), ('dictionaries/mode.json'), ('dictionaries/status.json'), ('objects/1.json'), ('tables/demo.nation.sql')) AS v(file)")
def dump_files(spark, d):
    w = World(spark)
    w.table("demo.nation", t(spark, d, "nation"))
    w.registry.add(LoadSpec(1, "demo.nation"))
    made = catalog.dump(f"{w.root}/dump", w.store, w.registry, spark)
    return spark.createDataFrame([(n,) for n in made if not n.startswith(("tables/", "views/")) or n.startswith("tables/demo.")], "file string")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT CAST(-1 AS INTEGER), 'loaded by run ' || 1, CAST(25 AS INTEGER)")
def load_hooks(spark, d):
    """After the load a hook adds a row about it; then a load function does all by itself."""
    w, n = World(spark), t(spark, d, "nation")
    w.store.create("demo.nation", n.schema)

    def hook(context):
        row = [(-1, f"loaded by run {context.run.load_id}", context.run.row_cnt)]
        context.store.append("demo.nation", spark.createDataFrame(row, "n_nationkey int, n_name string, n_regionkey int"))
        return True

    w.functions.register("hook", hook)
    w.source(n, LoadSpec(1, "demo.nation", after_load="hook"))
    w.loader.load(1)
    return w.store.read("demo.nation")


@query("SELECT * FROM region WHERE r_regionkey < 3")
def load_python(spark, d):
    w, r = World(spark), t(spark, d, "region")
    w.store.create("demo.region", r.schema)
    w.functions.register("own", lambda c, top: c.store.replace("demo.region", r.where(f"r_regionkey < {top}")) is None)
    w.registry.add(LoadSpec(1, "demo.region", method="python", load_function="own(3)"))
    (run,) = w.loader.load(1)
    assert run.status is Status.SUCCESS
    return w.store.read("demo.region")


@query("SELECT * FROM nation WHERE n_nationkey < 5")
def load_with_retry(spark, d):
    """A chain's object that fails once is tried again."""
    w, n, tries = World(spark), t(spark, d, "nation"), []

    def rows(_):
        tries.append(1)
        if len(tries) == 1:
            raise OSError("away")
        return n.where("n_nationkey < 5")

    w.functions.register("rows", rows)
    w.store.create("demo.nation", n.schema)
    w.registry.add(LoadSpec(1, "demo.nation", load_function="rows"))
    w.registry.chains["c"] = Chain("c", "1")
    assert w.loader.run_chain("c").status is Status.SUCCESS and len(tries) == 2
    return w.store.read("demo.nation")


@query("SELECT CAST(1 AS BIGINT) AS load_id, TIMESTAMP '2024-01-01' AS extraction_from, TIMESTAMP '2024-02-01' AS extraction_to")
def open_window(spark, d):
    """Of the windows not begun, the earliest within the bounds."""
    w = World(spark)
    w.registry.add(ORDERS.but(mode="ITER", interval=Period.of(1, "month")))
    w.registry.plan(1, ts(2024, 1, 1), ts(2024, 4, 1))
    r = w.registry.open_run(1, ts(2024, 1, 1), ts(2024, 3, 1))
    return spark.createDataFrame([(r.load_id, r.extraction_from, r.extraction_to)], "load_id long, extraction_from timestamp_ntz, extraction_to timestamp_ntz")


@query("SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_by_key(spark, d):
    c = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return keep_by_query(t(spark, d, "orders"), c.unionByName(c), ["o_custkey"])


@query("SELECT n_regionkey FROM nation UNION SELECT r_regionkey FROM region")
def union_distinct(spark, d):
    return united([t(spark, d, "nation").select("n_regionkey"), t(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"))], distinct=True)
