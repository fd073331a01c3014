"""One query for each operator over the supplied tables, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names
from .functions.expressions import extent, extract_condition, load_condition, max_value, min_value, project, text_array
from .functions.variables import expand
from .operators import (
    Scd2, append, delete_by_query, drop_range, load_partitions, merge, refresh_columns, replace_all, scd2, swap_default,
    update_by_key, update_by_query, upsert, upsert_by_query,
)
from .operators import history, ranges
from .plans import chains, partitions
from .plans.periods import Period
from .plans.windows import cut_windows
from .sources import readers, sinks
from .spec import Extraction, Grouping, Load, LoadSpec, Method, Mode, SourceSpec, Status

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ts(*x: int) -> datetime:
    return datetime(*x)


# -- the flagship: a grouped transformation upserted into a table by month


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Orders summed by customer and month as staged rows, merged into the months they touch of an older state."""
    orders = t(spark, d, "orders")
    schema = spark.createDataFrame([], "o_custkey long, month timestamp_ntz, total decimal(18,2), orders long").schema
    how = dict(transforms={"month": "date_trunc('month', o_orderdate)", "total": "sum(cast(o_totalprice as decimal(18,2)))", "orders": "count(*)"}, grouping=Grouping(("o_custkey", "month")))
    old = project(orders.where(F.col("o_orderdate") < F.lit(ts(2001, 6, 15))), schema, **how)
    late = orders.where(F.col("o_orderdate") >= F.lit(ts(2001, 5, 1)))
    new = project(late, schema, **how)
    # the months are those of the rows that are summed, so nothing is summed to find them
    return ranges.whole(old, new, "month", keys=["o_custkey"], parts=ranges.touched(late, "o_orderdate", "month"))


_GROUPED = "SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total, count(*) AS orders FROM orders"
QUERIES["grouped_partition_merge"] = flagship
SQL["grouped_partition_merge"] = f"""
WITH old AS ({_GROUPED} WHERE o_orderdate < TIMESTAMP '2001-06-15' GROUP BY 1, 2), new AS ({_GROUPED} WHERE o_orderdate >= TIMESTAMP '2001-05-01' GROUP BY 1, 2)
SELECT * FROM new UNION ALL
SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.o_custkey IS NOT DISTINCT FROM old.o_custkey AND new.month = old.month)
"""


# -- extraction

ORDERS = LoadSpec(1, "demo.orders", Extraction.DELTA, Load.DELTA, ("o_orderkey",), "o_orderdate", "o_orderdate", Mode.DELTA)


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01' AND o_orderdate < TIMESTAMP '1998-09-01'")
def extract_window(spark, d):
    return t(spark, d, "orders").where(extract_condition(ORDERS, ts(1998, 3, 1), ts(1998, 9, 1)))


@query("SELECT o_orderkey AS order_id, o_custkey AS client, o_orderdate AS placed, CAST(upper(o_orderpriority) AS VARCHAR) AS priority FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'")
def extract_mapped(spark, d):
    spec = LoadSpec(2, "demo.mapped", "DELTA", "DELTA", delta_field="placed", source=SourceSpec(rename={"order_id": "o_orderkey", "client": "o_custkey", "placed": "o_orderdate"}))
    schema = spark.createDataFrame([], "order_id long, client long, placed timestamp_ntz, priority string").schema
    return project(t(spark, d, "orders"), schema, {"priority": "upper(o_orderpriority)"}, rename=spec.source.rename, where=extract_condition(spec, ts(1999, 1, 1), ts(2000, 1, 1)))


@query("SELECT event_type, CAST(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DECIMAL(18,4)) AS DOUBLE) AS total, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY event_type HAVING count(*) > 10")
def extract_grouped(spark, d):
    schema = spark.createDataFrame([], "event_type string, total double, n long, last_ts timestamp_ntz").schema
    return project(t(spark, d, "events"), schema, {"total": "cast(sum(cast(value as decimal(18,6))) as decimal(18,4))", "n": "count(*)", "last_ts": "max(ts)"}, Grouping(("event_type",), having="n > 10"))


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate < TIMESTAMP '2000-02-01' AND o_orderstatus = 'F'")
def extract_where_override(spark, d):
    spec = ORDERS.but(where="o_orderdate >= $extraction_from and o_orderdate < $extraction_to and o_orderstatus = 'F'")
    return t(spark, d, "orders").where(extract_condition(spec, None, None, {"extraction_from": ts(2000, 1, 1), "extraction_to": ts(2000, 2, 1)}))


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' AND o_orderdate < TIMESTAMP '2001-03-01'")
def extract_partition_window(spark, d):
    spec = ORDERS.but(extraction=Extraction.PARTITION, load=Load.PARTITION)
    return t(spark, d, "orders").where(extract_condition(spec, ts(2001, 1, 1), ts(2001, 3, 1)))


@query("SELECT count(*) AS n FROM orders")
def extract_full(spark, d):
    spec = LoadSpec(3, "demo.full")
    assert extract_condition(spec, ts(2001, 1, 1), ts(2001, 3, 1)) is None
    return t(spark, d, "orders").agg(F.count("*").alias("n"))


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2001-05-01' AND o_orderdate < TIMESTAMP '2001-06-01'")
def load_window(spark, d):
    return t(spark, d, "orders").alias("s").where(load_condition(ORDERS, ts(2001, 5, 1), ts(2001, 6, 1), alias="s"))


@query("SELECT 'orders from 1998-03-01 00:00:00 by run 7 of demo $unknown' AS message, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01'")
def variables(spark, d):
    v = {"load_from": ts(1998, 3, 1), "load_id": 7, "load": "wrong"}
    text = expand("orders from $load_from by run $load_id of demo $unknown", v)
    return t(spark, d, "orders").where(F.col("o_orderdate") >= F.lit(v["load_from"])).agg(F.lit(text).alias("message"), F.count("*").alias("n")).select("message", "n")


@query("SELECT CAST(max(ts) AS TIMESTAMP) AS watermark, count(*) AS n FROM events")
def watermark_max(spark, d):
    n, top = sinks.watermark(t(spark, d, "events"), "ts", ts(1990, 1, 1))
    return spark.createDataFrame([(top, n)], "watermark timestamp_ntz, n long")


@query("SELECT TIMESTAMP '1990-01-01' AS watermark, CAST(0 AS BIGINT) AS n")
def watermark_empty(spark, d):
    n, top = sinks.watermark(t(spark, d, "events").where("event_id < 0"), "ts", ts(1990, 1, 1))
    return spark.createDataFrame([(top, n)], "watermark timestamp_ntz, n long")


@query("SELECT CAST(min(o_orderkey) AS VARCHAR) AS lo, CAST(max(o_orderkey) AS VARCHAR) AS hi FROM orders WHERE o_orderstatus = 'F'")
def min_max_value(spark, d):
    o = t(spark, d, "orders")
    return spark.createDataFrame([(min_value(o, "o_orderkey", "o_orderstatus = 'F'"), max_value(o, "o_orderkey", "o_orderstatus = 'F'"))], "lo string, hi string")


@query("SELECT event_id, props::JSON ->> 'k' AS k, props FROM events")
def json_mapping(spark, d):
    schema = spark.createDataFrame([], "event_id long, k string, props string").schema
    return project(t(spark, d, "events"), schema, {"k": "get_json_object(props, '$.k')"})


@query("SELECT event_id, event_type || '|' || CAST(user_id AS VARCHAR) AS joined, CAST(2 AS INTEGER) AS n FROM events")
def array_cast(spark, d):
    literal = F.concat(F.lit("{"), F.col("event_type"), F.lit(","), F.col("user_id").cast("string"), F.lit("}"))
    items = text_array(literal)
    return t(spark, d, "events").select("event_id", F.array_join(items, "|").alias("joined"), F.size(items).alias("n"))


# -- full and append

_OLD = "SELECT * FROM customer WHERE c_custkey % 3 <> 0"


@query("SELECT * FROM customer WHERE c_custkey % 3 = 0")
def full_replace(spark, d):
    c = t(spark, d, "customer")
    return replace_all(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 3 = 0"))


@query(_OLD)
def full_empty_guard(spark, d):
    c = t(spark, d, "customer")
    return replace_all(c.where("c_custkey % 3 <> 0"), c.where("false"))


@query("SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' UNION ALL SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-12-01' AND o_orderdate < TIMESTAMP '2000-01-01'")
def append_delta(spark, d):
    o = t(spark, d, "orders")
    old = o.where(F.col("o_orderdate") < F.lit(ts(1999, 1, 1)))
    return old.unionByName(append(old, o, extract_condition(ORDERS, ts(1998, 12, 1), ts(2000, 1, 1))))


@query("SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'")
def append_new_keys(spark, d):
    o = t(spark, d, "orders")
    old = o.where(F.col("o_orderdate") < F.lit(ts(1999, 1, 1)))
    return old.unionByName(append(old, o, extract_condition(ORDERS, ts(1998, 12, 1), ts(2000, 1, 1)), ["o_orderkey"]))


# -- merge and upsert

_KEY = ["l_orderkey", "l_linenumber"]
_TRG = "SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-08-01' AND l_shipdate < TIMESTAMP '2001-10-15'"
_SRC = "SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-01'"


def _lines(spark, d):
    x = t(spark, d, "lineitem")
    c = F.col("l_shipdate")
    return x.where((c >= F.lit(ts(2001, 8, 1))) & (c < F.lit(ts(2001, 10, 15)))), x.where(c >= F.lit(ts(2001, 10, 1)))


@query(f"WITH trg AS ({_TRG}), src AS ({_SRC}), u AS (SELECT *, 1 AS prio FROM src UNION ALL SELECT *, 2 FROM trg) SELECT * EXCLUDE (prio, r) FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY prio) AS r FROM u) WHERE r = 1")
def merge_keep(spark, d):
    return merge(*_lines(spark, d), _KEY)


_ALL_DOWN = "l_orderkey DESC NULLS FIRST, l_partkey DESC NULLS FIRST, l_suppkey DESC NULLS FIRST, l_linenumber DESC NULLS FIRST, l_quantity DESC NULLS FIRST, l_extendedprice DESC NULLS FIRST, l_discount DESC NULLS FIRST, l_tax DESC NULLS FIRST, l_returnflag DESC NULLS FIRST, l_linestatus DESC NULLS FIRST"


@query(f"WITH trg AS ({_TRG}), src AS ({_SRC}), u AS (SELECT *, 1 AS prio FROM src UNION ALL SELECT *, 2 FROM trg) SELECT * EXCLUDE (prio, r) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY prio, l_shipdate DESC NULLS FIRST, {_ALL_DOWN}) AS r FROM u) WHERE r = 1")
def merge_drop(spark, d):
    return merge(*_lines(spark, d), _KEY, "drop", "l_shipdate")


@query("WITH src AS (SELECT * REPLACE (o_totalprice + 1 AS o_totalprice) FROM orders WHERE o_orderkey % 5 = 0), trg AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) SELECT * FROM src UNION ALL SELECT * FROM trg WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src)")
def delta_merge_whole(spark, d):
    o = t(spark, d, "orders")
    return merge(o.where("o_orderkey % 7 <> 0"), o.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), ["o_orderkey"])


_EV = "SELECT user_id, event_type, ts, value FROM events WHERE event_id % {n} = 0"


def _events(spark, d):
    e = t(spark, d, "events")
    return (e.where(f"event_id % {n} = 0").select("user_id", "event_type", "ts", "value") for n in (2, 3))


@query(f"WITH trg AS ({_EV.format(n=2)}), src AS ({_EV.format(n=3)}) SELECT * FROM src UNION ALL SELECT * FROM trg WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.user_id = trg.user_id AND src.event_type = trg.event_type)")
def upsert_all(spark, d):
    return upsert(*_events(spark, d), ["user_id", "event_type"])


@query(f"WITH trg AS ({_EV.format(n=2)}), src AS ({_EV.format(n=3)}), one AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS FIRST, value DESC NULLS FIRST) AS r FROM src) WHERE r = 1) SELECT * FROM one UNION ALL SELECT * FROM trg WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.user_id = trg.user_id AND src.event_type = trg.event_type)")
def upsert_dedup(spark, d):
    return upsert(*_events(spark, d), ["user_id", "event_type"], dedup=True, delta="ts")


_NULLS = "SELECT nullif(user_id, 5) AS user_id, nullif(event_type, 'click') AS event_type, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS ts, value FROM events WHERE event_id % {n} = 0"


@query(f"WITH trg AS ({_NULLS.format(n=2)}), src AS ({_NULLS.format(n=3)}), one AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS FIRST, value DESC NULLS FIRST) AS r FROM src) WHERE r = 1) SELECT * FROM one UNION ALL SELECT * FROM trg WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.user_id IS NOT DISTINCT FROM trg.user_id AND src.event_type IS NOT DISTINCT FROM trg.event_type)")
def upsert_null_key(spark, d):
    e = t(spark, d, "events")
    with_nulls = e.select("event_id", F.expr("nullif(user_id, 5)").alias("user_id"), F.expr("nullif(event_type, 'click')").alias("event_type"), F.expr("case when event_id % 11 = 0 then null else ts end").alias("ts"), "value")
    trg, src = (with_nulls.where(f"event_id % {n} = 0").drop("event_id") for n in (2, 3))
    return upsert(trg, src, ["user_id", "event_type"], dedup=True, delta="ts")


@query("WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT * FROM gone)")
def delete_by_key(spark, d):
    o = t(spark, d, "orders")
    return delete_by_query(o, o.where("o_orderstatus = 'F'"), ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def upsert_by_select(spark, d):
    o = t(spark, d, "orders")
    o.createOrReplaceTempView("contract_orders")
    new = spark.sql("SELECT o_orderpriority, o_orderdate, o_totalprice, 'X' AS o_orderstatus, o_custkey, o_orderkey FROM contract_orders WHERE o_orderkey % 4 = 0")
    return upsert_by_query(o, new, ["o_orderkey"])


# -- updates


@query("SELECT o.o_orderkey, o.o_custkey + CASE WHEN o.o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS o_custkey, CASE WHEN o.o_orderkey % 3 = 0 THEN 'U' ELSE o.o_orderstatus END AS o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority FROM orders o")
def update_columns_by_key(spark, d):
    o = t(spark, d, "orders")
    src = o.where("o_orderkey % 3 = 0").withColumns({"o_custkey": F.col("o_custkey") + 1, "o_orderstatus": F.lit("U"), "o_orderdate": F.lit(ts(1970, 1, 1))})
    return update_by_key(o, src, ["o_orderkey"], "o_orderdate", "o_orderdate")


@query("SELECT e.event_id, nullif(e.user_id, 3) AS user_id, coalesce(s.value, e.value) AS value FROM events e LEFT JOIN (SELECT user_id, max(value) AS value FROM events WHERE user_id % 2 = 1 AND user_id <> 3 GROUP BY user_id) s ON nullif(e.user_id, 3) = s.user_id")
def update_null_key(spark, d):
    e = t(spark, d, "events").select("event_id", F.expr("nullif(user_id, 3)").alias("user_id"), "value")
    src = t(spark, d, "events").where("user_id % 2 = 1").select(F.expr("nullif(user_id, 3)").alias("user_id"), "value", F.col("value").alias("v"))
    return update_by_query(e, src, ["user_id"], ["value"], delta="v")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders")
def column_refresh(spark, d):
    o = t(spark, d, "orders")
    src = o.where("o_orderkey % 6 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"))
    new = refresh_columns(o, src, ["o_orderkey"], ["o_totalprice"])
    return ranges.whole(o, new, "o_orderdate", keys=["o_orderkey"])


# -- partitions

_M = "date_trunc('month', o_orderdate)"
_OLD_O = "SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2001-06-01'"
_NEW_O = "SELECT * REPLACE (o_totalprice + 1 AS o_totalprice) FROM orders WHERE o_orderdate >= TIMESTAMP '2001-05-15'"


def _months(spark, d):
    o = t(spark, d, "orders")
    c = F.col("o_orderdate")
    return o.where(c < F.lit(ts(2001, 6, 1))), o.where(c >= F.lit(ts(2001, 5, 15))).withColumn("o_totalprice", F.col("o_totalprice") + 1)


@query(f"WITH trg AS ({_OLD_O}), src AS ({_NEW_O}) SELECT * FROM src UNION ALL SELECT * FROM trg WHERE {_M} NOT IN (SELECT {_M} FROM src)")
def partition_replace(spark, d):
    old, new = _months(spark, d)
    return ranges.whole(old, new, "o_orderdate")


@query(f"WITH trg AS ({_OLD_O}), src AS ({_NEW_O}) SELECT * FROM src UNION ALL SELECT * FROM trg WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.o_orderkey = trg.o_orderkey AND date_trunc('month', src.o_orderdate) = date_trunc('month', trg.o_orderdate))")
def partition_merge(spark, d):
    old, new = _months(spark, d)
    return ranges.whole(old, new, "o_orderdate", keys=["o_orderkey"])


@query(f"WITH src AS (SELECT * REPLACE (o_orderdate + INTERVAL 1 MONTH AS o_orderdate) FROM orders WHERE o_orderkey % 10 = 0 AND o_orderdate < TIMESTAMP '2001-01-01') SELECT * FROM src UNION ALL SELECT * FROM orders")
def partition_moved_key(spark, d):
    o = t(spark, d, "orders")
    moved = o.where((F.col("o_orderkey") % 10 == 0) & (F.col("o_orderdate") < F.lit(ts(2001, 1, 1)))).withColumn("o_orderdate", F.expr("o_orderdate + interval 1 month"))
    return ranges.whole(o, moved, "o_orderdate", keys=["o_orderkey"])


@query("WITH src AS (SELECT * REPLACE (o_orderdate + INTERVAL 1 MONTH AS o_orderdate) FROM orders WHERE o_orderkey % 10 = 0 AND o_orderdate < TIMESTAMP '2001-01-01') SELECT * FROM src UNION ALL SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src)")
def partition_global_key(spark, d):
    o = t(spark, d, "orders")
    moved = o.where((F.col("o_orderkey") % 10 == 0) & (F.col("o_orderdate") < F.lit(ts(2001, 1, 1)))).withColumn("o_orderdate", F.expr("o_orderdate + interval 1 month"))
    return load_partitions(o, moved, "o_orderdate", "month", ["o_orderkey"], global_key=True)


_ODD = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN TIMESTAMP '1980-05-05' ELSE o_orderdate END AS o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 100 < 3"


@query(f"WITH src AS ({_ODD}) SELECT * FROM src WHERE o_orderdate >= TIMESTAMP '1995-01-01'")
def partition_out_of_range(spark, d):
    o = t(spark, d, "orders")
    odd = o.where("o_orderkey % 100 < 3").withColumn("o_orderdate", F.when(F.col("o_orderkey") % 3 == 0, None).when(F.col("o_orderkey") % 3 == 1, F.lit(ts(1980, 5, 5))).otherwise(F.col("o_orderdate")))
    return load_partitions(o, odd, "o_orderdate", out_of_range="skip", first=ts(1995, 1, 1))


@query(f"WITH src AS ({_ODD}) SELECT coalesce(strftime(date_trunc('month', o_orderdate), '%Y-%m-%d'), 'default') AS part, count(*) AS n FROM src GROUP BY 1")
def partition_default(spark, d):
    o = t(spark, d, "orders")
    odd = o.where("o_orderkey % 100 < 3").withColumn("o_orderdate", F.when(F.col("o_orderkey") % 3 == 0, None).when(F.col("o_orderkey") % 3 == 1, F.lit(ts(1980, 5, 5))).otherwise(F.col("o_orderdate")))
    return load_partitions(o, odd, "o_orderdate").groupBy(partitions.key("o_orderdate", "month").alias("part")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_orderkey, l_linenumber, date_trunc('month', l_shipdate) AS month FROM lineitem")
def partition_distinct_slice(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month"))
    return load_partitions(x, x.unionByName(x), "month", distinct=True)


@query(f"SELECT * FROM orders WHERE {_M} >= TIMESTAMP '1996-01-01' UNION ALL SELECT * REPLACE (TIMESTAMP '1990-01-01' AS o_orderdate) FROM orders WHERE o_orderkey % 50 = 0")
def default_swap(spark, d):
    o = t(spark, d, "orders")
    months = [f"{y}-{m:02d}-01" for y in range(1996, 2003) for m in range(1, 13)]
    return swap_default(o, o.where("o_orderkey % 50 = 0").withColumn("o_orderdate", F.lit(ts(1990, 1, 1))), "o_orderdate", "month", months)


@query("SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-02-01' OR o_orderdate >= TIMESTAMP '1997-06-01'")
def partition_drop_range(spark, d):
    return drop_range(t(spark, d, "orders"), "o_orderdate", ts(1997, 2, 11), ts(1997, 5, 2))


def _parts(spark, rows):
    return spark.createDataFrame([(p.name, p.start, p.end) for p in rows], "name string, start_at timestamp_ntz, end_at timestamp_ntz")


_SERIES = "SELECT {name} AS name, CAST(s AS TIMESTAMP) AS start_at, CAST(s + INTERVAL {step} AS TIMESTAMP) AS end_at FROM generate_series({lo}, {hi}, INTERVAL {step}) AS g(s)"


@query(_SERIES.format(name="'m_' || strftime(s, '%m_%Y')", step="1 MONTH", lo="TIMESTAMP '2024-03-01'", hi="TIMESTAMP '2024-07-01'"))
def partition_calendar_month(spark, d):
    have = [partitions.of_value(ts(2024, m, 1), "month") for m in (1, 2)] + [partitions.Partition(ts(2999, 1, 1), ts(2999, 2, 1))]
    return _parts(spark, partitions.extend(have, ts(2024, 7, 3), ts(2999, 1, 1)))


@query(_SERIES.format(name="'d_' || strftime(s, '%d_%m_%Y')", step="1 DAY", lo="TIMESTAMP '2024-02-28'", hi="TIMESTAMP '2024-03-02'"))
def partition_calendar_day(spark, d):
    have = [partitions.of_value(ts(2024, 1, 1), "month"), partitions.of_value(ts(2024, 2, 27), "day")]
    return _parts(spark, partitions.extend(have, ts(2024, 3, 2, 5)))


@query(_SERIES.format(name="'q_' || quarter(s) || '_' || year(s)", step="3 MONTH", lo="TIMESTAMP '2024-07-01'", hi="TIMESTAMP '2025-04-01'"))
def partition_calendar_quarter(spark, d):
    have = [partitions.of_value(ts(2024, m, 1), "quarter") for m in (1, 4)]
    return _parts(spark, partitions.extend(have, ts(2025, 5, 3)))


@query(_SERIES.format(name="'y_' || year(s)", step="1 YEAR", lo="TIMESTAMP '2022-01-01'", hi="TIMESTAMP '2024-01-01'"))
def partition_calendar_year(spark, d):
    have = [partitions.of_value(ts(y, 1, 1), "year") for y in (2020, 2021)]
    return _parts(spark, partitions.extend(have, ts(2024, 1, 1)))


@query("SELECT 'm_' || strftime(m, '%m_%Y') AS name, CAST(m AS TIMESTAMP) AS start_at, CAST(m + INTERVAL 1 MONTH AS TIMESTAMP) AS end_at FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders) WHERE m <= TIMESTAMP '1997-05-02' AND m + INTERVAL 1 MONTH > TIMESTAMP '1997-02-28 23:59:59'")
def partition_overlap(spark, d):
    all_ = [partitions.of_value(datetime.fromisoformat(p), "month") for p in ranges.touched(t(spark, d, "orders"), "o_orderdate", "month")]
    return _parts(spark, partitions.overlapping(all_, ts(1997, 2, 28, 23, 59, 59), ts(1997, 5, 2)))


@query("SELECT 'm_' || strftime(m, '%m_%Y') AS name, CAST(m AS TIMESTAMP) AS start_at, CAST(m + INTERVAL 1 MONTH AS TIMESTAMP) AS end_at FROM (SELECT date_trunc('month', max(o_orderdate)) AS m FROM orders)")
def partition_by_value(spark, d):
    o = t(spark, d, "orders")
    _, found = extent(o, "o_orderdate")
    all_ = [partitions.of_value(datetime.fromisoformat(p), "month") for p in ranges.touched(o, "o_orderdate", "month")]
    return _parts(spark, [partitions.by_value(all_, found["o_orderdate"][1])])


# -- history

AS_OF = date(2024, 6, 1)
_HIST = "SELECT *, DATE '2024-01-01' AS date_from, DATE '2999-01-01' AS date_to FROM customer WHERE c_custkey % 13 <> 0"
_SNAP = "SELECT * REPLACE (c_acctbal + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS c_acctbal) FROM customer WHERE c_custkey % 17 <> 0"
_CTE = f"WITH c AS ({_HIST}), s AS ({_SNAP}), changed AS (SELECT s.* FROM s JOIN c USING (c_custkey) WHERE s.c_name IS DISTINCT FROM c.c_name OR s.c_nationkey IS DISTINCT FROM c.c_nationkey OR s.c_acctbal IS DISTINCT FROM c.c_acctbal OR s.c_mktsegment IS DISTINCT FROM c.c_mktsegment), new AS (SELECT s.* FROM s ANTI JOIN c USING (c_custkey)), deleted AS (SELECT * REPLACE (DATE '2024-05-31' AS date_to) FROM c ANTI JOIN s USING (c_custkey)), history AS (SELECT * REPLACE (DATE '2024-05-31' AS date_to) FROM c WHERE c_custkey IN (SELECT c_custkey FROM changed) UNION ALL SELECT * FROM deleted), opened AS (SELECT *, DATE '2024-06-01' AS date_from, DATE '2999-01-01' AS date_to FROM (SELECT * FROM changed UNION ALL SELECT * FROM new)), actual AS (SELECT * FROM opened UNION ALL SELECT c.* FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM changed) AND c_custkey NOT IN (SELECT c_custkey FROM deleted)) "


def _history(spark, d, start=date(2024, 1, 1)):
    c = t(spark, d, "customer")
    trg = c.where("c_custkey % 13 <> 0").withColumns({"date_from": F.lit(start), "date_to": F.lit(history.FAR)})
    src = c.where("c_custkey % 17 <> 0").withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(0))
    return trg, src


HOW = Scd2(["c_custkey"], AS_OF)


@query(_CTE + "SELECT *, DATE '2024-06-01' AS date_from, DATE '2999-01-01' AS date_to FROM changed")
def scd2_changed(spark, d):
    return history.part(*_history(spark, d), HOW, "changed")


@query(_CTE + "SELECT * FROM deleted")
def scd2_deleted(spark, d):
    return history.part(*_history(spark, d), HOW, "deleted")


@query(_CTE + "SELECT *, DATE '2024-06-01' AS date_from, DATE '2999-01-01' AS date_to FROM new")
def scd2_new(spark, d):
    return history.part(*_history(spark, d), HOW, "new")


@query(_CTE + "SELECT * FROM history")
def scd2_history(spark, d):
    return history.part(*_history(spark, d), HOW, "history")


@query(_CTE + "SELECT * FROM actual")
def scd2_actual(spark, d):
    return history.part(*_history(spark, d), HOW, "actual")


@query(_CTE + "SELECT * FROM actual UNION ALL SELECT * FROM history")
def scd2_full(spark, d):
    return scd2(*_history(spark, d), HOW)


@query(_CTE.replace("DATE '2024-01-01' AS date_from", "DATE '2024-06-01' AS date_from") + "SELECT * FROM actual")
def scd2_same_day(spark, d):
    return scd2(*_history(spark, d, AS_OF), HOW)


@query(f"WITH c AS ({_HIST}), s AS ({_SNAP}) SELECT * FROM c SEMI JOIN s USING (c_custkey) UNION ALL SELECT *, DATE '2024-06-01', DATE '2999-01-01' FROM s ANTI JOIN c USING (c_custkey) UNION ALL SELECT * REPLACE (DATE '2024-05-31' AS date_to) FROM c ANTI JOIN s USING (c_custkey)")
def scd2_ignore_attrs(spark, d):
    return scd2(*_history(spark, d), Scd2(["c_custkey"], AS_OF, ignore=["c_acctbal"]))


@query(_CTE + "SELECT * FROM actual UNION ALL SELECT * FROM history WHERE c_custkey IN (SELECT c_custkey FROM changed) UNION ALL SELECT * FROM c ANTI JOIN s USING (c_custkey)")
def scd2_no_delete(spark, d):
    return scd2(*_history(spark, d), Scd2(["c_custkey"], AS_OF, detect_deleted=False))


# -- planning


def _windows(spark, *args, **kw):
    return spark.createDataFrame([(k, w.start, w.end) for k, w in enumerate(cut_windows(*args, **kw))], "nth long, start_at timestamp_ntz, end_at timestamp_ntz")


_W = "SELECT CAST(row_number() OVER (ORDER BY s) - 1 AS BIGINT) AS nth, CAST(s AS TIMESTAMP) AS start_at, CAST(s + INTERVAL {step} AS TIMESTAMP) AS end_at FROM generate_series(TIMESTAMP '{lo}', TIMESTAMP '{hi}', INTERVAL {step}) AS g(s)"
_ONE = "SELECT CAST(0 AS BIGINT) AS nth, TIMESTAMP '{lo}' AS start_at, TIMESTAMP '{hi}' AS end_at"
START, END = ts(2024, 1, 15, 6, 30), ts(2024, 3, 10, 9)


@query(_W.format(step="1 MONTH", lo="2024-01-01", hi="2024-03-01"))
def load_windows_month(spark, d):
    return _windows(spark, Mode.ITER, START, END, Period.of(1, "month"))


@query(_W.format(step="1 DAY", lo="2024-01-01", hi="2024-01-03"))
def load_windows_day(spark, d):
    return _windows(spark, Mode.ITER, ts(2024, 1, 1, 6), ts(2024, 1, 4, 9), Period.of(1, "day"))


@query(_W.format(step="2 DAY", lo="2024-01-01", hi="2024-01-03"))
def load_windows_two_days(spark, d):
    return _windows(spark, Mode.ITER, ts(2024, 1, 1, 6), ts(2024, 1, 4, 9), Period.of(2, "day"))


@query(_W.format(step="1 HOUR", lo="2024-01-01 06:00:00", hi="2024-01-01 08:00:00"))
def load_windows_hour(spark, d):
    return _windows(spark, Mode.ITER, ts(2024, 1, 1, 6, 30), ts(2024, 1, 1, 8, 10), Period.of(1, "hour"))


@query(_W.format(step="1 YEAR", lo="2022-01-01", hi="2023-01-01"))
def load_windows_year(spark, d):
    return _windows(spark, Mode.ITER, ts(2022, 5, 1), ts(2023, 7, 1), Period.of(1, "year"))


@query(_ONE.format(lo="2024-01-15 06:30:00", hi="2024-03-10 09:00:00"))
def load_windows_full(spark, d):
    return _windows(spark, Mode.FULL, START, END)


@query(_ONE.format(lo="2023-12-30", hi="2024-04-01"))
def load_windows_safety(spark, d):
    return _windows(spark, Mode.DELTA, START, END, Period.of(1, "month"), Period.of(2, "days"))


@query("WITH specs(object_id, object_name, load_group) AS (VALUES (1, 'a', 'g'), (2, 'b', 'g'), (3, 'c', 'h')), runs(object_id, load_id, status) AS (VALUES (1, 10, 3), (1, 11, -1), (3, 12, 1)), words(status, status_name) AS (VALUES (-1, 'ERROR'), (1, 'NEW'), (2, 'IN_PROCESS'), (3, 'SUCCESS')) SELECT CAST(s.object_id AS BIGINT) AS object_id, s.object_name, s.load_group, CAST(r.load_id AS BIGINT) AS load_id, w.status_name FROM specs s LEFT JOIN runs r ON s.object_id = r.object_id LEFT JOIN words w ON r.status = w.status")
def load_status_view(spark, d):
    from .files import shared
    from .loader import Loader
    from .registry import Registry, Run
    from .store import TableStore

    reg = Registry(shared(spark, "status"), lambda: ts(2024, 6, 1, 12), spark)
    for i, name, group in ((1, "a", "g"), (2, "b", "g"), (3, "c", "h"), (4, "d", None)):
        reg.add(LoadSpec(i, name, group=group))
    reg.add(LoadSpec(5, "off", group="g", active=False))
    for load_id, obj, status, day in ((10, 1, Status.SUCCESS, 1), (11, 1, Status.ERROR, 1), (12, 3, Status.NEW, 1), (13, 2, Status.NEW, 2)):
        reg._write("runs", load_id, Run(load_id, obj, status, created=ts(2024, 6, day)))
    return Loader(spark, TableStore(spark, shared(spark, "status")), reg).status().select("object_id", "object_name", "load_group", "load_id", "status_name")


_EDGES = [(2, 1), (3, 1), (4, 2), (4, 3), (4, 9)]


@query("WITH e(object_id, object_id_depend) AS (VALUES (2, 1), (3, 1), (4, 2), (4, 3), (4, 9)), active(id) AS (VALUES (1), (2), (3), (4), (5)) SELECT CAST(object_id AS BIGINT) AS object_id, CAST(object_id_depend AS BIGINT) AS depends_on FROM e WHERE object_id IN (SELECT id FROM active) AND object_id_depend IN (SELECT id FROM active)")
def dependency_edges(spark, d):
    _, before = chains.order([1, 2, 3, 4, 5], _EDGES, range(1, 10))
    return spark.createDataFrame([(o, p) for o, ps in sorted(before.items()) for p in sorted(ps)], "object_id long, depends_on long")


@query("SELECT * FROM (VALUES ('[[1], [2, 3], [4]]', CAST(4 AS BIGINT)), ('[[[[1], [2]], 3]]', CAST(3 AS BIGINT))) AS v(steps, objects)")
def chain_steps(spark, d):
    trees = [chains.parse("1>>[2,3]>>4"), chains.parse("[1>>2,3]")]
    return spark.createDataFrame([(str(chains.nested(x)), len(chains.objects(x))) for x in trees], "steps string, objects long")


# -- sources and sinks


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-07-01'")
def range_split_read(spark, d):
    return readers.split_reads(t(spark, d, "orders"), readers.ranges(ORDERS, ts(1998, 1, 1), ts(1998, 7, 1)))


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-01-11'")
def enum_split_read(spark, d):
    o = t(spark, d, "orders")
    days = partitions.enumerate_days("cast(o_orderdate as date)", "%Y-%m-%d", ts(1998, 1, 1), ts(1998, 1, 10))
    return readers.split_reads(o, days)


@query("SELECT CAST(p * 100 + i AS BIGINT) AS id, 'page ' || p AS page FROM range(5) AS a(p), range(20) AS b(i)")
def paged_read(spark, d):
    spark.dataSource.register(readers.paged("contract_pages", "id long, page string", lambda p: [(p * 100 + i, f"page {p}") for i in range(20)], 5))
    return spark.read.format("contract_pages").load()


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' AND o_orderdate < TIMESTAMP '2001-08-01'")
def export_full(spark, d):
    spec = ORDERS.but(load=Load.FULL, method=Method.EXPORT)
    rows = sinks.exported(t(spark, d, "orders"), spec, ts(2001, 1, 1), ts(2001, 8, 1))
    return sinks.published(t(spark, d, "orders").where("false"), rows, spec)


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 0 OR (o_orderdate >= TIMESTAMP '2001-01-01')")
def export_upsert(spark, d):
    spec = ORDERS.but(load=Load.DELTA_UPSERT, method=Method.EXPORT)
    o = t(spark, d, "orders")
    return sinks.published(o.where("o_orderkey % 2 = 0"), sinks.exported(o, spec, ts(2001, 1, 1), ts(2999, 1, 1)), spec)


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2001-05-15' OR (o_orderkey % 2 = 0 AND o_orderdate >= TIMESTAMP '2001-05-01')")
def export_partition(spark, d):
    spec = ORDERS.but(load=Load.UPDATE_PARTITION, method=Method.EXPORT)
    o = t(spark, d, "orders")
    return sinks.published(o.where("o_orderkey % 2 = 0"), sinks.exported(o, spec, ts(2001, 5, 15), ts(2999, 1, 1)), spec)


@query("SELECT o_orderkey, lower(trim(translate(' O''' || o_orderpriority || ';/ ', ';/''', ''), ' ')) AS name FROM orders")
def unified_names(spark, d):
    c = F.concat(F.lit(" O'"), F.col("o_orderpriority"), F.lit(";/ "))
    return t(spark, d, "orders").select("o_orderkey", names.unify_column(c).alias("name"))


@query("SELECT TIMESTAMP '2024-01-01' + INTERVAL (n) DAY AS day, CAST(n AS BIGINT) AS n FROM range(10) AS r(n)")
def series(spark, d):
    days = F.sequence(F.lit(ts(2024, 1, 1)), F.lit(ts(2024, 1, 1) + timedelta(days=9)), F.expr("interval 1 day"))
    return spark.range(1).select(F.posexplode(days).alias("k", "day")).select("day", F.col("k").cast("long").alias("n"))


# -- streams


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS window_start, CAST(time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS TIMESTAMP) AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    from .streaming import tumbling

    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = tumbling(e, "ts", "1 day", ["event_type"], "1 day", n="count(*)")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n")


@query("SELECT * FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def stream_upsert(spark, d):
    from .files import shared
    from .store import TableStore
    from .streaming import load_stream

    e = t(spark, d, "events")
    root = shared(spark, "stream")
    store = TableStore(spark, f"{root}/store")
    spec = LoadSpec(9, "demo.events", "DELTA", "DELTA_UPSERT", ("event_id",), "ts")
    store.create(spec.name, e.schema)
    store.replace(spec.name, e.where("event_id % 2 = 0"))
    e.where("event_id % 3 = 0").repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    load_stream(stream, store, spec, f"{root}/checkpoint").awaitTermination()
    return store.read(spec.name)
