from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemill.operators import Scd2, append, delete_by_query, load_partitions, merge, refresh_columns, replace_all, scd2, update_by_key, update_by_query, upsert
from tidemill.operators import ranges
from tidemill.operators.common import in_order
from tidemill.operators.history import FAR, part


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def kv(spark):
    return lambda *r: spark.createDataFrame(list(r), "k long, v string")


def test_merge_keep_and_drop(kv):
    trg = kv((1, "a"), (1, "b"), (2, "c"), (2, "c"), (None, "n"), (4, "z"), (4, "y"))
    src = kv((1, "x"), (1, "y"), (None, "m"), (3, "w"))
    assert rows(merge(trg, src, ["k"])) == Counter([(1, "x"), (1, "y"), (None, "m"), (3, "w"), (2, "c"), (2, "c"), (4, "z"), (4, "y")])
    assert rows(merge(trg, src, ["k"], "drop")) == Counter([(1, "y"), (None, "m"), (3, "w"), (2, "c"), (4, "z")])
    assert rows(merge(trg, src, ["k"], where="k = 3")) == rows(trg) + Counter([(3, "w")])
    assert rows(merge(trg, src.where("false"), ["k"])) == rows(trg)
    with pytest.raises(ValueError):
        merge(trg, src, [])
    with pytest.raises(ValueError):
        merge(trg, src, ["k"], "some")


def test_merge_keep_is_rank_over_a_union(spark, kv):
    trg = kv(*[(k % 7 or None, f"t{k % 3}") for k in range(40)])
    src = kv(*[(k % 11 or None, f"s{k % 2}") for k in range(20)])
    trg.createOrReplaceTempView("mk_t")
    src.createOrReplaceTempView("mk_s")
    want = spark.sql("select k, v from (select *, rank() over (partition by k order by p) r from (select *, 1 p from mk_s union all select *, 2 p from mk_t)) where r = 1")
    assert rows(merge(trg, src, ["k"])) == rows(want)


def test_columns_go_by_name_and_missing_ones_raise(spark, kv):
    src = spark.createDataFrame([("b", 2)], "v string, k int")
    assert rows(append(kv((1, "a")), src)) == Counter([(2, "b")])
    with pytest.raises(ValueError, match="v"):
        in_order(src.drop("v"), kv((1, "a")))


def test_append_and_replace(kv):
    trg, src = kv((1, "a"), (None, "b")), kv((1, "x"), (None, "y"), (2, "z"))
    assert rows(append(trg, src)) == rows(src)
    assert rows(append(trg, src, new_keys_only=["k"])) == Counter([(2, "z")])
    assert rows(replace_all(trg, src)) == rows(src)
    assert rows(replace_all(trg, src.where("false"))) == rows(trg)


def test_upsert_takes_null_delta_for_the_greatest(spark):
    s = "k long, t timestamp_ntz, v string"
    d = datetime
    trg = spark.createDataFrame([(1, d(2024, 1, 1), "old"), (2, d(2024, 1, 1), "two")], s)
    src = spark.createDataFrame([(1, d(2024, 1, 2), "a"), (1, None, "b"), (1, d(2024, 1, 3), "c")], s)
    one = lambda **kw: {r.v for r in upsert(trg, src, ["k"], dedup=True, delta="t", **kw).collect()}
    assert one() == {"b", "two"} and one(nulls_last=True) == {"c", "two"}
    twice = upsert(upsert(trg, src, ["k"], True, "t"), src, ["k"], True, "t")
    assert rows(twice) == rows(upsert(trg, src, ["k"], True, "t"))


def test_ties_do_not_depend_on_the_order_of_rows(kv):
    src = [(1, x) for x in "bdac"]
    assert {tuple(rows(merge(kv((1, "t")), kv(*p), ["k"], "drop"))) for p in (src, src[::-1])} == {((1, "d"),)}


def test_update_leaves_null_keys_and_fixed_columns(spark):
    s = "k long, t timestamp_ntz, a string, b string"
    old, new = datetime(2024, 1, 1), datetime(2024, 2, 2)
    trg = spark.createDataFrame([(1, old, "a", "b"), (None, old, "a", "b"), (3, old, "a", "b")], s)
    src = spark.createDataFrame([(1, new, "x", None), (None, new, "x", "x"), (3, old, "y", "y"), (3, new, "z", "z")], s)
    assert rows(update_by_key(trg, src, ["k"], "t", None)) == Counter([(1, old, "x", None), (None, old, "a", "b"), (3, old, "z", "z")])
    assert rows(update_by_query(trg, src, ["k"], ["a"], "t")) == Counter([(1, old, "x", "b"), (None, old, "a", "b"), (3, old, "z", "b")])
    assert rows(refresh_columns(trg, src.where("k = 1"), ["k"], ["a"])) == Counter([(1, old, "x", "b")])
    assert rows(delete_by_query(trg, src.where("k is null"), ["k"])) == rows(trg.where("k is not null"))
    with pytest.raises(ValueError):
        update_by_query(trg, src, ["k"], ["k"])


def test_strategies_take_source_and_target_from_one_frame(kv):
    x = kv((1, "a"), (2, "b"), (3, "c"))
    assert rows(merge(x, x.where("k = 2"), ["k"])) == rows(x)
    assert rows(upsert(x, x.where("k = 2").withColumn("v", F.lit("z")), ["k"])) == Counter([(1, "a"), (2, "z"), (3, "c")])
    assert rows(update_by_key(x, x.where("k = 2").withColumn("v", F.lit("z")), ["k"])) == Counter([(1, "a"), (2, "z"), (3, "c")])


@pytest.fixture
def dated(spark):
    return lambda *r: spark.createDataFrame([(k, datetime.fromisoformat(t) if t else None, v) for k, t, v in r], "k long, t timestamp_ntz, v string")


def test_partition_loads(dated):
    trg = dated((1, "2024-01-05", "a"), (2, "2024-01-09", "b"), (3, "2024-02-01", "c"), (4, None, "d"))
    src = dated((1, "2024-01-06", "x"), (3, "2024-01-07", "moved"))
    got = load_partitions(trg, src, "t")
    assert {r.v for r in got.collect()} == {"x", "moved"}
    assert {r.v for r in ranges.whole(trg, src, "t").collect()} == {"x", "moved", "c", "d"}
    assert {r.v for r in ranges.whole(trg, src, "t", keys=["k"]).collect()} == {"x", "moved", "b", "c", "d"}
    got = load_partitions(trg, src, "t", keys=["k"])
    assert {r.v for r in got.collect()} == {"x", "moved", "b"}
    assert {r.v for r in load_partitions(trg, src, "t", keys=["k"], global_key=True).collect()} == {"x", "moved", "b", "d"}
    assert load_partitions(trg, src.where("false"), "t", keys=["k"]).isEmpty()
    assert load_partitions(trg, src.unionByName(src), "t", distinct=True).count() == 2


def test_rows_without_a_partition(dated):
    trg = dated((1, "2024-01-05", "a"), (4, None, "d"))
    src = dated((4, None, "x"), (5, "1999-01-01", "early"), (1, "2024-01-09", "y"))
    first = datetime(2020, 1, 1)
    assert {r.v for r in load_partitions(trg, src, "t", keys=["k"], out_of_range="skip", first=first).collect()} == {"y"}
    with pytest.raises(ranges.OutOfRange):
        load_partitions(trg, src, "t", out_of_range="raise", first=first)
    assert {r.v for r in load_partitions(trg, src, "t", keys=["k"]).collect()} == {"x", "early", "y"}
    assert ranges.touched(src, "t", "month") == ["1999-01-01", "2024-01-01", "default"]


def test_partition_merge_reads_touched_months_only(spark, tmp_path, dated):
    dated(*[(k, f"2024-{1 + k % 12:02d}-03", "v") for k in range(48)]).write.parquet(str(tmp_path / "t"))
    trg = spark.read.parquet(str(tmp_path / "t"))
    out = load_partitions(trg, dated((1, "2024-11-09", "x")), "t", keys=["k"])
    plan = out._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(t,2024-11-01" in plan


HOW = Scd2(["k"], date(2024, 6, 1), ignore=["note"])


@pytest.fixture
def hist(spark):
    def make(*r):
        return spark.createDataFrame([(k, a, b, n, date.fromisoformat(s), date.fromisoformat(e) if e else FAR) for k, a, b, n, s, e in r], "k long, a string, b string, note string, date_from date, date_to date")

    return make


@pytest.fixture
def snap(spark):
    return lambda *r: spark.createDataFrame(list(r), "k long, a string, b string, note string")


def test_history(hist, snap):
    trg = hist(
        (1, "a", "b", "n", "2024-01-01", None), (1, "z", "z", "n", "2023-01-01", "2023-12-31"), (2, "ab", "c", "n", "2024-01-01", None),
        (3, None, "x", "n", "2024-01-01", None), (4, "same day", "x", "n", "2024-06-01", None), (5, "gone", "x", "n", "2024-01-01", None),
        (6, "gone same day", "x", "n", "2024-06-01", None), (7, "note only", "x", "n", "2024-01-01", None),
    )
    src = snap((1, "a", "b", "n"), (2, "a", "bc", "n"), (3, "null", "x", "n"), (4, "changed", "x", "n"), (7, "note only", "x", "other"), (8, "new", "x", "n"))
    got = rows(scd2(trg, src, HOW))
    day, before, start = date(2024, 6, 1), date(2024, 5, 31), date(2024, 1, 1)
    assert got == Counter([
        (1, "a", "b", "n", start, FAR), (1, "z", "z", "n", date(2023, 1, 1), date(2023, 12, 31)),
        (2, "ab", "c", "n", start, before), (2, "a", "bc", "n", day, FAR), (3, None, "x", "n", start, before), (3, "null", "x", "n", day, FAR),
        (4, "changed", "x", "n", day, FAR), (5, "gone", "x", "n", start, before), (7, "note only", "x", "n", start, FAR), (8, "new", "x", "n", day, FAR),
    ])
    live = Counter(r[0] for r in got if r[5] == FAR)
    assert set(live.values()) == {1}
    assert all(r[4] <= r[5] for r in got)
    assert {r[0] for r in rows(part(trg, src, HOW, "history"))} == {2, 3, 5}
    assert rows(scd2(scd2(trg, src, HOW), src, HOW)) == got
    with pytest.raises(ValueError):
        part(trg, src, HOW, "other")


def test_history_without_deletions(hist, snap):
    trg = hist((1, "a", "b", "n", "2024-01-01", None), (2, "a", "b", "n", "2024-01-01", None))
    how = Scd2(["k"], date(2024, 6, 1), detect_deleted=False)
    assert rows(scd2(trg, snap((1, "a", "b", "n")), how)) == rows(trg)
    assert rows(scd2(trg, snap((1, "a", "b", "n")).where("false"), how)) == rows(trg)


def test_dropping_duplicates_ranks_repeated_keys_only(spark, kv):
    """The plan sorts the source and the target's repeated keys; the target's other rows are counted by key."""
    trg = kv(*[(k % 50, f"t{k}") for k in range(80)], (None, "a"), (None, "b"))
    src = kv((1, "x"), (1, "y"), (60, "z"))
    got = merge(trg, src, ["k"], "drop")
    best = {}
    for k, v in [tuple(r) for r in trg.collect()]:
        best[k] = max(best.get(k, ""), v)
    assert rows(got) == Counter({(k, "y" if k == 1 else v): 1 for k, v in best.items()} | {(60, "z"): 1})
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window " in x]
    assert len(windows) == 2


def test_repeated_source_keys_do_not_multiply_rows(spark, kv):
    trg, src = kv((1, "a"), (2, "b"), (None, "n")), kv((1, "x"), (1, "y"), (None, "m"))
    assert rows(refresh_columns(trg, src, ["k"], ["v"])) == Counter([(1, "y")])
    with pytest.raises(ValueError):
        refresh_columns(trg, src, ["k"], ["k"])
    day = [date(2024, 1, 1), FAR]
    old = spark.createDataFrame([(1, "a", *day), (None, "n", *day)], "k long, v string, date_from date, date_to date")
    got = rows(scd2(old, src, Scd2(["k"], date(2024, 6, 1))))
    assert got == Counter([(1, "a", date(2024, 1, 1), date(2024, 5, 31)), (1, "y", date(2024, 6, 1), FAR), (None, "n", date(2024, 1, 1), date(2024, 5, 31)), (None, "m", date(2024, 6, 1), FAR)])
