from datetime import datetime

import pytest

from tidemill.store import TableMissing, TableStore, Version


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


@pytest.fixture
def dated(spark):
    return lambda *r: spark.createDataFrame([(k, datetime.fromisoformat(t) if t else None) for k, t in r], "k long, t timestamp_ntz")


def ids(df):
    return sorted(r.k for r in df.collect())


def test_versions(store, dated):
    with pytest.raises(TableMissing):
        store.read("a.b")
    rows = dated((1, "2024-01-01"), (2, "2024-02-01"))
    store.create("a.b", rows.schema)
    assert store.exists("a.b") and ids(store.read("a.b")) == []
    with pytest.raises(ValueError):
        store.create("a.b", rows.schema)
    store.replace("a.b", rows)
    store.append("a.b", dated((3, None)))
    assert ids(store.read("a.b")) == [1, 2, 3] and ids(store.read("a.b", number=2)) == [1, 2]
    store.rollback("a.b")
    assert ids(store.read("a.b")) == [1, 2]
    store.truncate("a.b")
    assert ids(store.read("a.b")) == []
    assert store.vacuum("a.b", keep=1) > 0
    assert store.tables() == ["a.b"] and store.drop("a.b") and not store.exists("a.b")


def test_partitions_keep_their_files(store, dated):
    store.create("t", dated((1, None)).schema, "t", "month")
    store.replace("t", dated((1, "2024-01-05"), (2, "2024-02-05"), (3, None)))
    before = store.version("t").parts
    assert sorted(before) == ["2024-01-01", "2024-02-01", "default"]
    assert store.replace_partitions("t", dated((9, "2024-02-09"), (8, "2024-03-09"))) == ["2024-02-01", "2024-03-01"]
    after = store.version("t").parts
    assert after["2024-01-01"] == before["2024-01-01"] and after["default"] == before["default"]
    assert ids(store.read("t")) == [1, 3, 8, 9] and ids(store.read("t", ["2024-02-01"])) == [9]
    assert [p.name for p in store.partitions("t")] == ["m_01_2024", "m_02_2024", "m_03_2024"]
    assert store.truncate_range("t", datetime(2024, 3, 3), datetime(2024, 3, 4)) == ["2024-03-01"]
    assert len(store.partitions("t")) == 3 and ids(store.read("t")) == [1, 3, 9]
    assert store.drop_range("t", datetime(2024, 2, 28), datetime(2024, 3, 4)) == ["2024-02-01", "2024-03-01"]
    assert len(store.partitions("t")) == 1 and ids(store.read("t")) == [1, 3]


def test_switch_is_validated(store, dated):
    store.create("t", dated((1, None)).schema, "t", "month")
    store.replace("t", dated((1, "2024-01-05"), (2, "2024-02-05")))
    store.create_like("new", "t")
    store.replace("new", dated((5, "2024-02-07")))
    store.switch_partition("t", datetime(2024, 2, 20), "new")
    assert ids(store.read("t")) == [1, 5]
    with pytest.raises(ValueError):
        store.switch_partition("t", "2024-01-01", "new")
    with pytest.raises(KeyError):
        store.switch_partition("t", "2023-01-01", "new")
    with pytest.raises(ValueError):
        store.create_like("t", "t")
    assert store.create_as("copy", store.read("t")) == 2


def test_inserts_go_by_position(store, spark, dated):
    store.create("t", dated((1, None)).schema, "t", "month")
    assert store.insert("t", spark.sql("select 7 as other, timestamp_ntz'2024-01-01' as names"), where="other = 7") == 1
    assert store.insert_query("t", "select 8, cast(null as timestamp_ntz)") == 1
    assert ids(store.read("t")) == [7, 8]
    with pytest.raises(ValueError):
        store.insert("t", spark.range(1))
    assert store.insert_query("t", "select 9, timestamp_ntz'2024-02-01'", truncate=True) == 1
    assert ids(store.read("t")) == [9]
    got = {r["column"]: (r["rows"], r["nulls"], r["least"]) for r in store.statistics("t").collect()}
    assert got["k"] == (1, 0, "9")
    assert store.describe("t")["partition_key"] == "t" and store.describe("t")["partitions"] == 1


def test_default_partition_is_switched(store, dated):
    store.create("t", dated((1, None)).schema, "t", "month")
    store.replace("t", dated((1, "2024-01-05"), (2, None)))
    store.create_like("new", "t")
    assert store.switch_default("t", "new") is False
    store.replace("new", dated((5, None)))
    assert store.switch_default("t", "new") and ids(store.read("t")) == [1, 5]
    store.replace("new", dated((5, "2024-01-09")))
    with pytest.raises(ValueError):
        store.switch_default("t", "new")


def test_a_crash_before_the_rename_leaves_the_old_version(store, dated, monkeypatch):
    store.create("t", dated((1, None)).schema)
    store.replace("t", dated((1, None)))
    monkeypatch.setattr("tidemill.files.Files.replace", lambda *a: (_ for _ in ()).throw(RuntimeError("power")))
    with pytest.raises(RuntimeError, match="power"):
        store.replace("t", dated((2, None)))
    monkeypatch.undo()
    assert ids(store.read("t")) == [1]
    store.replace("t", dated((3, None)))
    assert ids(store.read("t")) == [3]


def test_a_late_writer_is_refused(store, dated):
    store.create("t", dated((1, None)).schema)
    old = store.version("t")
    store.replace("t", dated((1, None)))
    with pytest.raises(RuntimeError, match="another writer"):
        store._publish("t", Version(old.number + 1, old.schema))
    assert ids(store.read("t")) == [1]


def test_a_table_may_be_replaced_by_what_is_read_of_it(store, dated):
    store.create("t", dated((1, None)).schema, "t", "month")
    store.replace("t", dated((1, "2024-01-05"), (2, "2024-01-06")))
    store.replace_partitions("t", store.read("t").where("k = 2"))
    assert ids(store.read("t")) == [2]


def test_mixed_widths(store, dated):
    store.create("t", dated((1, None)).schema, "t", "2024-01-01=month;2024-03-01=day")
    store.replace("t", dated((1, "2023-12-31"), (2, "2024-01-05"), (3, "2024-02-29"), (4, "2024-03-01"), (5, "2024-03-02"), (6, None)))
    assert sorted(store.version("t").parts) == ["2024-01-01", "2024-02-01", "2024-03-01", "2024-03-02", "default"]
    assert [p.name for p in store.partitions("t")] == ["m_01_2024", "m_02_2024", "d_01_03_2024", "d_02_03_2024"]
    assert ids(store.read("t", ["default"])) == [1, 6]
    for wrong in ("week", "2024-01-02=month", "2024-03-01=day;2024-01-01=month"):
        with pytest.raises(ValueError):
            store.create("u", dated((1, None)).schema, "t", wrong)


def test_files_follow_the_size_of_a_partition(spark, tmp_path):
    """A month with one value in its first column is split by size, small months aren't."""
    store = TableStore(spark, str(tmp_path / "store"))
    rows = spark.range(0, 200_000, 1, 16).selectExpr("1L as k", "case when id % 100 = 0 then timestamp_ntz'2024-01-05' else timestamp_ntz'2024-02-05' end as t", "sha2(cast(id as string), 256) as v")
    store.create("t", rows.schema, "t", "month")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        store.replace("t", rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    n = {p: spark.read.parquet(str(tmp_path / "store/t" / d[0])).select("k").inputFiles() for p, d in store.version("t").parts.items()}
    assert len(n["2024-02-01"]) > 4 and len(n["2024-01-01"]) == 1


def test_keys_and_statistics_are_kept(store, spark):
    rows = spark.range(1000).selectExpr("id % 100 as k", "id as v")
    store.create("t", rows.schema, keys=["k"])
    store.replace("t", rows)
    assert store.distribution_key("t") == ("k",) and store.describe("t")["keys"] == ["k"]
    for f in store.read("t").inputFiles():
        own = [r.k for r in spark.read.parquet(f).collect()]
        assert own == sorted(own)
    assert store.known_statistics("t") is None
    assert store.analyze("t")["k"]["rows"] == 1000 and store.known_statistics("t")["v"]["greatest"] == "999"
    store.append("t", rows)
    assert store.known_statistics("t") is None
    with pytest.raises(ValueError):
        store.create("u", rows.schema, keys=["x"])


def test_options_of_a_table(store, spark):
    rows = spark.range(10)
    store.create("t", rows.schema, compression="gzip")
    store.create_like("u", "t")
    store.create("v", rows.schema, temporary=True)
    for n in ("t", "u", "v"):
        store.replace(n, rows)
    assert all(f.endswith(".gz.parquet") for n in ("t", "u") for f in store.read(n).inputFiles())
    assert all(f.endswith(".zstd.parquet") for f in store.read("v").inputFiles()) and store.describe("t")["compression"] == "gzip"
    store.close()
    assert store.tables() == ["t", "u"]
