from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import names
from tidemill.functions.expressions import cast, external_schema, extract_condition, load_condition, max_value, min_value, project, text_array
from tidemill.functions.variables import expand, literals
from tidemill.spec import Grouping, LoadSpec, SourceSpec, SpecError


def test_variables_are_whole_tokens():
    v = {"load_from": datetime(2024, 1, 1), "load": "no", "load_id": 5, "nothing": None}
    assert expand("$load_from/$load_id/$load_fromage/$nothing $x", v) == "2024-01-01 00:00:00/5/$load_fromage/$nothing $x"
    assert expand(None, v) is None
    assert literals("t >= $load_from and s = '$load_from'", v) == "t >= timestamp_ntz'2024-01-01 00:00:00' and s = '2024-01-01 00:00:00'"


def test_names():
    assert names.unify(" Stg.'Table/;' ") == "stg.table"
    assert names.schema_of("plain") == "" and names.table_of("a.b") == "b"
    assert names.external("src_sales.orders", 7) == "stg_sales.ext_orders_7"
    assert names.delta("load_x.t", 1) == "stg_x.delta_t_1"
    assert names.export("dm.t", 2) == "dm.ext_t_2" and names.export("dm.t", 2, "cdm") == "cdm.ext_t_2"
    assert names.backup("a.b") == "a.bkp_b" and names.buffer("b", "x") == "buffer_b_x"


def test_conditions(spark):
    lo, hi = datetime(2024, 1, 1), datetime(2024, 2, 1)
    df = spark.createDataFrame([(1, datetime(2024, 1, 1), "x"), (2, datetime(2024, 2, 1), "o'k"), (3, None, "when")], "id long, src_when timestamp_ntz, v string")
    spec = LoadSpec(1, "t", "DELTA", "DELTA", delta_field="when", bdate_field="when", source=SourceSpec(rename={"when": "src_when"}))
    ids = lambda c: [r.id for r in df.where(c).collect()]
    assert ids(extract_condition(spec, lo, hi)) == [1]
    assert ids(extract_condition(spec.but(extraction="PARTITION"), hi, datetime(2025, 1, 1))) == [2]
    assert extract_condition(spec.but(extraction="FULL"), lo, hi) is None
    assert extract_condition(spec, None, hi) is None and extract_condition(spec.but(delta_field=None), lo, hi) is None
    # names in quotes and longer names aren't touched
    assert ids(extract_condition(spec.but(where="when is null and v = 'when'"), lo, hi)) == [3]
    assert ids(extract_condition(spec.but(where="when < $extraction_to and v <> 'o''k'"), lo, hi, {"extraction_to": hi})) == [1]
    assert load_condition(spec.but(load="FULL"), lo, hi) is None
    assert [r.id for r in df.alias("s").where(load_condition(spec, lo, hi, alias="s")).collect()] == [1]
    assert (min_value(df, "id"), max_value(df, "id", "id < 3"), max_value(df, "id", "false")) == ("1", "2", None)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select("id", F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"), F.lit(1).alias("other")).write.parquet(str(tmp_path / "x"))
    spec = LoadSpec(1, "t", "DELTA", "DELTA", delta_field="t")
    schema = T.StructType().add("id", "long").add("t", "timestamp_ntz")
    plan = project(spark.read.parquet(str(tmp_path / "x")), schema, where=extract_condition(spec, datetime(1970, 1, 1), datetime(1970, 1, 2)))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(t), GreaterThanOrEqual(t" in plan and "other" not in plan


def test_projection(spark):
    df = spark.createDataFrame([(1, "2024-05-01", 2.5, '{"k": 7}'), (1, "2024-05-02", 3.5, "{}")], "id int, day string, v double, js string")
    schema = T.StructType().add("id", "long").add("day", "date").add("k", "string")
    assert [tuple(map(str, r)) for r in project(df, schema, {"k": "get_json_object(js, '$.k')"}).collect()] == [("1", "2024-05-01", "7"), ("1", "2024-05-02", "None")]
    with pytest.raises(SpecError, match="k"):
        project(df, schema)
    total = T.StructType().add("id", "long").add("total", "decimal(10,2)")
    got = project(df, total, {"total": "sum(v)"}, Grouping(("id",), having="total > 5", order_by=("total desc",), limit=3)).collect()
    assert [(r.id, str(r.total)) for r in got] == [(1, "6.00")]
    with pytest.raises(SpecError, match="day"):
        project(df, T.StructType().add("id", "long").add("day", "string"), {}, Grouping(("id",)))


def test_arrays_from_text(spark):
    df = spark.createDataFrame([("{a,b}",), ('{"x,y",NULL,"q\\"z"}',), ("{}",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(text_array(F.col("t"))).collect()] == [["a", "b"], ["x,y", None, 'q"z'], [], None, None]
    ints = df.where("t = '{a,b}'").select(cast(F.lit("{1,2}"), T.StringType(), T.ArrayType(T.IntegerType())))
    assert ints.first()[0] == [1, 2]


def test_external_schema():
    target = T.StructType().add("id", "long").add("d", "date").add("tags", T.ArrayType(T.StringType())).add("n", "decimal(10,2)")
    got = external_schema(target, {"d": "day"}, {"n": "string"})
    assert [(f.name, f.dataType.simpleString()) for f in got] == [("id", "bigint"), ("day", "timestamp_ntz"), ("tags", "string"), ("n", "string")]
