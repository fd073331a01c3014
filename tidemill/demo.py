"""Seeded demo tables with a column of every common type, and loads over them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .loader import Loader
from .plans.periods import Period
from .registry import Chain
from .spec import Grouping, LoadSpec, SourceSpec

FIELDS = "int_column int, text_column string, char_column string, decimal_column decimal(10,2), json_column string, array_text_column array<string>, date_column date, timestamp_column timestamp_ntz"


def source(spark: SparkSession, rows: int = 10_000, day: datetime = datetime(2024, 6, 1), seed: int = 0, keys: int | None = None) -> DataFrame:
    """Rows of the last ninety days before ``day``; the same for the same seed on any number of cores."""
    r = lambda k, top: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(top))
    number = F.col("id") + 1 if keys is None else r(1, keys + 1)
    back = r(5, 91)
    return spark.range(rows).select(
        number.cast("int").alias("int_column"),
        F.concat(F.lit("Text "), r(2, 1001)).alias("text_column"),
        F.substring(F.md5(r(3, 1 << 40).cast("string")), 1, 10).alias("char_column"),
        (r(4, 100_001) / 100).cast("decimal(10,2)").alias("decimal_column"),
        F.to_json(F.struct(r(6, 1001).alias("id"), F.md5(r(6, 1001).cast("string")).alias("value"))).alias("json_column"),
        F.array(*[F.concat(F.lit(f"item{i} "), r(10 + i, 100)) for i in (1, 2, 3)]).alias("array_text_column"),
        F.date_sub(F.lit(day.date()), back.cast("int")).alias("date_column"),
        (F.lit(day) - F.make_dt_interval(back.cast("int"), F.lit(0), r(7, 1440).cast("int"))).alias("timestamp_column"),
    )


def install(loader: Loader, csv: str | None = None, rows: int = 10_000, day: datetime = datetime(2024, 6, 1)) -> list[int]:
    """Targets and specifications: a keyed load by month, a grouped one, and a full one from CSV if a path is given."""
    spark, store, registry = loader.spark, loader.store, loader.registry
    loader.functions.register("demo_source", lambda c: source(spark, rows, day))
    loader.functions.register("demo_grouped", lambda c: source(spark, rows, day, keys=1000))
    schema = spark.createDataFrame([], FIELDS).schema
    grouped = spark.createDataFrame([], "int_column int, decimal_column_sum decimal(10,2), date_column date, timestamp_column timestamp_ntz").schema
    common = dict(delta_field="timestamp_column", bdate_field="date_column", mode="DELTA", delta_safety=Period.of(1, "day"), group="demo", delta_start=datetime(2000, 1, 1))
    store.create("demo.keyed", schema, "date_column", "month", replace=True)
    registry.add(LoadSpec(1, "demo.keyed", "DELTA", "UPDATE_PARTITION", ("int_column",), load_function="demo_source", **common))
    store.create("demo.grouped", grouped, "date_column", "month", replace=True)
    how = dict(timestamp_column="max(timestamp_column)", decimal_column_sum="sum(decimal_column)")
    registry.add(LoadSpec(2, "demo.grouped", "DELTA", "UPDATE_PARTITION", ("int_column",), load_function="demo_grouped", transforms=how, grouping=Grouping(("int_column", "date_column")), **common))
    if csv:
        store.create("demo.files", spark.createDataFrame([], "int_column int, text_column string, decimal_column decimal(10,2), date_column date").schema, replace=True)
        registry.add(LoadSpec(3, "demo.files", method="files", source=SourceSpec("csv", csv, {"sep": ";", "header": "true"}, reject_limit=10), group="demo"))
    return [s.object_id for s in registry.active("demo")]


#: Tables of the star demo: what is small and loaded whole, and facts with their date.
DICTIONARIES = ("region", "nation", "customer", "supplier", "part")
FACTS = {"orders": "o_orderdate", "lineitem": "l_shipdate"}


def install_star(loader: Loader, folder: str, first: int = 11) -> Chain:
    """A star schema from Parquet files: dictionaries side by side, then facts by month; the chain that loads it."""
    spark, store, registry = loader.spark, loader.store, loader.registry
    path = lambda t: f"{folder}/{t}.parquet"
    for k, t in enumerate((*DICTIONARIES, *FACTS), first):
        field = FACTS.get(t)
        store.create(f"star.{t}", spark.read.parquet(path(t)).schema, field, "month" if field else None, replace=True)
        load = dict(load="PARTITION", bdate_field=field, group="facts") if field else dict(group="dictionaries")
        registry.add(LoadSpec(k, f"star.{t}", method="files", source=SourceSpec("parquet", path(t)), **load))
    ids = lambda group: ",".join(str(s.object_id) for s in registry.active(group))
    registry.chains["star"] = Chain("star", f"[{ids('dictionaries')}]>>[{ids('facts')}]", description="dictionaries, then facts")
    return registry.chains["star"]


def install_paged(loader: Loader, pages: int = 5, rows: int = 20, object_id: int = 31) -> LoadSpec:
    """A table from a source that hands out pages until one is empty."""
    loader.store.create("demo.paged", loader.spark.createDataFrame([], "id long, page string").schema, replace=True)
    loader.functions.register("demo_page", lambda p: [(p * rows + i, f"page {p}") for i in range(rows)] if p < pages else [])
    return loader.registry.add(LoadSpec(object_id, "demo.paged", method="paged", load_function="demo_page", source=SourceSpec("pages", splits=3), group="demo"))


def uninstall(loader: Loader, *groups: str) -> None:
    for s in [s for g in groups or ("demo",) for s in loader.registry.active(g)]:
        loader.registry.remove(s.object_id)
        loader.store.drop(s.name)
