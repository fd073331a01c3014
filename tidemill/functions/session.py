"""Parameters of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def set_parameter(spark: SparkSession, name: str, value: str) -> None:
    spark.conf.set(name, value)


def get_parameter(spark: SparkSession, name: str) -> str | None:
    """None if it isn't set."""
    return spark.conf.get(name, None)
