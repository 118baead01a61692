"""Registry of named queries and, where plain SQL can say the same, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the given tables, with its SQL twin if it has one."""
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; zone-less timestamps are read as UTC instants."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    naive = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in naive}) if naive else df
