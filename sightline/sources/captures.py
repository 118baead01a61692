"""Capture index tables: a JSON array of arrays whose first row names the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sightline.functions.bind import fenced, trim_ws, whole_number
from sightline.operators.skew import attach
from sightline.sources.elements import elements


def _captures(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``rows``: header names ``h`` and cells ``row``."""
    def at(name: str) -> Column:
        return F.get(F.col("row"), (F.array_position("h", name) - 1).cast("int"))

    def present(name: str) -> Column:
        return F.when(F.array_contains("h", name), at(name))
    return (rows.where(F.array_contains("h", "original")).select(
        *keep, at("original").alias("original"), F.coalesce(present("timestamp"), F.lit("")).alias("stamp"),
        F.coalesce(whole_number(trim_ws(present("statuscode")), "int"), F.lit(0)).alias("status")).where(F.col("original").isNotNull()))


def _names(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.lower(trim_ws(c)))


def parse_cdx(df: DataFrame, col: str = "raw") -> DataFrame:
    """(original, stamp, status) per capture; a document without ``original`` gives no rows."""
    keep = [c for c in df.columns if c != col]
    t = df.select(*keep, fenced(F.from_json(F.col(col), "array<array<string>>")).alias("t"))
    t = t.withColumn("h", _names(F.get("t", F.lit(0))))
    return _captures(t.select(*keep, "h", F.explode(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))).alias("row")), keep)


def read_cdx(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Captures of files. With ``one_per_line`` a file has a line for each row and is read in splits; its first row names the columns."""
    if not one_per_line:
        return parse_cdx(spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw"))
    cells = elements(spark, path).select("file", "pos", fenced(F.from_json("element", "array<string>")).alias("row"))
    heads = cells.groupBy("file").agg(F.min("pos").alias("first"), _names(F.min_by("row", "pos")).alias("h"))
    return _captures(attach(cells, heads, "file").where(F.col("pos") > F.col("first")), [])
