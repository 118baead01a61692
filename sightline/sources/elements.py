"""Large answers: JSON arrays written one element a line, read in splits of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.functions.bind import trim_ws


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, element): the elements of JSON-lines files, or of arrays with a line for each element.

    A line is one element once the array's own brackets and the comma between elements are taken off; a file is cut into as many
    tasks as its size asks for. ``pos`` orders the elements of a file. Files whose elements span lines need the whole-file readers.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("pos"),
        F.regexp_replace(trim_ws("value"), r"^,\s*|\s*,$", "").alias("line"))
    opened = F.when(F.col("line").rlike(r"^\[\s*[\[{]"), F.regexp_replace("line", r"^\[\s*", "")).otherwise(F.col("line"))
    opened = lines.withColumn("line", opened)
    # of more closing than opening brackets at the end one belongs to the array around the elements
    closed = F.when(F.col("line").rlike(r"^\{.*\}\s*\]$"), F.regexp_replace("line", r"\s*\]$", "")).when(
        F.col("line").rlike(r"^\[.*\]\s*\]$") & F.from_json("line", "array<string>").isNull(), F.regexp_replace("line", r"\s*\]$", "")).otherwise(F.col("line"))
    return opened.withColumn("element", closed).where(~F.col("element").isin("", "[", "]")).select("file", "pos", "element")
