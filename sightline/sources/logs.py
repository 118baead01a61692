"""Audit lines and evidence blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sightline.functions.bind import fenced
from sightline.functions.names import parse_registry_date
from sightline.operators.skew import attach

AUDIT_JSON = "seq BIGINT, at STRING, actor STRING, action STRING, detail STRING, prev_hash STRING, hash STRING"


def parse_audit(lines: DataFrame, pos: str = "pos", col: str = "line", lo: int = 0, hi: int = 0, log: str | None = None) -> DataFrame:
    """Entries before the first corrupt line of their log, with lo <= seq (and seq <= hi when set).

    ``log`` names the column that tells logs apart (none: the rows are one log). The cut is the smallest position that does not parse,
    one row per corrupt log from a map-side aggregate.
    """
    keyed = lines.withColumn("__log", F.lit("") if log is None else F.col(log))
    parsed = keyed.where(F.trim(col) != "").withColumn("r", fenced(F.from_json(F.col(col), AUDIT_JSON, {"mode": "PERMISSIVE"})))
    corrupt = F.col("r").isNull() | F.col("r.seq").isNull()
    cut = parsed.where(corrupt).groupBy("__log").agg(F.min(pos).alias("__cut"))
    good = attach(parsed, cut, "__log").where(F.col("__cut").isNull() | (F.col(pos) < F.col("__cut")))
    out = good.select(*([log] if log else []), F.col("r.seq").alias("seq"), parse_registry_date(F.col("r.at")).alias("at"),
                      F.col("r.at").alias("at_raw"), F.col("r.actor").alias("actor"), F.col("r.action").alias("action"),
                      F.coalesce("r.detail", F.lit("{}")).alias("detail_json"), F.col("r.prev_hash").alias("prev_hash"),
                      F.col("r.hash").alias("hash")).where(F.col("seq") >= lo)
    return out.where(F.col("seq") <= hi) if hi > 0 else out


def read_audit(spark: SparkSession, path: str, lo: int = 0, hi: int = 0) -> DataFrame:
    """JSON-lines audit files, each a log of its own; the offset in the file gives the position."""
    text = spark.read.text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("b"),
                        F.monotonically_increasing_id().alias("i")).alias("pos"), F.col("value").alias("line"))
    return parse_audit(lines, lo=lo, hi=hi, log="file").drop("file")


def read_blobs(spark: SparkSession, directory: str) -> DataFrame:
    """Blob tree aa/bb/<digest>: relative blob_path, digest named by the path, size, content."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    rel = F.regexp_extract("path", "([0-9a-f]{2}/[0-9a-f]{2}/[0-9a-f]+)$", 1)
    return b.select(rel.alias("blob_path"), F.element_at(F.split(rel, "/"), -1).alias("sha256"),
                    F.col("length").alias("size"), "content").where(F.col("blob_path") != "")


def blob_path(digest: Column) -> Column:
    return F.when(F.length(digest) < 4, digest).otherwise(
        F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest))
