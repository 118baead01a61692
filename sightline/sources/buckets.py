"""Keyed tables in buckets of a key's hash, of which a batch rewrites only those it touches.

A table is a Parquet folder partitioned by ``bucket``. A merge reads the touched buckets, merges, and writes them with Spark's dynamic partition
overwrite; the other buckets are neither read nor written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 256


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read(spark: SparkSession, path: str, schema: str, only: Sequence[int] | None = None) -> DataFrame:
    """Rows with their ``bucket``; with ``only`` other buckets' files are not listed in the scan."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, bucket int")
    df = spark.read.schema(f"{schema}, bucket int").parquet(path)
    return df if only is None else df.where(F.col("bucket").isin([int(b) for b in only]))


def touched(rows: DataFrame) -> list[int]:
    """The bucket numbers of some rows: at most as many as there are buckets."""
    return sorted(r.bucket for r in rows.select("bucket").distinct().collect())


def overwrite(rows: DataFrame, path: str) -> None:
    """Replace the buckets that ``rows`` hold; one file for each."""
    _write(rows.repartition("bucket"), path)


def _write(rows: DataFrame, path: str) -> None:
    # ids are hexadecimal text, which zstd writes in half the bytes
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(path)


def reduce_into(new: DataFrame, path: str, schema: str, keys: Sequence[str], reduce: Callable[[DataFrame, Sequence[str]], DataFrame],
                buckets: int = BUCKETS) -> None:
    """``reduce(rows, by)`` over the touched buckets, one row for each ``by``: the bucket, its part and the keys. ``__new`` tells new rows (1) from old ones (0).

    Rows are dealt by bucket and part before they are grouped, so they are shuffled once, in their shortest form, and written by the task that
    groups them. Few buckets have several parts (and files) each, up to BUCKETS in all, and no task sorts a whole bucket.
    """
    at = {"bucket": bucket_of(keys, buckets), "part": F.pmod(F.hash(*keys), F.lit(max(BUCKETS // buckets, 1)))}
    own = touched(new.select(at["bucket"].alias("bucket")))
    if own:
        old = read(new.sparkSession, path, schema, own).drop("bucket")
        both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1))).withColumns(at)
        _write(reduce(both.repartition("bucket", "part"), ["bucket", "part", *keys]).drop("part"), path)


def merge_into(new: DataFrame, path: str, schema: str, keys: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame],
               buckets: int = BUCKETS) -> None:
    """``merge(old, new)`` over the touched buckets; ``merge`` has to keep rows in the bucket of their keys."""
    rows = new.withColumn("bucket", bucket_of(keys, buckets)).persist()
    try:
        own = touched(rows)
        if own:
            old = read(new.sparkSession, path, schema, own).drop("bucket")
            overwrite(merge(old, rows.drop("bucket")).withColumn("bucket", bucket_of(keys, buckets)), path)
    finally:
        rows.unpersist()
