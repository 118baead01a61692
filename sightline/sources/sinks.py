"""Graph tables on disk: keyed, merged idempotently bucket by bucket, and JSON export of a listing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline import schemas
from sightline.operators import merge
from sightline.sources import buckets


def _path(directory: str, name: str) -> str:
    return f"{directory.rstrip('/')}/{name}"


def load_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return buckets.read(spark, _path(directory, name), schemas.GRAPH_TABLES[name]).drop("bucket")


def merge_table(name: str, old: DataFrame, new: DataFrame) -> DataFrame:
    if name == "entities":
        return merge.merge_entities(old, new)
    order = None
    if name in ("observations", "findings"):
        # of two rows with one id the earlier stays, then the one with the smaller content
        owner, at = ("subject", "observed_at") if name == "observations" else ("entity_id", "created_at")
        new = new.where((F.col("id") != "") & (F.col(owner) != ""))
        order = F.struct(at, F.xxhash64(*[c for c, kind in new.dtypes if "map<" not in kind]))
    return merge.insert_if_absent(old, new, schemas.GRAPH_KEYS[name], order)


def save_graph(batch: Mapping[str, DataFrame], directory: str, n_buckets: int = buckets.BUCKETS) -> None:
    """Merge a batch into the nine keyed tables; only buckets of its keys are read and written. Saving a batch again changes nothing."""
    for name, new in batch.items():
        schema = schemas.GRAPH_TABLES[name]
        columns, keys, path = new.sparkSession.createDataFrame([], schema).columns, schemas.GRAPH_KEYS[name], _path(directory, name)
        if name == "relations" or set(columns) == set(keys):
            reduce = merge.strongest_relations if name == "relations" else (lambda both, by: both.select(*by).distinct())
            buckets.reduce_into(new.select(*columns), path, schema, keys, lambda both, by, reduce=reduce, columns=columns: reduce(both, by).select("bucket", "part", *columns), n_buckets)
            continue
        buckets.merge_into(new.select(*columns), path, schema, keys,
                           lambda old, rows, name=name, columns=columns: merge_table(name, old, rows).select(*columns), n_buckets)


def export_json(page: DataFrame, total: DataFrame, path: str) -> None:
    """Listing rows as JSON lines under rows/, one {total, returned} line under summary/."""
    page.write.mode("overwrite").json(f"{path}/rows")
    returned = page.agg(F.count(F.lit(1)).alias("returned"))
    both = total.unionByName(returned, allowMissingColumns=True)
    both.agg(F.max("total").alias("total"), F.max("returned").alias("returned")) \
        .write.mode("overwrite").json(f"{path}/summary")
