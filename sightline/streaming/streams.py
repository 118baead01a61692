"""Structured Streaming forms of the table operators."""

from __future__ import annotations

import sys
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline import fixed
from sightline.functions import keys
from sightline.operators import ordered, score_state
from sightline.operators.integrity import chain_heads, evidence_hash
from sightline.operators.score import ScoreConfig
from sightline.sources import buckets, sinks

# executors need no copy of the package: state functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def dedupe_stream(sdf: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First row of each observation id; state lives as long as the delay."""
    return keys.with_ids(sdf, "observation").withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["id"])


def upsert_stream(sdf: DataFrame, directory: str, table: str, checkpoint: str, n_buckets: int = buckets.BUCKETS):
    """Merge every micro-batch into the touched buckets of a keyed table; a replayed batch changes nothing."""
    def write(batch: DataFrame, _: int) -> None:
        sinks.save_graph({table: batch}, directory, n_buckets)
    return sdf.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


GROUPS = f"{score_state.STATE}, upto long"


def apply_scores(batch: DataFrame, n: int, directory: str, horizon, cfg: ScoreConfig | None = None, unique: list[str] | None = None,
                 n_buckets: int = buckets.BUCKETS) -> None:
    """Merge one batch of observations into the score state below ``directory``; applying batch ``n`` again changes nothing.

    Only buckets of the batch's subjects are read and written. Every bucket says up to which batch it has been merged, so a batch that
    failed half-way is completed. With ``unique``, rows whose key an earlier batch (or the batch itself) has brought already are left out.
    """
    spark, seen_at, state_at = batch.sparkSession, f"{directory}/seen", f"{directory}/state"
    rows = batch.withColumn("bucket", buckets.bucket_of(["subject"], n_buckets))
    if unique:
        rows = rows.dropDuplicates(["bucket", *unique])
        if buckets.exists(spark, seen_at):
            kinds = dict(batch.dtypes)
            schema = ", ".join(f"`{c}` {kinds[c]}" for c in unique)
            seen = spark.read.schema(f"{schema}, batch long, bucket int").parquet(seen_at).where(F.col("batch") < n)
            rows = rows.join(seen.where(F.col("bucket").isin(buckets.touched(rows))), ["bucket", *unique], "left_anti")
    rows = rows.persist()
    try:
        if unique:
            rows.select(*unique, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{seen_at}/batch={n}")
        own = buckets.touched(rows)
        if not own:
            return
        old = buckets.read(spark, state_at, GROUPS, own)
        done = {r.bucket for r in old.where(F.col("upto") >= n).select("bucket").distinct().collect()}  # at most one row per bucket
        todo = [b for b in own if b not in done]
        if todo:
            new = score_state.state_of(rows.where(F.col("bucket").isin(todo)), horizon, cfg)
            state = score_state.merged(old.where(F.col("bucket").isin(todo)).select(*new.columns), new)
            buckets.overwrite(state.withColumn("upto", F.lit(n).cast("long")).withColumn("bucket", buckets.bucket_of(["subject"], n_buckets)), state_at)
    finally:
        rows.unpersist()


def score_stream(sdf: DataFrame, directory: str, horizon, checkpoint: str, cfg: ScoreConfig | None = None, unique: list[str] | None = None,
                 n_buckets: int = buckets.BUCKETS):
    """Keep the confidence of every subject up to date from the arriving observations alone; see :func:`scores_at`."""
    def apply(batch: DataFrame, n: int) -> None:
        apply_scores(batch, n, directory, horizon, cfg, unique, n_buckets)
    return sdf.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def scores_at(spark: SparkSession, directory: str, now, cfg: ScoreConfig | None = None) -> DataFrame:
    """Confidence of every subject at ``now`` (not before the stream's horizon), from the state alone."""
    return score_state.confidence_at(buckets.read(spark, f"{directory}/state", GROUPS), now, cfg)


def rate_stream(sdf: DataFrame, size: str, slide: str | None, limit: int, keys_: list[str] | None = None,
                delay: str = "5 minutes") -> DataFrame:
    """Requests per key and window (sliding when ``slide`` is set) and an over-limit flag."""
    win = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (sdf.withWatermark("ts", delay).groupBy(win, *(keys_ or ["host"]))
            .agg(F.count(F.lit(1)).alias("requests"))
            .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(keys_ or ["host"]),
                    "requests", (F.col("requests") > limit).alias("over")))


def budget_stream(sdf: DataFrame, budgets: dict[str, float]) -> DataFrame:
    """Running requests, entities, cost and runtime per scan, with the first budget exceeded."""
    run = sdf.groupBy("scan_id").agg(
        F.sum("requests").alias("requests"), F.sum("entities").alias("entities"), F.sum("cost").alias("cost"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("runtime_s"))
    over = F.lit(None).cast("string")
    for name in reversed(["requests", "entities", "cost", "runtime_s"]):
        if name in budgets:
            over = F.when(F.col(name) > budgets[name], name).otherwise(over)
    return run.withColumn("exceeded", over)


HEADS = "case_id string, head string, before string, upto long"


def verify_chain(batch: DataFrame, n: int, directory: str, n_buckets: int = buckets.BUCKETS) -> None:
    """Verify one batch of custody records; the head of each case is carried between batches.

    A case's row holds its head and the one before its last batch, so batch ``n`` finds the same start when it is applied again, and
    rewrites breaks/batch=n. Only buckets of the batch's cases are read and written.
    """
    spark, heads_at = batch.sparkSession, f"{directory}/heads"
    batch = batch.withColumn("bucket", buckets.bucket_of(["case_id"], n_buckets)).persist()
    try:
        own = buckets.touched(batch)
        old = buckets.read(spark, heads_at, HEADS, own)
        start = old.select("case_id", F.when(F.col("upto") == n, F.col("before")).otherwise(F.col("head")).alias("carried"))
        rows = ordered.lagged(batch, ["case_id"], ["captured_at", "id"], {"prior": "record_hash"})
        rows = rows.join(start, "case_id", "left")
        expected = F.coalesce("prior", "carried", F.lit(fixed.GENESIS_HASH))
        problem = F.when(F.col("prev_hash") != expected, "link").when(F.col("record_hash") != evidence_hash(), "content")
        rows.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("case_id", "id", "problem") \
            .write.mode("overwrite").parquet(f"{directory}/breaks/batch={n}")
        if own:
            latest = chain_heads(batch).select("case_id", "head").join(start, "case_id", "left").select(
                "case_id", "head", F.col("carried").alias("before"), F.lit(n).cast("long").alias("upto"))
            kept = old.drop("bucket").join(latest.select("case_id"), "case_id", "left_anti")
            buckets.overwrite(latest.unionByName(kept).withColumn("bucket", buckets.bucket_of(["case_id"], n_buckets)), heads_at)
    finally:
        batch.unpersist()


def chain_stream(sdf: DataFrame, directory: str, checkpoint: str, n_buckets: int = buckets.BUCKETS):
    """Verify custody records as they arrive; a restart neither loses nor repeats a break."""
    def verify(batch: DataFrame, n: int) -> None:
        verify_chain(batch, n, directory, n_buckets)
    return sdf.writeStream.foreachBatch(verify).option("checkpointLocation", checkpoint)


def session_stream(sdf: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Activity sessions per subject; rows later than the watermark are dropped."""
    return (sdf.withWatermark("observed_at", delay).groupBy(F.session_window("observed_at", gap), "subject")
            .agg(F.count(F.lit(1)).alias("observations"))
            .select("subject", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"),
                    "observations"))
