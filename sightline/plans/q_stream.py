"""Streaming queries: the given events arrive in several parts, the stream being stopped and started again between them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.functions import keys
from sightline.plans import views
from sightline.plans.catalog import query, table
from sightline.plans.q_change import custody
from sightline.session import ensure_checkpoint_dir
from sightline.sources import sinks
from sightline.streaming import streams


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


#: Three parts by time. Rows picked by LATE are held back until the last part, when their windows have long been closed.
PARTS = ["ts < '2024-01-11'", "ts >= '2024-01-11' AND ts < '2024-01-21'", "ts >= '2024-01-21'"]
REPLAYED = [PARTS[0], PARTS[1], PARTS[0], PARTS[2]]
LATE = "event_id % 50 = 7 AND ts < '2024-01-05'"
DELAYED = [f"{PARTS[0]} AND NOT ({LATE})", PARTS[1], f"{PARTS[2]} OR ({LATE})"]


def fed(rows: DataFrame, parts: list[str], start: Callable[[DataFrame, str], object]) -> str:
    """Append each part to a folder and run the stream over what is new; ``start(stream, base)`` gives its writer. Returns ``base``."""
    spark, base = rows.sparkSession, scratch(rows.sparkSession)
    for part in parts:
        rows.where(part).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        q = start(source, base).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
        q.awaitTermination()
    return base


def drained(rows: DataFrame, parts: list[str], shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an append-mode stream has written after the last part."""
    seen: list[DataFrame] = []

    def start(source: DataFrame, base: str):
        seen.append(shape(source))
        return seen[-1].writeStream.format("parquet").option("path", f"{base}/out")
    base = fed(rows, parts, start)
    return rows.sparkSession.read.schema(seen[-1].schema).parquet(f"{base}/out")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


@query("st1_dedupe_stream", "WITH " + views.OBS + "SELECT DISTINCT id FROM obs")
def st1(spark, sf):
    return drained(events(spark, sf), REPLAYED, lambda e: streams.dedupe_stream(views.obs_of(e).drop("id"), "60 days").select("id"))


@query("st2_upsert_stream", """
SELECT DISTINCT 'u' || user_id AS from_id, event_type AS to_id, 'tagged_with' AS type, bool_and(event_id % 2 = 0) OVER (PARTITION BY user_id, event_type) AS heuristic FROM events""")
def st2(spark, sf):
    def start(e: DataFrame, base: str):
        rels = keys.with_ids(e.select(
            F.concat(F.lit("u"), F.col("user_id")).alias("from_id"), F.col("event_type").alias("to_id"), F.lit("tagged_with").alias("type"),
            F.lit(0.0).alias("confidence"), (F.col("event_id") % 2 == 0).alias("heuristic"), F.array().cast("array<string>").alias("obs")), "relation")
        return streams.upsert_stream(rels, f"{base}/graph", "relations", f"{base}/log", 16)
    base = fed(events(spark, sf), REPLAYED, start)
    return sinks.load_table(spark, f"{base}/graph", "relations").select("from_id", "to_id", "type", "heuristic")


@query("st3_score_stream", "WITH " + views.WEIGHT + "SELECT subject, round(confidence, 6) AS confidence, n_obs FROM conf")
def st3(spark, sf):
    base = fed(events(spark, sf), REPLAYED, lambda e, base: streams.score_stream(
        views.obs_of(e), f"{base}/scores", "2024-01-16", f"{base}/log", unique=["event_id"], n_buckets=16))
    return streams.scores_at(spark, f"{base}/scores", views.NOW).select("subject", F.round("confidence", 6).alias("confidence"), "n_obs")


def log_of(e: DataFrame) -> DataFrame:
    return e.select("event_id", "ts", F.concat(F.lit("h"), F.col("user_id") % 20, F.lit(".example.net")).alias("host"),
                    F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"), F.concat(F.lit("s"), F.col("user_id") % 8).alias("scan_id"))


@query("st4_rate_stream", f"""
WITH w AS (SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start, 'h' || (user_id % 20) || '.example.net' AS host, count(*) AS requests FROM events WHERE NOT ({LATE}) GROUP BY 1, 2)
SELECT start, host, requests, requests > 2 AS over FROM w WHERE start + 3600000000 <= (SELECT max(epoch_us(ts)) - 300000000 FROM events)""")
def st4(spark, sf):
    out = drained(events(spark, sf), DELAYED, lambda e: streams.rate_stream(log_of(e), "1 hour", None, 2))
    return out.select(F.unix_micros("start").alias("start"), "host", "requests", "over")


@query("st4_rate_stream_sliding", f"""
WITH s AS (SELECT epoch_us(ts) AS us, 'h' || (user_id % 20) || '.example.net' AS host, unnest([0, 1, 2]) AS k FROM events WHERE NOT ({LATE})),
w AS (SELECT us // 1200000000 * 1200000000 - CAST(k AS BIGINT) * 1200000000 AS start, host, count(*) AS requests FROM s GROUP BY 1, 2)
SELECT start, host, requests, requests > 2 AS over FROM w WHERE start + 3600000000 <= (SELECT max(epoch_us(ts)) - 300000000 FROM events)""")
def st4b(spark, sf):
    out = drained(events(spark, sf), DELAYED, lambda e: streams.rate_stream(log_of(e), "1 hour", "20 minutes", 2))
    return out.select(F.unix_micros("start").alias("start"), "host", "requests", "over")


@query("st6_budget_stream", """
SELECT 's' || (user_id % 8) AS scan_id, count(*) AS requests, count(*) FILTER (event_type = 'signup') AS entities, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) AS runtime_s,
       CASE WHEN count(*) > 1200 THEN 'requests' WHEN (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 > 2580000 THEN 'runtime_s' END AS exceeded FROM events GROUP BY 1""")
def st6(spark, sf):
    def start(e: DataFrame, base: str):
        runs = e.select(F.concat(F.lit("s"), F.col("user_id") % 8).alias("scan_id"), "ts", F.lit(1).cast("long").alias("requests"),
                        (F.col("event_type") == "signup").cast("long").alias("entities"), F.lit(0.01).alias("cost"))
        return (streams.budget_stream(runs, {"requests": 1200, "runtime_s": 2580000}).writeStream.outputMode("update")
                .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")))
    base = fed(events(spark, sf), DELAYED, start)
    out = spark.read.parquet(f"{base}/out")
    cols = ["requests", "entities", "runtime_s", "exceeded"]
    latest = out.groupBy("scan_id").agg(F.max_by(F.struct(*cols), "batch").alias("r"))
    return latest.select("scan_id", "r.requests", "r.entities", F.round("r.runtime_s", 3).alias("runtime_s"), "r.exceeded")


@query("st7_chain_stream", """
SELECT 'case' || (event_id // 8) AS case_id, 'e' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, CASE WHEN event_id % 8 <> 0 AND (event_id - 1) % 101 = 5 THEN 'link' ELSE 'content' END AS problem
FROM events WHERE event_id % 101 <> 5 AND (event_id % 97 = 0 OR (event_id % 8 <> 0 AND (event_id - 1) % 101 = 5))""")
def st7(spark, sf):
    # each case is cut across the parts, so that heads have to be carried from one run to the next
    parts = ["event_id % 8 < 3", "event_id % 8 BETWEEN 3 AND 4", "event_id % 8 > 4"]
    base = fed(custody(spark, sf), parts, lambda e, base: streams.chain_stream(e, f"{base}/state", f"{base}/log", 16))
    return spark.read.parquet(f"{base}/state/breaks").select("case_id", "id", "problem")


@query("st8_session_stream", f"""
WITH o AS (SELECT 'u' || user_id AS subject, epoch_us(ts) AS us FROM events WHERE NOT ({LATE})),
f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY subject ORDER BY us) < 1800000000 THEN 0 ELSE 1 END AS s FROM o),
g AS (SELECT *, sum(s) OVER (PARTITION BY subject ORDER BY us) AS n FROM f),
x AS (SELECT subject, min(us) AS start, max(us) + 1800000000 AS "end", count(*) AS observations FROM g GROUP BY subject, n)
SELECT subject, start, "end", observations FROM x WHERE "end" <= (SELECT max(us) - 600000000 FROM o)""")
def st8(spark, sf):
    out = drained(events(spark, sf), DELAYED, lambda e: streams.session_stream(views.obs_of(e)))
    return out.select("subject", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "observations")
