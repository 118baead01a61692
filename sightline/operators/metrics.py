"""Counters over the store, the audit log and the request log."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from sightline.functions.grades import host_unhealthy
from sightline.operators import ordered


def store_stats(graph: Mapping[str, DataFrame]) -> DataFrame:
    """(counter, n) rows: row count per table and observations without evidence."""
    out = None
    for name, df in graph.items():
        counts = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counter"), "n")
        if name == "observations":
            both = df.agg(F.count(F.lit(1)).alias("observations"),
                          F.count_if(F.coalesce(F.size("evidence"), F.lit(0)) <= 0).alias("observations_without_evidence"))
            counts = both.select(F.explode(F.create_map(
                F.lit("observations"), "observations",
                F.lit("observations_without_evidence"), "observations_without_evidence")).alias("counter", "n"))
        out = counts if out is None else out.unionByName(counts)
    return out


def query_audit(audit: DataFrame, actor: str | None = None, action: str | None = None, since=None, until=None,
                from_seq: int | None = None, limit: int | None = None) -> DataFrame:
    """Matching entries, newest first."""
    q = audit
    if actor:
        q = q.where(F.col("actor") == actor)
    if action:
        q = q.where(F.col("action") == action)
    if since is not None:
        q = q.where(F.col("at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        q = q.where(F.col("at") <= F.lit(until).cast("timestamp"))
    if from_seq is not None:
        q = q.where(F.col("seq") >= from_seq)
    q = q.orderBy(F.col("seq").desc())
    return q.limit(limit) if limit else q


def audit_actions(audit: DataFrame) -> DataFrame:
    return audit.select("action").distinct().orderBy("action")


def scan_summary(scans: DataFrame, entity_scans: DataFrame, findings: DataFrame, request_log: DataFrame,
                 audit_events: DataFrame) -> DataFrame:
    """Counters per scan. Each table is reduced to one row per scan before the joins.

    ``audit_events``: (scan_id, event) with event among error, denial, out_of_scope.
    """
    ents = entity_scans.distinct().groupBy("scan_id").agg(F.count(F.lit(1)).alias("entities"))
    finds = findings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("findings"))
    reqs = request_log.groupBy("scan_id").agg(F.count(F.lit(1)).alias("requests"),
                                              F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    events = audit_events.groupBy("scan_id").agg(
        F.count_if(F.col("event") == "error").alias("errors"),
        F.count_if(F.col("event") == "denial").alias("denials"),
        F.count_if(F.col("event") == "out_of_scope").alias("out_of_scope"))
    out = scans.select(F.col("id").alias("scan_id"))
    for part in (ents, finds, reqs, events):
        out = out.join(part, "scan_id", "left")
    return out.na.fill(0)


def request_metrics(log: DataFrame, by: list[str], rollup: bool = False) -> DataFrame:
    """Requests, denials, cache hits, failures, retries and time per group; ``rollup`` adds subtotals."""
    grouped = log.rollup(*by) if rollup else log.groupBy(*by)
    return grouped.agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("allowed")).alias("denied"),
        F.count_if(F.col("from_cache")).alias("cache_hits"),
        F.count_if(host_unhealthy(F.col("status"))).alias("failures"),
        F.sum(F.col("retries").cast("long")).alias("retries"), F.sum("duration_ms").alias("duration_ms"))


def host_health(log: DataFrame, threshold: int = 5, gap_seconds: int = 60,
                width: float | None = None) -> DataFrame:
    """Runs of consecutive failures per host: start, end, length, whether the run opens the breaker.

    A success or more than ``gap_seconds`` since the last failure ends a run. Run numbers
    are two-level running sums, then runs are counted by an ordinary aggregate.
    """
    order = ["ts", "event_id"]
    rows = log.select("host", *order, host_unhealthy(F.col("status")).alias("bad"))
    rows = ordered.lagged(rows, ["host"], order, {"prev_bad": "bad", "prev_ts": "ts"},
                        {"prev_bad": F.lit(None).cast("boolean"), "prev_ts": F.lit(None).cast("timestamp")},
                        width)
    gap = (F.unix_micros("ts") - F.unix_micros("prev_ts")) > gap_seconds * 1_000_000
    starts = F.col("bad") & (~F.coalesce("prev_bad", F.lit(False)) | F.coalesce(gap, F.lit(True)))
    runs = ordered.running(rows, ["host"], order, {"run": starts.cast("long")}, width=width)
    return (runs.where("bad").groupBy("host", "run").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("failures"))
        .withColumn("opens", F.col("failures") >= threshold))


def rate_violations(log: DataFrame, limit: int, period_seconds: int, keys: list[str] | None = None,
                    carry: list[str] | None = None, width: float | None = None) -> DataFrame:
    """Requests that bring the count of the last period (both ends in) above ``limit``.

    Every request is one arrival now and one departure just after the period, so the
    count in the period is a running sum. It is taken in two levels over slots
    of time, so a busy host is spread over many tasks.
    """
    keys, carry = keys or ["host"], carry or ["event_id"]
    us = F.unix_micros(F.col("ts"))
    move = F.explode(F.array(
        F.struct(us.alias("at"), F.lit(1).alias("d")),
        F.struct((us + period_seconds * 1_000_000 + 1).alias("at"), F.lit(-1).alias("d"))))
    moves = log.select(*keys, *carry, "ts", move.alias("m")).select(*keys, *carry, "ts", "m.at", "m.d")
    run = ordered.running(moves, keys, ["at"], {"in_period": F.col("d").cast("long")}, peers=True, width=(width or ordered.SECONDS) * 1e6)
    return run.where((F.col("d") == 1) & (F.col("in_period") > limit)).select(*keys, *carry, "ts", "in_period")
