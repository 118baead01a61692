"""Dedupe, facts, histories, scan differences, erasure, retention and validity."""

from __future__ import annotations

import string
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline import fixed
from sightline.functions import keys


def dedupe(obs: DataFrame) -> DataFrame:
    """One row per id (derived where blank), the earliest kept.

    An aggregate rather than a ranked window: a key with very many copies is combined
    on the map side and reaches the reducer as one row per task.
    """
    d = keys.with_ids(obs, "observation")
    rest = [c for c in d.columns if c != "id"]
    best = d.groupBy("id").agg(F.min_by(F.struct(*rest), F.col("observed_at")).alias("r"))
    return best.select("id", "r.*").select(*d.columns)


def order_observations(obs: DataFrame) -> DataFrame:
    return obs.orderBy("observed_at", "id")


def first_facts(obs: DataFrame, link: DataFrame) -> DataFrame:
    """First asserted object per (scan, subject, predicate), order observed_at then id."""
    rows = obs.select("id", "subject", "predicate", "object_key", "observed_at").join(
        link.select(F.col("observation_id").alias("id"), "scan_id"), "id")
    return (rows.groupBy("scan_id", "subject", "predicate")
            .agg(F.min_by(F.struct("object_key", "observed_at", "id"), F.struct("observed_at", "id")).alias("f"))
            .select("scan_id", "subject", "predicate", "f.object_key", "f.observed_at", "f.id"))


def history(obs: DataFrame, n: int) -> DataFrame:
    """Newest n observations per subject; the window limit runs before the shuffle."""
    order = Window.partitionBy("subject").orderBy(F.col("observed_at").desc(), F.col("id"))
    return obs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def scan_diff(ents: DataFrame, link: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(added, removed) entities between two scans."""
    both = (link.where(F.col("scan_id").isin(a, b)).groupBy(F.col("entity_id").alias("id"))
            .agg(F.bool_or(F.col("scan_id") == a).alias("in_a"), F.bool_or(F.col("scan_id") == b).alias("in_b")))
    j = ents.join(both, "id")
    return (j.where("in_b and not in_a").drop("in_a", "in_b"), j.where("in_a and not in_b").drop("in_a", "in_b"))


def fact_severity(field: Column) -> Column:
    bare = F.regexp_replace(field, "^attr:", "")
    return F.when(bare.isin(fixed.MEDIUM_FACTS), "medium").when(bare.isin(fixed.LOW_FACTS), "low").otherwise("info")


def fact_changes(obs: DataFrame, obs_link: DataFrame, ent_link: DataFrame, a: str, b: str) -> DataFrame:
    """Facts that differ between two scans, for entities both scans saw.

    Both scans' first facts come from one pass and one aggregate keyed by
    (subject, predicate); no join of two fact tables is needed.
    """
    facts = first_facts(obs, obs_link.where(F.col("scan_id").isin(a, b)))
    side = facts.groupBy("subject", "predicate").agg(
        F.max(F.when(F.col("scan_id") == a, F.struct("object_key"))).alias("before"),
        F.max(F.when(F.col("scan_id") == b, F.struct("object_key"))).alias("after"))
    shared = (ent_link.where(F.col("scan_id").isin(a, b)).select("entity_id", "scan_id").distinct()
              .groupBy(F.col("entity_id").alias("subject")).agg(F.count(F.lit(1)).alias("n")).where("n = 2"))
    changed = side.where(~F.col("before").eqNullSafe(F.col("after"))).join(shared.select("subject"), "subject", "left_semi")
    return changed.select("subject", F.col("predicate").alias("field"), F.col("before.object_key").alias("before"),
                          F.col("after.object_key").alias("after"), fact_severity(F.col("predicate")).alias("severity"))


def order_diff(diff: DataFrame, value: str = "subject") -> DataFrame:
    return diff.orderBy(value, "field")


# --- erasure ------------------------------------------------------------------------


def erasure_seeds(ents: DataFrame, subject: str | None = None, case_id: str | None = None, before=None,
                  entity_scans: DataFrame | None = None, scans: DataFrame | None = None) -> DataFrame:
    """Ids an erasure names: by subject (value, mail domain, local part), by case, or by age.

    Mail domains and local parts are compared without regard to the case of A to Z: a request must not miss a spelling.
    """
    if subject is not None:
        fold = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
        mail, value = F.col("type") == "email", fold(F.col("value"))
        name = fold(F.lit(subject))
        hit = (F.col("value") == subject) | (mail & value.endswith(F.concat(F.lit("@"), name)))
        if "@" not in subject:
            hit = hit | (mail & value.startswith(F.concat(name, F.lit("@"))))
        return ents.where(hit).select("id")
    if case_id is not None:
        runs = scans.where(F.col("case_id") == case_id).select(F.col("id").alias("scan_id"))
        return entity_scans.join(runs, "scan_id", "left_semi").select(F.col("entity_id").alias("id")).distinct()
    if before is not None:
        return ents.where(F.col("last_seen") < F.lit(before).cast("timestamp")).select("id")
    raise ValueError("name a subject, a case or an age")


ERASE_KEYS = {"entities": ["id"], "observations": ["subject"], "relations": ["from_id", "to_id"],
              "tags": ["entity_id"], "entity_scans": ["entity_id"], "findings": ["entity_id"]}


def erase(graph: Mapping[str, DataFrame], ids: DataFrame, dry_run: bool = True) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(report, tables). The report counts rows per table; tables are untouched when ``dry_run``.

    Evidence rows and blobs stay, by design. Membership rows of erased observations go too.
    """
    gone = ids.select("id").distinct()
    out: dict[str, DataFrame] = dict(graph)
    counts = []
    for name, cols in ERASE_KEYS.items():
        if name not in graph:
            continue
        df = graph[name]
        kept = df
        for c in cols:
            kept = kept.join(gone.withColumnRenamed("id", c), c, "left_anti").select(*df.columns)
        # one aggregate: all rows count +1, kept rows -1
        counts.append(df.select(F.lit(name).alias("table_name"), F.lit(1).alias("n"))
                      .unionByName(kept.select(F.lit(name).alias("table_name"), F.lit(-1).alias("n"))))
        out[name] = kept
    if "observation_scans" in graph and "observations" in graph:
        link = graph["observation_scans"]
        erased = graph["observations"].join(gone.withColumnRenamed("id", "subject"), "subject", "left_semi")
        kept = link.join(erased.select(F.col("id").alias("observation_id")), "observation_id", "left_anti").select(*link.columns)
        counts.append(link.select(F.lit("observation_scans").alias("table_name"), F.lit(1).alias("n"))
                      .unionByName(kept.select(F.lit("observation_scans").alias("table_name"), F.lit(-1).alias("n"))))
        out["observation_scans"] = kept
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    report = total.groupBy("table_name").agg(F.sum("n").alias("erased"))
    return report, (dict(graph) if dry_run else out)


def purge(graph: Mapping[str, DataFrame], subject: str | None = None, case_id: str | None = None, before=None, hops: int = 4,
          dry_run: bool = True) -> tuple[DataFrame, dict[str, DataFrame]]:
    """An erasure request in one call: seeds, then, for a subject, all that is linked with it, then the report and the tables.

    ``graph`` holds the tables of :data:`ERASE_KEYS` and, for a case, ``scans`` (id, case_id).
    """
    from sightline.operators.graph import erasure_closure
    seeds = erasure_seeds(graph["entities"], subject, case_id, before, graph.get("entity_scans"), graph.get("scans"))
    reached = erasure_closure(graph["relations"], seeds, hops).select("id") if subject is not None and "relations" in graph else seeds
    return erase(graph, reached, dry_run)


def retention(graph: Mapping[str, DataFrame], now, days: Mapping[str, int] = fixed.RETENTION_DAYS) -> dict[str, DataFrame]:
    """Rows past their age class, per table, ready to drop."""
    at = F.lit(now).cast("timestamp")
    stamp = {"evidence": "captured_at", "observations": "observed_at", "audit": "at"}
    out = {}
    for name, col in stamp.items():
        if name in graph:
            limit = F.lit(days[name])
            if "sensitivity" in graph[name].columns:
                limit = F.when(F.col("sensitivity") == 2, F.least(limit, F.lit(days["high"]))).otherwise(limit)
            out[name] = graph[name].where(F.unix_seconds(F.col(col)) < F.unix_seconds(at) - limit * 86400)
    if "entities" in graph:
        out["entities"] = graph["entities"].where(
            (F.col("sensitivity") == 2) & (F.unix_seconds("last_seen") < F.unix_seconds(at) - days["high"] * 86400))
    return out


def redact(df: DataFrame, fields: list[str], modes: Mapping[int, str] | None = None) -> DataFrame:
    """Mask ``fields`` where the row's sensitivity class exports only redacted rows."""
    modes = modes or {2: "redacted_only"}
    hidden = [level for level, how in modes.items() if how == "redacted_only"]
    for f in fields:
        df = df.withColumn(f, F.when(F.col("sensitivity").isin(hidden), F.lit("redacted")).otherwise(F.col(f)))
    return df


# --- validity ---------------------------------------------------------------------------


def current_facts(obs: DataFrame) -> DataFrame:
    """Latest claim per (subject, predicate, source)."""
    return (obs.groupBy("subject", "predicate", "source")
            .agg(F.max_by(F.struct("object_key", "observed_at", "id"), F.struct("observed_at", "id")).alias("f"))
            .select("subject", "predicate", "source", "f.object_key", "f.observed_at", "f.id"))


def as_of(obs: DataFrame, at) -> DataFrame:
    """Claims valid at an instant, latest per (subject, predicate, source)."""
    t = F.lit(at).cast("timestamp")
    live = obs.where((F.coalesce("valid_from", "observed_at") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))
    return current_facts(live)
