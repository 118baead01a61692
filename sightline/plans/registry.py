"""Extension points: collectors, provider adapters, finding fan-out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from sightline.functions import keys
from sightline.operators.skew import attach

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Collector:
    name: str
    consumes: tuple[str, ...]
    produces: tuple[str, ...]
    reliability: str
    credibility: str
    run: Transform


COLLECTORS: dict[str, Collector] = {}
ADAPTERS: dict[str, tuple[Transform, float]] = {}


def collector(name: str, consumes: list[str], produces: list[str], reliability: str = "C", credibility: str = "3"):
    """Register a table transform that turns entities of some types into findings."""
    def register(fn: Transform) -> Transform:
        COLLECTORS[name] = Collector(name, tuple(consumes), tuple(produces), reliability, credibility, fn)
        return fn
    return register


def collectors_for(entity_type: str) -> list[Collector]:
    return [c for _, c in sorted(COLLECTORS.items()) if entity_type in c.consumes]


def run_collector(name: str, ents: DataFrame) -> DataFrame:
    """Feed a collector the entities it consumes and stamp its name and grade on the rows."""
    c = COLLECTORS[name]
    out = c.run(ents.where(F.col("type").isin(list(c.consumes))))
    return (out.withColumn("module", F.lit(c.name)).withColumn("reliability", F.lit(c.reliability))
            .withColumn("credibility", F.lit(c.credibility)))


def register_adapter(provider: str, fn: Transform, weight: float = 1.0) -> None:
    ADAPTERS[provider] = (fn, weight)


def adapt(raw: DataFrame, provider_col: str = "provider") -> DataFrame:
    """Every provider's rows through its registered adapter, united. Rows of other providers are left out."""
    parts = [fn(raw.where(F.col(provider_col) == p)).withColumn("weight", F.lit(w))
             for p, (fn, w) in sorted(ADAPTERS.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def fan_out(findings: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Findings to (entities, observations, relations, evidence links).

    ``findings``: task_id, entity struct(type, value), subject (NULL: the entity itself),
    predicate, object_key, source, reliability, credibility, observed_at, and relations
    array of struct(to_id, type, heuristic). ``evidence``: (task_id, id, sha256). Relations of a
    finding start at its entity. An observation carries a flag and a count of artifacts; which ones they are
    is a table of (observation_id, evidence_id, sha256) rows, so a task with very many artifacts is not gathered
    into its observations.
    """
    f = findings.where(F.coalesce("entity.value", F.lit("")) != "")
    f = f.withColumn("entity_id", keys.entity_id(F.col("entity.type"), F.col("entity.value")))
    f = f.withColumn("subject", F.coalesce("subject", "entity_id"))
    proof = evidence.groupBy("task_id").agg(F.countDistinct("sha256").alias("n_evidence"))
    f2 = attach(f, proof, "task_id").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
    ents = f.select(F.col("entity_id").alias("id"), "entity.type", "entity.value").distinct()
    seen = keys.with_ids(f2.select("task_id", "subject", "predicate", "object_key", "source", "reliability", "credibility",
                                   "observed_at", "n_evidence"), "observation")
    links = (seen.where("n_evidence > 0").select("task_id", F.col("id").alias("observation_id")).distinct()
             .join(evidence.select("task_id", F.col("id").alias("evidence_id"), "sha256").distinct(), "task_id")
             .select("observation_id", "evidence_id", "sha256").distinct())
    obs = seen.groupBy("id").agg(
        F.min_by(F.struct("subject", "predicate", "object_key", "source", "reliability", "credibility", "observed_at"),
                 "observed_at").alias("o"), F.max("n_evidence").alias("n_evidence"))
    obs = obs.select("id", "o.*", "n_evidence", (F.col("n_evidence") > 0).alias("has_artifact"))
    rels = f.select(F.col("entity_id").alias("from_id"), F.explode("relations").alias("r")).select("from_id", "r.*")
    rels = keys.with_ids(rels, "relation").groupBy("id").agg(
        F.first("from_id").alias("from_id"), F.first("to_id").alias("to_id"), F.first("type").alias("type"),
        F.bool_and("heuristic").alias("heuristic"))
    return ents, obs, rels, links
