"""Confidence: grouped noisy-OR with decay, conflict penalty and evidence cap."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from sightline import fixed
from sightline.functions.bind import let
from sightline.operators.skew import attach


@dataclass(frozen=True)
class ScoreConfig:
    """Grade tables, independence groups and penalties; all replaceable."""

    reliability: Mapping[str, float] = field(default_factory=lambda: dict(fixed.RELIABILITY))
    credibility: Mapping[str, float] = field(default_factory=lambda: dict(fixed.CREDIBILITY))
    groups: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(fixed.INDEPENDENCE_GROUPS))
    source_weights: Mapping[str, float] = field(default_factory=dict)
    half_life_hours: float = fixed.HALF_LIFE_HOURS
    conflict_penalty: float = fixed.CONFLICT_PENALTY
    cap: float = fixed.CONFIDENCE_CAP
    # literal rule: groups match the whole source text only, not its provider
    strict_groups: bool = False


def _lookup(table: Mapping[str, float | str], key: Column) -> Column:
    """Small configuration table as a chain of comparisons inside generated code."""
    out = None
    by_value: dict = {}
    for k, v in table.items():
        by_value.setdefault(v, []).append(k)
    for v, ks in by_value.items():
        out = F.when(key.isin(ks), F.lit(v)) if out is None else out.when(key.isin(ks), F.lit(v))
    return F.lit(None) if out is None else out


def provider_of(source: Column) -> Column:
    """Provider part of ``module/provider:method``, or the bare text."""
    inner = F.regexp_extract(source, "^[^/]*/([^:]+)", 1)
    return F.when(inner != "", inner).otherwise(F.regexp_replace(source, ":.*$", ""))


def group_of(source: Column, cfg: ScoreConfig) -> Column:
    member = {s: g for g, ss in cfg.groups.items() for s in ss}
    if not member:
        return source
    whole = _lookup(member, source).cast("string")
    if cfg.strict_groups:
        return F.coalesce(whole, source)
    return F.coalesce(whole, _lookup(member, provider_of(source)).cast("string"), source)


def method_factor(heuristic: Column, explicit: Column) -> Column:
    """0.6 for a heuristic, an explicit factor in (0, 1], else 1."""
    return (F.when(F.coalesce(heuristic, F.lit(False)), F.lit(fixed.HEURISTIC_METHOD))
            .when((explicit > 0) & (explicit <= 1), explicit).otherwise(F.lit(1.0)))


def grade_weight(obs: DataFrame, cfg: ScoreConfig) -> Column:
    """The part of an observation's weight that does not age: grades, source weight and method."""
    rel = F.coalesce(_lookup(cfg.reliability, F.col("reliability")).cast("double"), F.lit(0.0))
    cred = F.coalesce(_lookup(cfg.credibility, F.col("credibility")).cast("double"), F.lit(0.0))
    grade = let(rel * cred, lambda g: F.when(g == 0, F.lit(fixed.UNKNOWN_GRADE_WEIGHT)).otherwise(g))
    if cfg.source_weights:
        grade = grade * F.coalesce(_lookup(cfg.source_weights, F.col("source_text")).cast("double"), F.lit(1.0))
    cols = obs.columns
    method = method_factor(F.col("heuristic") if "heuristic" in cols else F.lit(False),
                           F.col("method_factor").cast("double") if "method_factor" in cols else F.lit(1.0))
    return grade * method


def weight(obs: DataFrame, now: Column, cfg: ScoreConfig) -> Column:
    """Per-observation weight; one definition feeds both the score and its explanation."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("observed_at"))) / F.lit(1e6)
    half = F.lit(float((cfg.half_life_hours or fixed.HALF_LIFE_HOURS) * 3600))
    decay = F.when(age <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), age / half))
    return F.least(F.greatest(grade_weight(obs, cfg) * decay, F.lit(0.0)), F.lit(fixed.WEIGHT_CAP))


def prepared(obs: DataFrame, cfg: ScoreConfig, weigh: Callable[[DataFrame, ScoreConfig], Column]) -> DataFrame:
    """subject, source_text, observed_at, grp, w, artifact, conflict of each observation."""
    from sightline.functions.keys import source_text
    if "source_text" not in obs.columns:
        is_struct = dict(obs.dtypes)["source"].startswith("struct")
        obs = obs.withColumn("source_text", source_text(F.col("source")) if is_struct else F.col("source"))
    artifact = F.col("has_artifact") if "has_artifact" in obs.columns else F.size("evidence") > 0
    conflict = F.coalesce(F.col("conflict"), F.lit(False)) if "conflict" in obs.columns else F.lit(False)
    return obs.select("subject", "source_text", "observed_at",
                      group_of(F.col("source_text"), cfg).alias("grp"), weigh(obs, cfg).alias("w"),
                      F.coalesce(artifact, F.lit(False)).cast("int").alias("artifact"),
                      conflict.cast("int").alias("conflict"))


def _prepared(obs: DataFrame, now, cfg: ScoreConfig) -> DataFrame:
    at = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return prepared(obs, cfg, lambda rows, c: weight(rows, at, c))


def _per_group(prep: DataFrame) -> DataFrame:
    """One row per (subject, group). The hash aggregate combines before the shuffle,
    so a subject or source holding a third of all rows costs one row per map task."""
    return prep.groupBy("subject", "grp").agg(
        F.max("w").alias("w"), F.count(F.lit(1)).alias("n"), F.sum("conflict").alias("conflicts"),
        F.max("artifact").alias("artifact"))


def combine_groups(groups: DataFrame, cfg: ScoreConfig) -> DataFrame:
    miss = F.product(F.lit(1.0) - F.col("w"))
    agg = groups.groupBy("subject").agg(
        (F.lit(1.0) - miss).alias("raw"), F.sum("n").alias("n_obs"), F.sum("conflicts").alias("n_conflicts"),
        F.max("artifact").alias("artifact"), F.count(F.lit(1)).alias("n_groups"))
    return agg.withColumn("confidence", final_confidence(
        F.col("raw"), F.col("n_conflicts"), F.col("n_obs"), F.col("artifact") > 0, cfg))


def conflict_factor(conflicts: Column, total: Column, penalty: float) -> Column:
    p = penalty or fixed.CONFLICT_PENALTY
    return F.lit(1.0) - F.lit(p) * F.least(F.lit(1.0), conflicts / total)


def final_confidence(raw: Column, conflicts: Column, total: Column, artifact: Column, cfg: ScoreConfig) -> Column:
    penal = raw * conflict_factor(conflicts, total, cfg.conflict_penalty)
    capped = F.when(artifact, penal).otherwise(F.least(penal, F.lit(fixed.UNVERIFIED_CAP)))
    return F.least(capped, F.lit(cfg.cap or fixed.CONFIDENCE_CAP))


def confidence(obs: DataFrame, now, cfg: ScoreConfig | None = None) -> DataFrame:
    """subject, confidence, n_obs, n_conflicts, n_groups, artifact."""
    cfg = cfg or ScoreConfig()
    return combine_groups(_per_group(_prepared(obs, now, cfg)), cfg).drop("raw")


def _age_text(seconds: Column) -> Column:
    return let(seconds, lambda s: F.when(s < 60, "just now")
               .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m")))
               .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h")))
               .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d"))))


def four_places(number: Column) -> Column:
    """Text of a number from 0 to 1 with four places, rounded by its exact binary value as C's ``%.4f`` (equal halves to even).

    Rounding its shortest decimal text instead takes 0.96375 for a half, though the double lies below it. The number is cut into two
    parts whose products with 10000 are exact.
    """
    def of(x: Column) -> Column:
        high = F.floor(x * F.lit(float(1 << 26))) / F.lit(float(1 << 26))
        return let(high * 10000.0, (x - high) * 10000.0, nearest)

    def nearest(a: Column, b: Column) -> Column:
        whole = F.floor(a)
        over = a - whole - 0.5
        up = (over > -b) | ((over == -b) & (whole % 2 == 1))
        return let(whole + up.cast("long"), lambda n: F.concat(
            F.floor(n / 10000).cast("string"), F.lit("."), F.lpad((n % 10000).cast("string"), 4, "0")))
    return let(number.cast("double"), of)


def explain(obs: DataFrame, now, cfg: ScoreConfig | None = None) -> DataFrame:
    """One row per explanation line: subject, line_no, line.

    Lines stay rows, so a subject with very many groups is never gathered whole.
    """
    cfg = cfg or ScoreConfig()
    at = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    prep = _prepared(obs, now, cfg)
    best = prep.groupBy("subject", "grp").agg(
        F.max("w").alias("w"), F.count(F.lit(1)).alias("n"), F.sum("conflict").alias("conflicts"),
        F.max("artifact").alias("artifact"),
        F.max_by(F.struct("source_text", "observed_at"),
                 F.struct("w", "source_text", "observed_at")).alias("top"))
    total = combine_groups(best.select("subject", "grp", "w", "n", "conflicts", "artifact"), cfg)
    age = (F.unix_micros(at) - F.unix_micros(F.col("top.observed_at"))) / F.lit(1e6)
    group_lines = best.select(
        "subject", F.concat(F.lit("1"), F.col("grp")).alias("line_no"),
        F.format_string("group %-24s w=%s from %s (age %s, %d observation(s) collapsed)",
                        "grp", four_places(F.col("w")), "top.source_text", _age_text(age), "n").alias("line"))
    summary = total.select("subject", F.explode(F.array(
        F.struct(F.lit("2").alias("line_no"), F.concat(
            F.lit("noisy-OR over "), F.col("n_groups"), F.lit(" independent group(s) = "),
            four_places(F.col("confidence"))).alias("line")),
        F.struct(F.lit("3").alias("line_no"), F.when(F.col("n_conflicts") > 0, F.concat(
            F.lit("conflict penalty: "), F.col("n_conflicts"), F.lit(" of "), F.col("n_obs"),
            F.lit(" observations contradict -> factor "),
            four_places(conflict_factor(F.col("n_conflicts"), F.col("n_obs"), cfg.conflict_penalty)))).alias("line")),
        F.struct(F.lit("4").alias("line_no"), F.when(
            F.col("artifact") == 0,
            F.lit("no retrievable artifact -> capped at 0.50 (unverified)")).alias("line")),
        F.struct(F.lit("5").alias("line_no"), F.concat(
            F.lit("final confidence "), four_places(F.col("confidence"))).alias("line")))).alias("s"))
    return group_lines.unionByName(
        summary.select("subject", "s.line_no", "s.line").where(F.col("line").isNotNull()))


def flag_conflicts(obs: DataFrame, single_valued: Sequence[str] | None = None) -> DataFrame:
    """Set ``conflict`` on every observation whose (subject, predicate) has two or more objects.

    Two different objects exist exactly when the smallest and largest key differ, so no
    set of objects is ever collected.
    """
    groups = obs.groupBy("subject", "predicate").agg(
        (F.min(F.coalesce("object_key", F.lit(""))) != F.max(F.coalesce("object_key", F.lit("")))).alias("__c"))
    if single_valued is not None:
        groups = groups.where(F.col("predicate").isin(list(single_valued)))
    base = obs.drop("conflict") if "conflict" in obs.columns else obs
    return (attach(base, groups, ["subject", "predicate"])
            .withColumn("conflict", F.coalesce("__c", F.lit(False))).drop("__c"))


def score_relations(rels: DataFrame, ents: DataFrame) -> DataFrame:
    """Confidence of edges from their endpoints; a preset one is kept.

    An endpoint that is not in ``ents`` counts as unknown: the weaker known value is
    blended halfway to neutral. Heuristic edges stay at or below 0.6.
    """
    conf = ents.select("id", F.coalesce("confidence", F.lit(0.0)).alias("__conf"))
    j = attach(rels, conf.withColumnsRenamed({"id": "from_id", "__conf": "__from"}), "from_id")
    j = attach(j, conf.withColumnsRenamed({"id": "to_id", "__conf": "__to"}), "to_id")
    base = F.least(F.coalesce("__from", F.lit(0.0)), F.coalesce("__to", F.lit(0.0)))
    blended = F.when(F.col("__from").isNull() | F.col("__to").isNull(), base * 0.5 + 0.25).otherwise(base)
    capped = F.when(F.col("heuristic"), F.least(blended, F.lit(fixed.HEURISTIC_EDGE_CAP))).otherwise(blended)
    return (j.withColumn("confidence", F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(capped))
            .drop("__from", "__to"))


def score_batch(ents: DataFrame, obs: DataFrame, rels: DataFrame, now,
                cfg: ScoreConfig | None = None, merge: str = "history") -> tuple[DataFrame, DataFrame]:
    """Score entities from their observations, then edges from the entities.

    ``merge='max'`` keeps the larger of the stored and the new value.
    """
    scored = confidence(obs, now, cfg).select(F.col("subject").alias("id"), F.col("confidence").alias("__new"))
    out = ents.join(scored, "id", "left")
    new = F.coalesce("__new", F.lit(0.0))
    if merge == "max":
        new = F.greatest(new, F.coalesce("confidence", F.lit(0.0)))
    out = out.withColumn("confidence", new).drop("__new")
    return out, score_relations(rels, out)
