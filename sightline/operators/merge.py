"""Keyed merges: replaying a batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline.functions import keys


def merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """attrs and sensitivity replaced, display kept when the new one is empty, confidence max, seen bounds.

    One aggregation over both sides; each id meets itself only, after map-side combining. Tags are made distinct as (id, tag) rows
    before they meet in the column that the table has for them.
    """
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    latest = F.struct("__new", "last_seen")
    shown = F.struct((F.coalesce("display", F.lit("")) != "").cast("int"), F.col("__new"), F.col("last_seen"), F.col("display"))
    tags = merge_tags(*(d.select(F.col("id").alias("entity_id"), F.explode("tags").alias("tag")) for d in (old, new)))
    listed = tags.groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    merged = both.groupBy("id").agg(
        F.max_by("type", latest).alias("type"), F.max_by("value", latest).alias("value"),
        F.max_by("display", shown).alias("display"),
        F.max_by(F.col("attrs"), latest).alias("attrs"),
        F.max("confidence").alias("confidence"), F.max_by("sensitivity", latest).alias("sensitivity"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return (merged.join(listed, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
            .select("id", "type", "value", "display", "attrs", "tags", "confidence", "sensitivity", "first_seen", "last_seen"))


def merge_tags(old: DataFrame, new: DataFrame) -> DataFrame:
    """(entity_id, tag) rows of both, each once."""
    return old.unionByName(new).distinct()


def _first_per_key(df: DataFrame, on: list[str], order) -> DataFrame:
    rest = [c for c in df.columns if c not in on]
    if not rest:
        return df.distinct()
    agg = df.groupBy(*on).agg(F.min_by(F.struct(*rest), order).alias("__r"))
    return agg.select(*on, *[F.col("__r")[c].alias(c) for c in rest]).select(*df.columns)


def insert_if_absent(old: DataFrame, new: DataFrame, on: list[str], order=None) -> DataFrame:
    """Keep every old row; add new keys once."""
    order = F.lit(0) if order is None else order
    fresh = _first_per_key(new, on, order).join(old.select(*on), on, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def insert_observations(old: DataFrame, new: DataFrame, link: DataFrame, scan_id: str) -> tuple[DataFrame, DataFrame]:
    """First writer wins per id; the scan membership is recorded either way."""
    obs = insert_if_absent(old, new.where((F.col("id") != "") & (F.col("subject") != "")), ["id"],
                           F.struct("observed_at"))
    seen = new.select(F.col("id").alias("observation_id")).withColumn("scan_id", F.lit(scan_id))
    return obs, link.unionByName(seen).distinct()


def merge_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Strongest confidence; verified wins over heuristic for good; newest support list."""
    return strongest_relations(old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1))), ["id"])


def strongest_relations(both: DataFrame, by: list[str]) -> DataFrame:
    return both.groupBy(*by).agg(
        F.first("from_id").alias("from_id"), F.first("to_id").alias("to_id"), F.first("type").alias("type"),
        F.max("confidence").alias("confidence"), F.bool_and("heuristic").alias("heuristic"),
        F.max_by("obs", F.struct("__new", F.size("obs"))).alias("obs"))


def insert_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` carries attrs_key, the stable text of its attributes; blank kinds are skipped."""
    ided = keys.with_ids(new.where((F.col("kind") != "") & (F.col("entity_id") != "")), "finding").drop("attrs_key")
    return insert_if_absent(old, ided, ["id"], F.struct("created_at"))


def make_findings(subjects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, severity, subject, key_attrs) to finding entities and ``exposes`` edges, edges distinct."""
    f = subjects.where((F.col("kind") != "") & (F.col("severity") != ""))
    f = f.withColumn("value", keys.finding_value(F.col("kind"), F.col("subject"), F.col("key_attrs")))
    f = f.withColumn("type", F.lit("finding")).withColumn("entity_id", keys.entity_id(F.lit("finding"), F.col("value")))
    ents = f.select(F.col("entity_id").alias("id"), "type", "value").distinct()
    rels = f.select(F.col("subject").alias("from_id"), F.col("entity_id").alias("to_id"),
                    F.lit("exposes").alias("type")).distinct()
    return ents, keys.with_ids(rels, "relation").withColumn("heuristic", F.lit(False))
