"""Aggregations over captures, certificates, passive sightings and collector runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline import fixed
from sightline.functions import grades, names
from sightline.operators.canonicalise import with_host
from sightline.operators.suffix import with_registrable


def host_history(captures: DataFrame, domain: str) -> DataFrame:
    """First and last stamp and capture count per host of a domain, apex included.

    ``captures``: (original, stamp, status).
    """
    ok = with_host(captures.where(grades.capture_ok(F.col("status"))), "original")
    mine = ok.where((F.col("host") == domain) | F.col("host").endswith("." + domain))
    return mine.groupBy("host").agg(F.min("stamp").alias("first_seen"), F.max("stamp").alias("last_seen"),
                                    F.count(F.lit(1)).alias("captures"))


def all_host_history(captures: DataFrame, suffixes: DataFrame) -> DataFrame:
    """The same for every registrable domain at once."""
    ok = with_host(captures.where(grades.capture_ok(F.col("status"))), "original").where(F.col("host").isNotNull())
    per_host = ok.groupBy("host").agg(F.min("stamp").alias("first_seen"), F.max("stamp").alias("last_seen"),
                                      F.count(F.lit(1)).alias("captures"))
    return with_registrable(per_host, "host", suffixes)


def ct_names(certs: DataFrame, domain: str) -> DataFrame:
    """Host under the domain, how many providers logged it, and which.

    Providers are the configured indexes, so the set is small; (name, provider) pairs
    are made distinct first and nothing else is collected.
    """
    pairs = names.names_under(certs.select("provider", F.explode("names").alias("name")), domain)
    pairs = pairs.select("host", "provider").distinct()
    return pairs.groupBy("host").agg(F.count(F.lit(1)).alias("sources_count"),
                                     F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"))


def ct_issuers(certs: DataFrame) -> DataFrame:
    return (certs.where(F.trim("issuer_org") != "").groupBy(F.trim("issuer_org").alias("issuer"))
            .agg(F.count(F.lit(1)).alias("certificates")))


def ct_certificates(certs: DataFrame) -> DataFrame:
    """One row per published digest; a revoked certificate rates medium."""
    best = certs.where(F.coalesce("cert_sha256", F.lit("")) != "").groupBy("cert_sha256").agg(
        F.min_by(F.struct("not_before", "not_after", "issuer_dn"),
                 F.struct("provider", "not_before", "not_after", "issuer_dn")).alias("f"),
        F.bool_or("revoked").alias("revoked"), F.count(F.lit(1)).alias("entries"))
    return best.select("cert_sha256", "f.not_before", "f.not_after", "f.issuer_dn", "revoked", "entries",
                       F.when(F.col("revoked"), "medium").otherwise("").alias("severity"))


def ct_aggregate(certs: DataFrame, domain: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return ct_names(certs, domain), ct_issuers(certs), ct_certificates(certs)


def vote_credibility(agreeing: Column, configured: Column) -> Column:
    """Unanimous with two or more 1, strict majority of two or more 2, else 3."""
    return (F.when((agreeing == configured) & (agreeing >= 2), "1")
            .when((agreeing >= 2) & (agreeing * 2 > configured), "2").otherwise("3"))


def passive_aggregate(sightings: DataFrame, weights: dict[str, float], key: str = "host") -> DataFrame:
    """One vote per source and host, summed weights, distinct addresses counted.

    ``sightings``: (host, source, addr). Addresses stay in their own table, see
    :func:`passive_addresses`; a host with very many of them is never gathered.
    """
    configured = len(weights)
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    votes = sightings.groupBy(key, "source").agg(F.count("addr").alias("rows_with_addr"))
    agg = votes.groupBy(key).agg(
        F.count(F.lit(1)).alias("source_count"),
        F.round(F.sum(F.coalesce(w[F.col("source")], F.lit(0.0))), 2).alias("aggregate_weight"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return agg.withColumn("credibility", vote_credibility(F.col("source_count"), F.lit(configured)))


def passive_addresses(sightings: DataFrame, key: str = "host") -> DataFrame:
    return sightings.where(F.col("addr").isNotNull()).select(key, "addr").distinct()


def passive_summary(sightings: DataFrame, answered: DataFrame, configured: int, key: str = "host") -> DataFrame:
    """One row: names, names only one source saw, sources that answered and failed, grade.

    The grade looks at the sources that answered, not at the number of names.
    """
    per = sightings.groupBy(key).agg(F.min("source").alias("lo"), F.max("source").alias("hi"))
    found = per.agg(F.count(F.lit(1)).alias("distinct_names"),
                    F.count_if(F.col("lo") == F.col("hi")).alias("uncorrelated_count"))
    ok = answered.agg(F.countDistinct("source").alias("sources_succeeded"))
    both = found.unionByName(ok, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("distinct_names", "uncorrelated_count", "sources_succeeded")])
    return (both.withColumn("sources_failed", F.lit(configured) - F.col("sources_succeeded"))
            .withColumn("credibility", vote_credibility(F.col("sources_succeeded"), F.lit(configured))))


def coverage(runs: DataFrame, key: str = "run_id") -> DataFrame:
    """Per run: sources ok and failed, distinct and emitted items, truncation.

    ``runs``: one row per (run, source, ok, item) with item NULL when a source found none.
    """
    src = runs.groupBy(key, "source").agg(F.bool_or("ok").alias("ok"))
    items = runs.where(F.col("item").isNotNull()).groupBy(key, "item").agg(F.bool_or("emitted").alias("emitted"))
    by_src = src.groupBy(key).agg(F.count_if("ok").alias("sources_ok"), F.count_if(~F.col("ok")).alias("sources_failed"))
    by_item = items.groupBy(key).agg(F.count(F.lit(1)).alias("distinct_items"), F.count_if("emitted").alias("emitted"))
    out = by_src.join(by_item, key, "left").na.fill(0, ["distinct_items", "emitted"])
    return out.withColumn("truncated", F.col("emitted") < F.col("distinct_items"))


def cap_names(df: DataFrame, keys: list[str], n: int, name: str = "name") -> DataFrame:
    """First n distinct names per group in name order, with a truncated flag.

    This cap is the operator itself. Row numbers up to n are kept by a partial window
    limit before the shuffle; the flag comes from a separate distinct count.
    """
    uniq = df.select(*keys, name).distinct()
    order = Window.partitionBy(*keys).orderBy(name)
    top = uniq.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    counts = uniq.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    return top.join(counts, keys).withColumn("truncated", F.col("found") > n)


def entity_parts(ents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch of entity rows as (one row per id, distinct (id, tag) rows, distinct (id, k, value, o) supports).

    Tags and supports stay rows, made distinct on the map side; a popular entity never becomes one long list.
    """
    base = ents.groupBy("id").agg(
        F.min_by("type", "first_seen").alias("type"), F.min_by("value", "first_seen").alias("value"),
        F.min_by("display", F.struct(F.col("display") == "", F.col("first_seen"), F.col("display"))).alias("display"),
        F.max("confidence").alias("confidence"), F.max("sensitivity").alias("sensitivity"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    tags = ents.select("id", F.explode("tags").alias("tag")).where(F.col("tag") != "").distinct()
    kv = ents.select("id", "last_seen", F.explode("attrs").alias("k", "v"))
    # one aggregate gives each attribute's newest value; each support comes with it
    said = kv.select("id", "last_seen", "k", F.col("v.value").alias("value"), F.explode_outer("v.obs").alias("o"))
    newest = F.max_by("value", F.struct("last_seen", "value"))
    per_support = said.groupBy("id", "k", "o").agg(newest.alias("value"), F.max(F.struct("last_seen", "value")).alias("at"))
    value = per_support.groupBy("id", "k").agg(F.max_by("value", "at").alias("value"))
    return base, tags, per_support.select("id", "k", "o").join(value, ["id", "k"])


def merge_entity_batch(ents: DataFrame) -> DataFrame:
    """:func:`entity_parts` gathered into one row per id with arrays, for callers that ask for them."""
    base, tags, supports = entity_parts(ents)
    tags = tags.groupBy("id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    attrs = supports.groupBy("id", "k", "value").agg(F.array_sort(F.collect_list("o")).alias("obs")).groupBy("id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.struct("value", "obs").alias("v"))))).alias("attrs"))
    out = base.join(tags, "id", "left").join(attrs, "id", "left")
    return out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
