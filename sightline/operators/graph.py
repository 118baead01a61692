"""Edges, neighbourhoods, aliases, erasure closure and the collection frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.functions import keys
from sightline.operators.skew import attach
from sightline.session import stage_table


def undirected(rels: DataFrame) -> DataFrame:
    """Distinct (src, dst) pairs in both directions."""
    pair = F.explode(F.array(F.struct(F.col("from_id").alias("src"), F.col("to_id").alias("dst")),
                             F.struct(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))))
    return rels.select(pair.alias("p")).select("p.src", "p.dst").distinct()


def edges_of(rels: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ``ids``, each edge once per matching id."""
    ends = rels.select("*", F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("entity_id"))
    return attach(ends, ids.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "inner")


def neighbours_of(rels: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct (id, neighbour) pairs, direction ignored, the id itself left out."""
    hit = attach(undirected(rels), ids.select(F.col("id").alias("src")).distinct(), "src", "inner")
    return hit.where("src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("neighbour"))


def edges_by_type(rels: DataFrame, limit: int) -> DataFrame:
    return rels.orderBy("type", "id").limit(limit)


def _expand(rels: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, hop) of everything within ``hops`` of the seeds, one job per hop.

    Each hop joins only the newest frontier to the edge list, drops repeats before and
    after, removes what was seen, and is written to the checkpoint folder, so the plan
    stays short and a lost executor costs one hop. A hub's edges are split by the skew-join rule
    that the session turns on; counting them anew in every hop would read all edges twice.
    """
    edges = stage_table(undirected(rels))
    frontier = stage_table(seeds.select(F.col("id")).distinct())
    seen = frontier.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        reached = edges.join(frontier.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        frontier = stage_table(reached.join(seen.select("id"), "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return seen


def neighbours(rels: DataFrame, seeds: DataFrame, depth: int = 1, limit: int | None = None,
               include_seeds: bool = False) -> DataFrame:
    """k-hop neighbourhood with hop numbers, nearest first; ``limit`` is part of the query."""
    out = _expand(rels, seeds, depth)
    if not include_seeds:
        out = out.where(F.col("hop") > 0)
    return out if limit is None else out.orderBy("hop", "id").limit(limit)


def erasure_closure(rels: DataFrame, seeds: DataFrame, hops: int = 4) -> DataFrame:
    """Ids an erasure request reaches: seeds and everything within ``hops``."""
    return _expand(rels, seeds, hops)


def of_scan(df: DataFrame, link: DataFrame, scan_id: str, id_col: str = "entity_id") -> DataFrame:
    members = link.where(F.col("scan_id") == scan_id).select(F.col(id_col).alias("id")).distinct()
    return df.join(members, "id", "left_semi")


def of_case(df: DataFrame, link: DataFrame, scans: DataFrame, case_id: str, id_col: str = "entity_id") -> DataFrame:
    runs = scans.where(F.col("case_id") == case_id).select(F.col("id").alias("scan_id"))
    members = link.join(runs, "scan_id", "left_semi").select(F.col(id_col).alias("id")).distinct()
    return df.join(members, "id", "left_semi")


def alias_candidates(value: Column) -> Column:
    """Addresses an e-mail may be an alias of: plus tag dropped, the consumer-domain pair swapped."""
    local = F.regexp_extract(value, "(?s)^(.*)@([^@]*)$", 1)
    host = F.regexp_extract(value, "(?s)^(.*)@([^@]*)$", 2)
    base = F.regexp_extract(local, "(?s)^([^+]+)\\+", 1)
    return F.array_compact(F.array(
        F.when(base != "", F.concat(base, F.lit("@"), host)),
        F.when(host == "gmail.com", F.concat(local, F.lit("@googlemail.com")))
        .when(host == "googlemail.com", F.concat(local, F.lit("@gmail.com")))))


def email_aliases(ents: DataFrame) -> DataFrame:
    """alias_of edges between addresses that are both present; nothing is merged."""
    mails = ents.where(F.col("type") == "email").select("id", "value").distinct()
    cand = mails.select(F.col("id").alias("to_id"), F.explode(alias_candidates(F.col("value"))).alias("value"))
    base = mails.select(F.col("id").alias("from_id"), "value")
    pairs = attach(cand, base.groupBy("value").agg(F.min("from_id").alias("from_id")), "value", "inner")
    out = pairs.where("from_id <> to_id").select("from_id", "to_id").distinct().withColumn("type", F.lit("alias_of"))
    return keys.with_ids(out, "relation").withColumn("heuristic", F.lit(False))


_PREDICATE = {"A": "resolves_to", "AAAA": "resolves_to", "CNAME": "cname_to", "MX": "mx_recorded", "NS": "ns_recorded"}


def dns_to_graph(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolver answers to (entities, edges).

    ``answers``: (name, type, data). Addresses and aliases point away from the name,
    mail and name servers point at it; free text becomes a content-addressed entity.
    """
    from sightline.operators.canonicalise import canonical_only
    rows = answers.where(F.trim("data") != "").withColumn("rrtype", F.col("type"))
    rows = rows.withColumn("etype", F.when(F.col("rrtype").isin("A", "AAAA"), "ip")
                           .when(F.col("rrtype").isin("CNAME", "MX", "NS"), "subdomain")
                           .when(F.col("rrtype").isin("TXT", "CAA", "SOA"), "text"))
    rows = rows.where(F.col("etype").isNotNull()).select("name", "rrtype", "etype", "data").distinct()
    c = canonical_only(rows, "etype", "data", ["ip", "subdomain", "text"])
    predicate = F.concat(F.lit("dns_"), F.lower("rrtype"))
    for rr, p in _PREDICATE.items():
        predicate = F.when(F.col("rrtype") == rr, p).otherwise(predicate)
    c = c.withColumn("predicate", predicate).withColumn("owner_id", keys.entity_id(F.lit("subdomain"), F.col("name")))
    ents = c.select(F.col("entity_id").alias("id"), F.col("etype").alias("type"),
                    F.col("canonical").alias("value")).distinct()
    outward = F.col("rrtype").isin("A", "AAAA", "CNAME")
    rel_type = (F.when(F.col("rrtype").isin("A", "AAAA"), "resolves_to").when(F.col("rrtype") == "CNAME", "cname_to")
                .when(F.col("rrtype") == "MX", "mx_for").when(F.col("rrtype") == "NS", "ns_for"))
    rels = (c.withColumn("rel", rel_type).where(F.col("rel").isNotNull())
            .select(F.when(outward, F.col("owner_id")).otherwise(F.col("entity_id")).alias("from_id"),
                    F.when(outward, F.col("entity_id")).otherwise(F.col("owner_id")).alias("to_id"),
                    F.col("rel").alias("type")).distinct())
    return ents, keys.with_ids(rels, "relation").withColumn("heuristic", F.lit(False))


def frontier(ents: DataFrame, collectors: DataFrame, done: DataFrame, allowed: DataFrame | None = None,
             depth: int = 2, breadth: int = 50) -> DataFrame:
    """Work left: entity x collector that consumes its type, not yet done, within depth.

    ``ents``: (id, type, parent, hop); ``collectors``: (collector, consumes);
    ``done``: (id, collector). At most ``breadth`` children per parent and collector,
    in id order: that bound is the query, and its partial form runs before the shuffle.
    Each entity is queued once for a collector.
    """
    # an entity found under several parents is one piece of work: the nearest, then the smallest parent
    once = (ents.groupBy("id", "type").agg(F.min(F.struct("hop", "parent")).alias("__p"))
            .select("id", "type", F.col("__p.parent").alias("parent"), F.col("__p.hop").alias("hop")))
    near = once.where(F.col("hop") <= depth)
    if allowed is not None:
        near = near.join(allowed.select("id").distinct(), "id", "left_semi")
    jobs = near.join(collectors.withColumnRenamed("consumes", "type"), "type")
    todo = jobs.join(done.select("id", "collector").distinct(), ["id", "collector"], "left_anti")
    order = Window.partitionBy("parent", "collector").orderBy("id")
    return todo.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= breadth)
