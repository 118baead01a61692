"""Hash chains: recompute every record, check every link, find the first break.

Recomputing a hash needs one row; checking a link needs the row before. The row
before comes from the two-level lag, so neither one case with most of the records nor
the single global audit order is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightline import fixed
from sightline.functions.keys import rfc3339
from sightline.operators import ordered


def length_prefixed(*cols: Column) -> Column:
    """``len:`` (bytes) before every field, so no regrouping of values collides."""
    parts = []
    for c in cols:
        text = F.coalesce(c.cast("string"), F.lit(""))
        parts += [F.octet_length(text).cast("string"), F.lit(":"), text]
    return F.concat(*parts)


def evidence_hash() -> Column:
    raw = F.coalesce(F.col("captured_raw"), rfc3339(F.col("captured_at")))
    return F.sha2(length_prefixed(
        F.col("prev_hash"), F.col("case_id"), F.col("scan_id"), F.col("sha256"), F.col("size"),
        F.col("media_type"), F.col("source"), F.col("method"), F.col("collector"), raw,
        F.col("blob_path")).cast("binary"), 256)


def audit_hash() -> Column:
    nanos = F.concat((F.unix_millis(F.col("at"))).cast("string"), F.lit("000000"))
    return F.sha2(length_prefixed(F.col("prev_hash"), nanos, F.col("actor"), F.col("action"),
                                  F.col("detail_json")).cast("binary"), 256)


def evidence_links(evidence: DataFrame, width: float | None = None) -> DataFrame:
    """Every record with link_ok and hash_ok."""
    e = ordered.lagged(evidence, ["case_id"], ["captured_at", "id"], {"expected_prev": "record_hash"},
                     {"expected_prev": F.lit(fixed.GENESIS_HASH)}, width)
    return (e.withColumn("link_ok", F.col("prev_hash") == F.col("expected_prev"))
            .withColumn("hash_ok", F.col("record_hash") == evidence_hash()))


def verify_evidence(evidence: DataFrame, blobs: DataFrame | None = None, width: float | None = None) -> DataFrame:
    """One row per case: checked, ok, first_break (record id), problem, chain_head, blobs_present, blobs_missing.

    ``chain_head`` is the hash of the last record before the break, the genesis hash if there is none. The blob counts
    are over all records of the case; :func:`missing_blobs` names the missing ones.
    """
    links = evidence_links(evidence, width)
    if blobs is not None:
        links = verify_blobs(links, blobs)
        altered, missing, present = (F.col("blob_state") == state for state in ("altered", "missing", "present"))
    else:
        altered, missing, present = F.lit(False), F.lit(False), F.lit(False)
    problem = (F.when(~F.col("link_ok"), "prev_hash does not match the previous record")
               .when(~F.col("hash_ok"), "record hash mismatch").when(altered, "blob content was altered"))
    pos = F.struct("captured_at", "id")
    v = links.withColumn("__p", problem).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("checked"),
        F.min_by(F.when(F.col("__p").isNotNull(), F.struct("id", "__p", "expected_prev")),
                 F.when(F.col("__p").isNotNull(), pos)).alias("b"),
        F.max_by("record_hash", pos).alias("last"), F.count_if(present).alias("blobs_present"), F.count_if(missing).alias("blobs_missing"))
    lost = F.when(F.col("blobs_missing") > 0, "artifacts referenced by the chain are missing")
    return v.select("case_id", "checked", (F.col("b").isNull() & (F.col("blobs_missing") == 0)).alias("ok"),
                    F.col("b.id").alias("first_break"), F.when(F.col("b").isNotNull(), F.col("b.__p")).otherwise(lost).alias("problem"),
                    F.when(F.col("b").isNotNull(), F.col("b.expected_prev")).otherwise(F.col("last")).alias("chain_head"), "blobs_present", "blobs_missing")


def missing_blobs(evidence: DataFrame, blobs: DataFrame) -> DataFrame:
    """(case_id, sha256) of every artifact that the records name and the store has not."""
    return verify_blobs(evidence, blobs).where("blob_state = 'missing'").select("case_id", "sha256").distinct()


def verify_blobs(evidence: DataFrame, blobs: DataFrame) -> DataFrame:
    """blob_state present / missing / altered per record; ``blobs``: (blob_path, content)."""
    seen = blobs.select("blob_path", F.sha2("content", 256).alias("__sha"))
    j = evidence.join(seen, "blob_path", "left")
    return j.withColumn("blob_state", F.when(F.coalesce("blob_path", F.lit("")) == "", "none")
                        .when(F.col("__sha").isNull(), "missing")
                        .when(F.col("__sha") == F.col("sha256"), "present").otherwise("altered")).drop("__sha")


def audit_links(audit: DataFrame, width: float | None = None) -> DataFrame:
    """Global chain order on seq. Rows are dealt by slots of seq; each slot's first row
    meets the last hash of the slot before through a table with one row per slot."""
    a = ordered.lagged(audit, [], ["seq"], {"expected_prev": "hash"},
                     {"expected_prev": F.lit(fixed.GENESIS_HASH)}, width)
    return (a.withColumn("link_ok", F.col("prev_hash") == F.col("expected_prev"))
            .withColumn("hash_ok", F.col("hash") == audit_hash()))


def verify_audit(audit: DataFrame, width: float | None = None) -> DataFrame:
    """One row: entries, ok, broken_at_seq, reason, head_hash."""
    reason = F.when(~F.col("link_ok"), "prev_hash does not match previous head").when(~F.col("hash_ok"), "hash mismatch")
    v = audit_links(audit, width).withColumn("__p", reason).agg(
        F.count(F.lit(1)).alias("entries"),
        F.min(F.when(F.col("__p").isNotNull(), F.struct("seq", F.col("__p").alias("reason")))).alias("b"),
        F.max_by("hash", "seq").alias("head"))
    return v.select("entries", F.col("b").isNull().alias("ok"), F.col("b.seq").alias("broken_at_seq"),
                    F.col("b.reason").alias("reason"),
                    F.when(F.col("b").isNull(), F.coalesce("head", F.lit(fixed.GENESIS_HASH))).alias("head_hash"))


def chain_heads(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("case_id").agg(
        F.max_by("record_hash", F.struct("captured_at", "id")).alias("head"), F.count(F.lit(1)).alias("records"))


def record_at(evidence: DataFrame, case_id: str, k: int, width: float | None = None) -> DataFrame:
    """Record at zero-based position k of one case.

    The position is found from counts per slot of captured_at, then only the slot that
    holds it is ranked.
    """
    return ordered.row_at(evidence.where(F.col("case_id") == case_id), ["captured_at", "id"], k, width)
