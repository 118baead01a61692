"""Filtered, paged listings of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline.operators.graph import of_case, of_scan


def list_entities(ents: DataFrame, types: list[str] | None = None, min_conf: float = 0.0,
                  tags: list[str] | None = None, tag_link: DataFrame | None = None,
                  scan: str | None = None, entity_scans: DataFrame | None = None,
                  case: str | None = None, scans: DataFrame | None = None,
                  limit: int | None = None, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(one-row total, page). Type and confidence filters reach the Parquet scan."""
    q = ents
    if types:
        q = q.where(F.col("type").isin(types))
    if min_conf > 0:
        q = q.where(F.col("confidence") >= min_conf)
    for tag in tags or []:
        if tag_link is not None:
            has = tag_link.where(F.col("tag") == tag).select(F.col("entity_id").alias("id"))
            q = q.join(has, "id", "left_semi")
        else:
            q = q.where(F.array_contains("tags", tag))
    if scan:
        q = of_scan(q, entity_scans, scan)
    if case:
        q = of_case(q, entity_scans, scans, case)
    return q.agg(F.count(F.lit(1)).alias("total")), page(q, limit, offset)


def page(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """Confidence first, then most recently seen; id settles ties. Without a limit, all rows from ``offset`` on."""
    ordered = df.orderBy(F.col("confidence").desc(), F.col("last_seen").desc(), F.col("id")).offset(offset)
    return ordered if limit is None else ordered.limit(limit)
