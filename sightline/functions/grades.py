"""Small predicates over grades, severities, modes and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightline import fixed


def severity_rank(col: Column) -> Column:
    """info 0 .. critical 4; an unknown word ranks with info."""
    out = F.lit(0)
    for rank, word in enumerate(fixed.SEVERITIES):
        if rank:
            out = F.when(col == word, rank).otherwise(out)
    return out


def severity_at_least(df: DataFrame, threshold: str, col: str = "severity") -> DataFrame:
    rank = fixed.SEVERITIES.index(threshold) if threshold in fixed.SEVERITIES else 0
    return df.where(severity_rank(F.col(col)) >= rank)


def mode_rank(col: Column) -> Column:
    out = F.lit(None).cast("int")
    for rank, word in enumerate(fixed.MODES):
        out = F.when(F.lower(F.trim(col)) == word, rank).otherwise(out)
    return out


def mode_ok(mode: Column, ceiling: Column) -> Column:
    return mode_rank(mode) <= mode_rank(ceiling)


def capture_ok(status: Column) -> Column:
    """2xx, 3xx and 403 prove that something was served; unknown (0) does not."""
    return F.coalesce(status.between(200, 399) | (status == 403), F.lit(False))


def host_unhealthy(status: Column) -> Column:
    return (status == 429) | (status >= 500)
