"""Joins of many facts to one row per key, and rows spread before an aggregate that keeps most of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def attach(facts: DataFrame, dims: DataFrame, on: Sequence[str] | str, how: str = "left") -> DataFrame:
    """``facts`` joined to ``dims`` (unique on ``on``); NULL keys never match.

    A key with a large part of the facts is split at run time by the skew rule of adaptive execution, which reads the sizes the
    shuffle has written (see ``session.build_session``); nothing is counted beforehand.
    """
    return facts.join(dims, [on] if isinstance(on, str) else list(on), how)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt by the hash of some columns into the session's number of shuffle partitions, which are not merged at run time.

    An aggregate with nearly as many groups as rows holds them all in the task that reads a file, however large that is; after this it
    holds a small part. At most 200 parts, as up to there a shuffle is written without being held in memory (Spark's bypass threshold).
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(min(parts, 200), *by)
