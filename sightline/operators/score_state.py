"""Confidence from a mergeable state: no observation is read twice.

The weight of an observation is ``g * 0.5 ** ((now - t) / half)`` once ``now`` has passed its time ``t``. Its logarithm splits into
``log2(g) + t / half``, which belongs to the row, and ``-now / half``, which is the same for all rows. So of the rows of a (subject, group)
only the largest row part is needed, whenever the score is asked for. Rows that lie in the future of the state's horizon do not decay
yet; each such time stays a row of its own until the horizon passes it.

A state row is (subject, grp, pending, best, n, conflicts, artifact): ``pending`` is the time of rows after the horizon, NULL for the
others; all other columns merge by max or sum. Scores may be asked for any time at or after the horizon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightline import fixed
from sightline.operators.score import ScoreConfig, combine_groups, grade_weight, prepared

KEY = ["subject", "grp", "pending"]
STATE = "subject string, grp string, pending timestamp, best double, n long, conflicts long, artifact int"


def _time(value) -> Column:
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


def _half_lives(at: Column, cfg: ScoreConfig) -> Column:
    """A time in half-lives since the epoch."""
    return F.unix_micros(at) / F.lit(1e6) / F.lit(float((cfg.half_life_hours or fixed.HALF_LIFE_HOURS) * 3600))


def state_of(obs: DataFrame, horizon, cfg: ScoreConfig | None = None) -> DataFrame:
    """The state of some observations; combined on the map side, so a hot subject is one row per task and group."""
    cfg = cfg or ScoreConfig()
    rows = prepared(obs, cfg, grade_weight)
    part = F.log2(F.greatest("w", F.lit(0.0))) + _half_lives(F.col("observed_at"), cfg)
    # a weight of zero stays zero at any time; a missing time never decays into anything
    rows = rows.withColumn("best", F.when(F.col("w") > 0, part).otherwise(F.lit(float("-inf"))))
    return merged(rows.withColumn("pending", F.when(F.col("observed_at") > _time(horizon), F.col("observed_at")))
                  .select(*KEY, "best", F.lit(1).cast("long").alias("n"), F.col("conflict").cast("long").alias("conflicts"), "artifact"))


def merged(*states: DataFrame) -> DataFrame:
    """One state of several."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    return both.groupBy(*KEY).agg(F.max("best").alias("best"), F.sum("n").alias("n"), F.sum("conflicts").alias("conflicts"), F.max("artifact").alias("artifact"))


def settled(state: DataFrame, horizon, cfg: ScoreConfig | None = None) -> DataFrame:
    """The state after its horizon moved on: rows it has passed are merged into their groups."""
    at = _time(horizon)
    return merged(state.withColumn("pending", F.when(F.col("pending") > at, F.col("pending"))))


def confidence_at(state: DataFrame, now, cfg: ScoreConfig | None = None) -> DataFrame:
    """subject, confidence, n_obs, n_conflicts, n_groups, artifact: what :func:`score.confidence` gives over all rows of the state."""
    cfg = cfg or ScoreConfig()
    at = _time(now)
    since = _half_lives(F.when(F.col("pending") > at, F.col("pending")).otherwise(at), cfg)
    w = F.least(F.greatest(F.pow(F.lit(2.0), F.col("best") - since), F.lit(0.0)), F.lit(fixed.WEIGHT_CAP))
    groups = state.withColumn("w", w).groupBy("subject", "grp").agg(
        F.max("w").alias("w"), F.sum("n").alias("n"), F.sum("conflicts").alias("conflicts"), F.max("artifact").alias("artifact"))
    return combine_groups(groups, cfg).drop("raw")
