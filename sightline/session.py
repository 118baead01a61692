"""Session settings and lineage cutting.

The library never decides a partition count from the data it happens to see in a
test: shuffle parallelism, skew splitting and join strategy are left to adaptive
execution, which is switched on here together with its skew-join rule.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "sightline", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or fetch) a session with the settings the operators are written for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Only where the session names none (tests on one machine) is a scratch folder
    created; on a cluster the setting has to point at shared storage, so that a
    checkpoint outlives the executor that wrote it.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY, None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured:
        master = sc.master or ""
        if not master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a shared folder before running iterative operators")
        configured = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


def stage_table(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows to the checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
