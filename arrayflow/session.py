"""Session settings and the shared folder that jobs cut lineage into."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build(app: str = "arrayflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; a given master overrides the submitted one."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a session on one machine may leave it unset and gets a temporary one."""
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if configured is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="arrayflow-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder, so that a lost executor cannot change sampled row placement."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
