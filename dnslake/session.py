"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings a job session should carry.  AQE coalesces small shuffle partitions and splits skewed
#: ones at run time, so the shuffle partition count only has to be large enough.
JOB_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs one more shuffle behind it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Cut "first n per key" on the map side for any n used here.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


#: Settings that only count when the session starts.  Recording the call site of every column costs
#: more than building the column, which shows in jobs with hundreds of expressions.
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app: str = "dnslake", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**JOB_SETTINGS, **START_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Put the settings on a session somebody else started (all can change at run time)."""
    for key, value in JOB_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session (tests) may fall back to a temporary folder.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="dnslake-"))
        path = context.getCheckpointDir()
    return path


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint(eager=True)
