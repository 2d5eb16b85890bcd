"""Session settings and lineage cuts shared by every job of the package."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings that may be put on any session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Largest row count of a side that is broadcast on purpose. Rows of the sides
# in question (rules, registry, hot keys) hold a few hundred bytes each.
BROADCAST_ROWS = 200_000
# Largest size of such a side, by the text of its rows.
BROADCAST_BYTES = 64 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    """Put the runtime settings on a session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    """A new session; `master` is left to the cluster's own settings when absent."""
    builder = SparkSession.builder.appName("sensorloom")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The join side with a broadcast hint if it holds at most `rows` rows and BROADCAST_BYTES.

    Beyond that the frame comes back as it is, and the join is a shuffled one in
    which adaptive execution splits skewed partitions.
    """
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    held = df.limit(rows + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if held["rows"] <= rows and held["bytes"] <= BROADCAST_BYTES else df


def shuffled(df: DataFrame) -> DataFrame:
    """The join side with a hint that keeps Spark from broadcasting it on an estimate.

    Estimates come from the size of files, which says little of tables that are made from few columns or compress well.
    """
    return df.hint("merge")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names; a local session without one, as in tests, gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="sensorloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint a frame so that loops do not grow the plan without end.

    The files lie in the folder that the cluster names. The frame is cached while it is written, as writing
    a checkpoint would compute it twice otherwise.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    held = df.persist()
    saved = held.checkpoint()
    held.unpersist()
    return saved
