"""Helpers that the operators share: written stages, text digests, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows and bytes that one Arrow batch hands to Python at most; long texts make a batch end earlier.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024),
}


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at a time."""
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors see (`spark.checkpoint.dir`); a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back, so that later stages and lost executors don't compute them again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    """The text of a row; a null text is the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def digest(text: Column) -> Column:
    """16 bytes that stand for a text: the first half of its SHA-256."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of `edges` (a, b, both long): component is the smallest node reachable.

    Each round takes the smallest label among neighbours, then follows labels of labels, so a chain of n nodes
    takes about log n rounds. Rounds are written to the shared folder; only the number of changed labels comes
    to the driver. A node with very many neighbours is pre-aggregated before each shuffle.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("other")), "b")
        lowest = near.groupBy(F.col("a").alias("node")).agg(F.min("other").alias("lowest"))
        hooked = labels.join(lowest, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "lowest").alias("component"))
        # a label's own label; a label is itself a node, whose label can only be smaller
        targets = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        jumped = hooked.join(targets, "component").select(
            "node", F.least("component", "beyond").alias("component"), (F.least("component", "beyond") < F.col("was")).alias("changed"))
        # the parent takes over what its children have learnt
        raised = hooked.where("component < was").groupBy(F.col("was").alias("node")).agg(F.min("component").alias("heard"))
        after = stored(
            jumped.join(raised, "node", "left").select(
                "node", F.least("component", F.coalesce("heard", "component")).alias("component"),
                (F.col("changed") | F.coalesce(F.col("heard") < F.col("component"), F.lit(False))).alias("changed")),
            name)
        labels = after.select("node", "component")
        if after.where("changed").isEmpty():
            return labels
