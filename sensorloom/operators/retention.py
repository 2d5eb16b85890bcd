"""Removal of old readings."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: days that readings are kept.
RETENTION_DAYS = 30

_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


def retain(df: DataFrame, days: int = RETENTION_DAYS, today: date | Column | None = None) -> DataFrame:
    """Readings dated after the day that is `days` days back."""
    now = F.current_date() if today is None else F.lit(today).cast("date") if isinstance(today, date) else today
    return df.filter(F.to_date("ts") > F.date_sub(now, days))


def drop_old_partitions(
    spark: SparkSession, path: str, days: int = RETENTION_DAYS, today: date | None = None, mode: str = "day",
) -> list[str]:
    """Delete the day partition of `days` days ago, or with `mode="older"` also all before it.

    Returns the deleted days. A missing partition is fine, and only directories named
    `date=yyyy-MM-dd` are touched.
    """
    if mode not in ("day", "older"):
        raise ValueError(f"unknown mode {mode!r}")
    cutoff = ((today or date.today()) - timedelta(days=days)).isoformat()
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    deleted = []
    for status in files.listStatus(root):
        name = status.getPath().getName()
        day = name.removeprefix("date=")
        if not (name.startswith("date=") and _DAY.fullmatch(day) and status.isDirectory()):
            continue
        if day == cutoff or (mode == "older" and day < cutoff):
            files.delete(status.getPath(), True)
            deleted.append(day)
    return sorted(deleted)
