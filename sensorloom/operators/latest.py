"""Newest, oldest and listed readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.skew import first_rows

# Sizes of the buffer, the live view, the preview and the listing.
BUFFER_ROWS = 2000
LIVE_POINTS = 360
PREVIEW_ROWS = 100
LISTING_ROWS = 20


def _newest(df: DataFrame) -> list:
    return [F.desc("ts"), *([F.desc("seq")] if "seq" in df.columns else [])]


def with_device_columns(df: DataFrame) -> DataFrame:
    """Readings of an old table, which has no device columns, with these as nulls."""
    lacking = {"device_id": "string", "sensor_index": "int"}
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in lacking.items() if name not in df.columns})


def latest_points(df: DataFrame, n: int = 1) -> DataFrame:
    """The newest n readings of every sensor (at least one)."""
    return first_rows(with_device_columns(df), ["sensor_id"], _newest(df), max(n, 1))


def latest_of_sensor(df: DataFrame, sensor_id: str, n: int = 1) -> DataFrame:
    """The newest n readings of one sensor, oldest first."""
    picked = with_device_columns(df).filter(F.col("sensor_id") == sensor_id)
    newest = picked.orderBy(*_newest(df)).limit(max(n, 1))
    return newest.orderBy("ts", *(["seq"] if "seq" in df.columns else []))


def trailing_points(df: DataFrame, n: int = LIVE_POINTS) -> DataFrame:
    """The newest points of every sensor that a live view shows."""
    return first_rows(df, ["sensor_id"], _newest(df), n)


def range_scan(df: DataFrame, sensor_id: str, start, end, limit: int | None = None) -> DataFrame:
    """The readings of one sensor in a time range, both ends included, in order; the first `limit` of them if given."""
    bounds = F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    found = df.filter((F.col("sensor_id") == sensor_id) & bounds).orderBy("ts", *(["seq"] if "seq" in df.columns else []))
    return found if limit is None else found.limit(limit)


def range_head(df: DataFrame, start, end, limit: int) -> DataFrame:
    """The first `limit` readings of every sensor in a time range."""
    bounds = F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    order = [F.asc("ts"), *([F.asc("seq")] if "seq" in df.columns else [])]
    return first_rows(df.filter(bounds), ["sensor_id"], order, limit)


def buffer_read(df: DataFrame, limit: int | None = None, held: int = BUFFER_ROWS) -> DataFrame:
    """The oldest `limit` (all if not given) of the newest `held` readings of each sensor, by arrival."""
    named = df.filter(F.col("sensor_id").isNotNull())
    kept = first_rows(named, ["sensor_id"], [F.desc("seq")], held)
    if limit is None:
        return kept
    oldest = F.row_number().over(Window.partitionBy("sensor_id").orderBy("seq"))
    return kept.withColumn("_rank", oldest).filter(F.col("_rank") <= limit).drop("_rank")


def latest_listing(df: DataFrame, sensors: Sequence[str], limit: int = LISTING_ROWS) -> DataFrame:
    """The newest readings of several sensors together."""
    return df.filter(F.col("sensor_id").isin(list(sensors))).orderBy(*_newest(df)).limit(limit)


def preview(points: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first points of a run."""
    return points.orderBy("pos").limit(rows)
