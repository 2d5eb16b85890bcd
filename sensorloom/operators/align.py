"""Several sensors side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.skew import SPLIT_ROWS, positions


def align_series(
    df: DataFrame,
    sensors: Sequence[str],
    duration: int | None = None,
    by: str = "position",
    missing: str = "truncate",
    clock: str | None = None,
    order: Sequence[str] | None = None,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """One row per step with one column per sensor.

    By position, step i takes the i-th reading of every sensor, and the series end with
    the shortest one or after `duration` steps. By time (`by="ts"`), a step is a moment
    at which all sensors have a reading; of several readings of a sensor at one moment the
    last in `order` counts. `clock` names the sensor whose time is kept.
    With `missing="zero"` a sensor without any reading counts as 0 and ends nothing.
    """
    sensors = list(dict.fromkeys(sensors))
    wanted = df.filter(F.col("sensor_id").isin(sensors))
    present = sensors
    if missing == "zero":  # at most one row per sensor of the formula set
        present = [r[0] for r in wanted.select("sensor_id").distinct().collect()]
    elif missing != "truncate":
        raise ValueError(f"unknown way to treat missing series {missing!r}")
    order = list(order or (["ts", "seq"] if "seq" in df.columns else ["ts"]))
    present_here = [F.coalesce(F.max(F.when(F.col("sensor_id") == s, 1)), F.lit(0)) for s in sensors]
    met = F.count("*") if by == "position" else sum(present_here[1:], present_here[0])
    if by == "position":
        placed = positions(wanted.select(*dict.fromkeys(["sensor_id", "value", *order, "ts"])), ["sensor_id"], order, "pos", split_rows)
        if duration is not None:
            placed = placed.filter(F.col("pos") < duration)
        key = "pos"
    elif by == "ts":
        placed, key = wanted, "_at"
        placed = placed.withColumn("_at", F.col("ts"))
    else:
        raise ValueError(f"cannot align by {by!r}")
    owner = clock or sensors[0]
    last = F.struct(*[F.col(c).alias(f"_{c}") for c in order], "value")

    def value_of(sensor: str):
        mine = F.col("sensor_id") == sensor
        if by == "position":  # one reading per sensor and step
            return F.max(F.when(mine, F.col("value"))).alias(sensor)
        return F.max(F.when(mine, last))["value"].alias(sensor)

    values = [value_of(s) for s in sensors]
    steps = placed.groupBy(key).agg(
        *values, F.max(F.when(F.col("sensor_id") == owner, F.col("ts"))).alias("ts"),
        met.alias("_n"),
    ).filter(F.col("_n") == len(present)).drop("_n")
    if missing == "zero":
        steps = steps.withColumns({s: F.coalesce(F.col(f"`{s}`"), F.lit(0.0)) for s in sensors})
    if by == "ts":
        whole = positions(steps.withColumn("_all", F.lit(0)), ["_all"], ["_at"], "pos", split_rows).drop("_all", "_at")
        steps = whole if duration is None else whole.filter(F.col("pos") < duration)
    return steps.select("pos", "ts", *[F.col(f"`{s}`") for s in sensors])


def decimate(df: DataFrame, step: int, pos: str = "pos") -> DataFrame:
    """Every step-th row, by position."""
    return df.filter(F.col(pos) % max(1, step) == 0)
