"""One formula over the series of many sensors."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.audit import check_text
from sensorloom.functions.formula import formula_column, window_calls
from sensorloom.functions.ids import canonical_serial_id
from sensorloom.operators.sampling import most_buckets, sample_by
from sensorloom.operators.skew import SPLIT_ROWS
from sensorloom.operators.windows import rolling

ON_DEMAND_SUFFIX = "_ondemand_eval"
DEFAULT_INTERVAL = "1m"

_PREFIXED = re.compile(r"(?:P_|SN_)(\d+)")


def reading_scope(name: str):
    """What a name stands for next to one reading: value, state, or its own id in any spelling."""
    if name == "value":
        return F.col("value")
    if name == "state":
        return F.col("state").cast("bigint"), "long"
    serial = _PREFIXED.fullmatch(name)
    if serial:
        own = canonical_serial_id(F.col("sensor_id")) == serial.group(1)
    else:
        own = F.col("sensor_id") == name
    return F.when(own, F.col("value")), "double", True


def order_of(df: DataFrame) -> list[str]:
    """Arrival order inside a sensor: time, then arrival number where there is one."""
    return ["ts", "seq"] if "seq" in df.columns else ["ts"]


def apply_error_policy(df: DataFrame, result: Column, on_error: str) -> DataFrame:
    """Put `result` into `value`: drop failed rows, make them 0, or make them 0 and count them."""
    failed = result.isNull()
    if on_error == "drop":
        return df.withColumn("value", result).filter(F.col("value").isNotNull())
    if on_error not in ("zero", "count"):
        raise ValueError(f"unknown error policy {on_error!r}")
    number = F.when(failed | F.isnan(result), 0.0).otherwise(result)
    columns = {"value": number}
    if on_error == "count":
        columns["failed"] = failed.cast("int")
    return df.withColumns(columns)


def evaluate_series(
    df: DataFrame,
    expression: str,
    out_id: str | None = None,
    on_error: str = "drop",
    order: Iterable[str] | None = None,
    cap: int | None = None,
    dialect: str = "server",
    split_rows: int = SPLIT_ROWS,
    most_rows: float | None = None,
) -> DataFrame:
    """The formula at every reading of every sensor, with the sensor's own history.

    Time, state and inaccuracy flag stay; device columns are not carried over. `most_rows`
    bounds the rows per sensor where that is known, see `with_history`.
    """
    check_text(expression)
    calls = window_calls(expression)
    df = rolling(df, calls, order=order or order_of(df), cap=cap, dialect=dialect, split_rows=split_rows, most_rows=most_rows)
    windows = {call: F.col(call.column) for call in calls if call.column in df.columns}
    result = formula_column(expression, reading_scope, windows, dialect)
    computed = apply_error_policy(df, result, on_error)
    own = F.concat(F.col("sensor_id"), F.lit(ON_DEMAND_SUFFIX))
    kept = [c for c in ("seq", "ts", "value", "state", "has_inaccurate_data", "failed") if c in computed.columns]
    return computed.select(F.lit(out_id).alias("sensor_id") if out_id and out_id.strip() else own.alias("sensor_id"), *kept)


def range_of(df: DataFrame, sensor_id: str, start=None, end=None) -> DataFrame:
    """Readings of one sensor in a time range, both ends included."""
    picked = df.filter(F.col("sensor_id") == sensor_id)
    if start is not None:
        picked = picked.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        picked = picked.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return picked


def evaluate_on_demand(
    df: DataFrame, sensor_id: str, expression: str, start=None, end=None, every: str | None = DEFAULT_INTERVAL,
) -> DataFrame:
    """Range, sampling and formula of one sensor in one plan; `every=None` skips the sampling."""
    check_text(expression)
    picked = range_of(df, sensor_id, start, end)
    series = sample_by(picked, every) if every else picked
    most = most_buckets(start, end, every) if every else None
    return evaluate_series(series, expression, sensor_id + ON_DEMAND_SUFFIX, most_rows=most)
