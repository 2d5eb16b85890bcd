"""Bucketed averages with gaps filled from the bucket before."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.skew import explode_range, first_rows

INTERVAL = re.compile(r"([1-9][0-9]*)(s|m|h|d|w|ms|M|y)")
_MICROS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}

# Fixed value: buckets of an unbounded query.
TAIL_BUCKETS = 3600

_BLOCK = 65_536  # buckets of one sensor that are sorted together
_SHORT = 1_000_000  # a series of so many buckets needs no blocks


def parse_interval(every: str) -> tuple[int, str]:
    """`15m` as (15, "m"); anything else is an error."""
    match = INTERVAL.fullmatch(every or "")
    if not match:
        raise ValueError(f"not a sample interval: {every!r}")
    return int(match.group(1)), match.group(2)


def bucket_number(ts: Column, every: str) -> Column:
    """Number of the bucket of a moment, counted from the epoch."""
    count, unit = parse_interval(every)
    if unit == "M":
        return F.floor(((F.year(ts) - 1970) * 12 + F.month(ts) - 1) / count)
    if unit == "y":
        return F.floor((F.year(ts) - 1970) / count)
    width = count * _MICROS[unit]
    at = F.unix_micros(ts)
    return F.call_function("div", at - F.pmod(at, F.lit(width)), F.lit(width).cast("bigint"))


def bucket_start(number: Column, every: str) -> Column:
    """Start of a bucket."""
    count, unit = parse_interval(every)
    if unit in ("M", "y"):
        months = number * count * (1 if unit == "M" else 12)
        return F.add_months(F.lit("1970-01-01").cast("date"), months.cast("int")).cast("timestamp")
    return F.timestamp_micros(number * (count * _MICROS[unit]))


def sample_by(
    df: DataFrame,
    every: str,
    fill: str | None = "prev",
    keys: Iterable[str] = ("sensor_id",),
    start=None,
    end=None,
    last: int | None = None,
) -> DataFrame:
    """Per key and bucket: average value, highest state, whether any reading was inaccurate.

    `start` and `end` bound the readings (both included). With `fill="prev"` a bucket
    without readings repeats the one before. `last` keeps the newest buckets of each key.
    """
    keys = list(keys)
    parse_interval(every)
    if fill not in (None, "prev"):
        raise ValueError(f"unknown fill {fill!r}")
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    numbered = df.withColumn("_bucket", bucket_number(F.col("ts"), every))
    short = most_buckets(start, end, every) <= _SHORT
    numbered = numbered.withColumn("_block", F.lit(0) if short else F.floor(F.col("_bucket") / _BLOCK))
    buckets = numbered.groupBy(*keys, "_block", "_bucket").agg(
        F.avg("value").alias("value"),
        F.max("state").alias("state"),
        F.coalesce(F.bool_or("has_inaccurate_data"), F.lit(False)).alias("has_inaccurate_data"),
    )
    if last is not None:
        newest = buckets.groupBy(*keys).agg(F.max("_bucket").alias("_newest"))
        floor_ = F.col("_newest") - (last - 1)
    if fill == "prev":
        buckets = _until_next(buckets, short, keys)
        if last is not None:
            buckets = buckets.join(newest, keys).filter(F.col("_until") >= floor_)
            buckets = buckets.withColumn("_bucket", F.greatest(F.col("_bucket"), floor_))
        buckets = explode_range(buckets, F.col("_bucket"), F.col("_until"), "_bucket")
    elif last is not None:
        buckets = first_rows(buckets, keys, [F.desc("_bucket")], last)
    return buckets.select(
        *keys, bucket_start(F.col("_bucket"), every).alias("ts"), "value", "state", "has_inaccurate_data",
    )


def most_buckets_of(readings: DataFrame, every: str) -> float:
    """The most buckets that one key of a table can have: from the table's first and last time, which is one cheap aggregate."""
    row = readings.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    return most_buckets(row["first"], row["last"], every)


def most_buckets(start, end, every: str) -> float:
    """The most buckets that one key can have in a range."""
    count, unit = parse_interval(every)
    if start is None or end is None:
        return math.inf
    try:
        first, last = (x if isinstance(x, datetime) else datetime.fromisoformat(str(x)) for x in (start, end))
        width = count * _MICROS.get(unit, 28 * _MICROS["d"])
        return abs((last - first).total_seconds()) * 1_000_000 / width + 2
    except (ValueError, TypeError):
        return math.inf


def _until_next(buckets: DataFrame, one_block: bool, keys: list[str]) -> DataFrame:
    """Add `_until`, the last bucket before the next one that has readings.

    The next bucket is looked up inside blocks of consecutive buckets, and the first
    bucket of the following block comes from a small table made of the buckets, so that a
    long series is not sorted in one task.
    """
    inside = F.lead("_bucket").over(Window.partitionBy(*keys, "_block").orderBy("_bucket"))
    joined = buckets.withColumn("_next", inside)
    if one_block:
        joined = joined.withColumn("_after", F.lit(None).cast("bigint"))
    else:
        firsts = buckets.groupBy(*keys, "_block").agg(F.min("_bucket").alias("_first"))
        following = F.lead("_first").over(Window.partitionBy(*keys).orderBy("_block"))
        joined = joined.join(firsts.select(*keys, "_block", following.alias("_after")), [*keys, "_block"], "left")
    until = F.coalesce(F.coalesce(F.col("_next"), F.col("_after")) - 1, F.col("_bucket"))
    return joined.withColumn("_until", until).drop("_next", "_after", "_block")


def sampled_tail(df: DataFrame, every: str, keys: Iterable[str] = ("sensor_id",), last: int = TAIL_BUCKETS) -> DataFrame:
    """Sampled series without a range: the newest buckets of each sensor."""
    return sample_by(df, every, keys=keys, last=last)
