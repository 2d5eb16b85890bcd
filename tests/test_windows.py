"""Wide windows from blocks against row frames and plain code."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sensorloom.functions.formula import WindowCall
from sensorloom.operators import windows
from sensorloom.operators.windows import register_mergeable, rolling, window_over_history
from tests.helpers import readings

CALLS = [WindowCall(name, size) for name in ("avg", "max", "min", "rate", "deviation") for size in (1, 2, 7, 30, 64, 65, 1000)]


@pytest.fixture(autouse=True)
def deviation():
    parts = {"n": ("count", lambda v: v), "total": ("sum", lambda v: v), "squares": ("sum", lambda v: v * v)}
    register_mergeable("deviation", parts, lambda p: F.sqrt(F.greatest(F.lit(0.0), p["squares"] / p["n"] - (p["total"] / p["n"]) * (p["total"] / p["n"]))))


def series(spark):
    """Two sensors and rows without id, with nulls, NaN and several rows at one time."""
    rng = random.Random(5)
    values = [rng.choice([None, float("nan"), *range(-40, 60)]) for _ in range(330)]
    df = spark.createDataFrame([(i, str(i % 3) if i % 3 else None, None if v is None else float(v)) for i, v in enumerate(values)], "seq long, sensor_id string, value double")
    return df.withColumn("ts", F.timestamp_seconds((F.col("seq") / 5).cast("long")))


def close(a, b):
    return (a is None) == (b is None) and (a is None or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6))


def compared(spark, monkeypatch, **options):
    df = series(spark)
    frames = {r["seq"]: r for r in rolling(df, CALLS, **options).collect()}
    monkeypatch.setattr(windows, "WIDE", 1)
    blocks = rolling(df, CALLS, **options)
    assert blocks.columns == [*df.columns, *sorted(c.column for c in CALLS)] or set(blocks.columns) == {*df.columns, *(c.column for c in CALLS)}
    rows = blocks.collect()
    assert len(rows) == len(frames)
    for r in rows:
        for c in CALLS:
            assert close(r[c.column], frames[r["seq"]][c.column]), (c, r["seq"])


def test_blocks_equal_frames(spark, monkeypatch):
    compared(spark, monkeypatch)


def test_blocks_equal_frames_in_split_series(spark, monkeypatch):
    compared(spark, monkeypatch, split_rows=20, cap=50)


def test_wide_windows_shuffle_once(spark):
    plan = rolling(readings(spark, range(10)), [WindowCall("max", 5000), WindowCall("avg", 700)], most_rows=10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_wide_window_of_a_long_series(spark):
    n = 60_000
    df = spark.range(n).select(F.lit("a").alias("sensor_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"), ((F.col("id") * 7919) % 100_003).cast("double").alias("value"))
    got = rolling(df, [WindowCall("max", 20_000)], most_rows=n).agg(F.sum("window_max_20000")).first()[0]
    values, held, want = [i * 7919 % 100_003 for i in range(n)], [], 0
    for i, v in enumerate(values):  # a queue of falling values
        while held and values[held[-1]] <= v:
            held.pop()
        held.append(i)
        if held[0] <= i - 20_000:
            held.pop(0)
        want += values[held[0]]
    assert got == want


def test_mergeable_over_an_array(spark):
    df = spark.createDataFrame([([1.0, 3.0, 5.0],), ([],)], "h array<double>")
    got = [r[0] for r in df.select(window_over_history(WindowCall("deviation", 2), F.col("h"))).collect()]
    assert got == [1.0, 0.0]


def test_unknown_kind():
    with pytest.raises(ValueError, match="kinds"):
        register_mergeable("other", {"x": ("median", lambda v: v)}, lambda p: p["x"])
