"""Windows in the stream's state."""

import math
import random
import tempfile
import time

from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.functions.formula import WindowCall
from sensorloom.operators.rules import apply_rules
from sensorloom.operators.windows import LOWEST, register_window
from sensorloom.streaming.evaluator import configure_state, evaluate_batch
from sensorloom.streaming.sliding import Running, Windows
from sensorloom.streaming.state import with_rule_state
from tests.helpers import readings, rules
from tests.test_streaming import RULE_SCHEMA, drop_files


def plain(name, values):
    numbers = [v for v in values if v is not None and not math.isnan(v)]
    if name == "avg":
        return None if None in values else sum(values) / len(values)
    if name == "rate":
        if len(values) < 2 or values[0] == 0:
            return 0.0
        return None if values[0] is None or values[-1] is None else (values[-1] - values[0]) / values[0] * 100
    return {"max": max([*numbers, LOWEST]), "min": min(numbers, default=math.nan)}[name]


def same(a, b):
    return a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, abs_tol=1e-9)))


def test_windows_against_plain_code():
    rng = random.Random(2)
    for _ in range(30):
        values, windows, first = [], None, 0
        windows = Windows(values)
        calls = [WindowCall(n, s) for n in ("avg", "max", "min", "rate") for s in (1, 3, 10, 500)]
        for at in range(120):
            values.append(rng.choice([None, math.nan, 0.0, *map(float, range(-9, 9))]) if rng.random() < 0.4 else float(rng.randrange(100)))
            first = min(at, first + rng.randrange(3))  # values get too old
            for c in calls if rng.random() < 0.8 else calls[:5]:  # a rule may come back later
                assert same(windows.result(c, first), plain(c.name, values[max(first, at + 1 - c.size):])), (c, at)


def test_work_per_entry_is_constant():
    merges = [0]

    def merge(a, b):
        merges[0] += 1
        return max(a, b)

    held, n, size = Running(merge, 0), 20_000, 5000
    for i in range(n):
        held.push(i * 7919 % 10_007)
        held.advance(i + 1 - size)
        held.total()
    assert merges[0] <= 4 * n


def test_only_results_leave_the_state(spark):
    register_window("range", lambda v: F.array_max(v) - F.array_min(v))
    folder = tempfile.mkdtemp(prefix="run-")
    series = readings(spark, [float((i * 37) % 101) for i in range(400)]).unionByName(readings(spark, [1.0, 5.0, 2.0], "10002"))
    table = rules(spark, [(-1, "r", "10001", "window_avg(300) + window_max(350)", "x"), (-1, "s", "10002", "window_range(2) + window_min(3)", "y")])
    drop_files(spark, series, f"{folder}/readings", [(0, 150), (151, 399)], time.time() - 1000)
    drop_files(spark, table, f"{folder}/rules", [(-1, -1)], time.time() - 1000)
    configure_state(spark)

    def write(batch, number):
        evaluate_batch(batch).write.mode("append").parquet(f"{folder}/out")

    stateful = with_rule_state(
        spark.readStream.schema(schemas.ARRIVED_READING).option("maxFilesPerTrigger", 1).parquet(f"{folder}/readings"),
        spark.readStream.schema(RULE_SCHEMA).parquet(f"{folder}/rules"), 3600, False)
    query = stateful.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(180)
    finally:
        query.stop()
    out = spark.read.parquet(f"{folder}/out")
    sizes = out.groupBy("rule_key").agg(F.max(F.size("windows")).alias("results"), F.max(F.size("history")).alias("values")).collect()
    assert sorted((r["rule_key"], r["results"], r["values"]) for r in sizes) == [("10001", 2, None), ("10002", 1, 2)]
    got = {(r["sensor_id"], r["seq"]): round(r["result"], 6) for r in out.collect()}
    batch = apply_rules(series, table, as_of=True).filter("ord = 0").collect()
    assert got == {({"x": "10001", "y": "10002"}[r["sensor_id"]], r["seq"]): round(r["value"], 6) for r in batch}
