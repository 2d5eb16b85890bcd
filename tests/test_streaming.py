import functools
import glob
import os
import tempfile
import time
from datetime import datetime

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.operators.rules import apply_rules, evaluate_rules, rule_counters
from sensorloom.sources.messages import file_records, read_sensor_stream
from sensorloom.sources.readings import read_readings, write_readings
from sensorloom.sources.rules import publish_rules, read_rule_stream
from sensorloom.streaming.evaluator import FILES_A_DAY, evaluate_records, evaluate_stream, stream_counters
from tests.helpers import readings, rules
from tests.test_rules import simulated

RULE_SCHEMA = "seq long, rule_id string, target_sensor_id string, expression string, derived_sensor_id string"


def drop_files(spark, df, folder, parts, first_time):
    """Write the rows as one file per range of `seq`, with file times far apart."""
    os.makedirs(folder, exist_ok=True)
    for number, (low, high) in enumerate(parts):
        part = df.filter(F.col("seq").between(low, high)).orderBy("seq").toPandas()
        if dict(df.dtypes).get("ts"):
            part["ts"] = part["ts"].dt.tz_localize("UTC").astype("datetime64[us, UTC]")
        name = os.path.join(folder, f"{number}.parquet")
        part.to_parquet(name, index=False)
        os.utime(name, (first_time + 100 * number,) * 2)


@pytest.mark.parametrize("retention", [1000, 3])
def test_stream_equals_batch(spark, retention):
    folder = tempfile.mkdtemp(prefix="run-")
    changes = [(3, "avg"), (9, "plain"), (12, "avg"), (15, "avg"), (30, "plain"), (31, "avg")]
    texts = {"avg": "window_avg(4)", "plain": "value * 2"}
    table = rules(spark, [(at, f"r{at}", "P_10001", texts[kind], "x") for at, kind in changes] + [(4, "bad", "10001", "a = 1", "x")])
    values = [float((i * 37) % 11) for i in range(40)]
    series = readings(spark, values).unionByName(readings(spark, values, "10002"))
    drop_files(spark, series, f"{folder}/readings", [(0, 13), (14, 39)], time.time() - 1000)
    drop_files(spark, table, f"{folder}/rules", [(0, 13), (14, 39)], time.time() - 1000)
    one = {"maxFilesPerTrigger": 1}
    reading_stream = spark.readStream.schema(schemas.ARRIVED_READING).options(**one).parquet(f"{folder}/readings")
    rule_stream = spark.readStream.schema(RULE_SCHEMA).options(**one).parquet(f"{folder}/rules")
    query = evaluate_stream(
        reading_stream, rule_stream, f"{folder}/out", f"{folder}/checkpoint", retention, live=False, counters=f"{folder}/counters",
    )
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    out = spark.read.parquet(f"{folder}/out")
    derived = out.filter("ord = 0").orderBy("seq").collect()
    expected = simulated(values, changes, retention)
    assert [(r["seq"], r["has_inaccurate_data"]) for r in derived] == [(e[0], e[2]) for e in expected]
    assert [r["value"] for r in derived] == pytest.approx([e[1] for e in expected])
    assert out.filter("ord = 1").count() == 80
    counted = spark.read.parquet(f"{folder}/counters").agg(F.sum("hits"), F.sum("misses"), F.sum("errors")).first()
    assert tuple(counted) == (len(expected), 80 - len(expected), 0)
    batch = apply_rules(series, table, as_of=True, retention_seconds=retention).filter("ord = 0").orderBy("seq").collect()
    assert [(r["seq"], r["sensor_id"]) for r in batch] == [(r["seq"], r["sensor_id"]) for r in derived]


def test_a_day_gets_few_files(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    series = [readings(spark, [1.0, 2.0], str(10001 + n)) for n in range(30)]
    drop_files(spark, functools.reduce(DataFrame.unionByName, series), f"{folder}/readings", [(0, 1)], time.time() - 1000)
    drop_files(spark, rules(spark, [(-1, "r", "10001", "value * 2", "x")]), f"{folder}/rules", [(-1, -1)], time.time() - 1000)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        query = evaluate_stream(
            spark.readStream.schema(schemas.ARRIVED_READING).parquet(f"{folder}/readings"),
            spark.readStream.schema(RULE_SCHEMA).parquet(f"{folder}/rules"), f"{folder}/out", f"{folder}/checkpoint", live=False)
        assert query.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert spark.read.parquet(f"{folder}/out").filter("ord = 1").count() == 60
    assert 1 < len(glob.glob(f"{folder}/out/date=*/batch=*/*.parquet")) <= FILES_A_DAY


def test_live_stream_holds_history(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    drop_files(spark, readings(spark, [1, 2, 3]), f"{folder}/readings", [(0, 2)], time.time() - 1000)
    drop_files(spark, rules(spark, [(-1, "r", "10001", "window_avg(2)", "x")]), f"{folder}/rules", [(-1, -1)], time.time() - 1000)
    reading_stream = spark.readStream.schema(schemas.ARRIVED_READING).parquet(f"{folder}/readings")
    rule_stream = spark.readStream.schema(RULE_SCHEMA).parquet(f"{folder}/rules")
    query = evaluate_stream(reading_stream, rule_stream, f"{folder}/out", f"{folder}/checkpoint", every="1 second")
    try:
        until = time.time() + 90
        while time.time() < until and not glob.glob(f"{folder}/out/date=*/batch=*/*.parquet"):
            time.sleep(1)
        time.sleep(1)
    finally:
        query.stop()
    rows = spark.read.parquet(f"{folder}/out").filter("ord = 0").orderBy("seq").collect()
    assert [r["value"] for r in rows] == [1.0, 1.5, 2.5]
    assert all(r["has_inaccurate_data"] for r in rows)


def test_write_readings(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    drop_files(spark, readings(spark, [1, 2, 3]), f"{folder}/in", [(0, 2)], time.time() - 1000)
    stream = spark.readStream.schema(schemas.ARRIVED_READING).parquet(f"{folder}/in")
    query = write_readings(stream, f"{folder}/out", f"{folder}/checkpoint", once=True)
    try:
        assert query.awaitTermination(60)
    finally:
        query.stop()
    assert read_readings(spark, f"{folder}/out").count() == 3
    assert os.path.isdir(f"{folder}/out/date=2024-01-01")


def test_job_from_records(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    sent = [(datetime(2024, 1, 1, 0, 0, n), f'[{{"sensorIndex":0,"value":{10 * n}}},{{"sensorIndex":1,"value":1}}]') for n in range(4)]
    told = [(datetime(2024, 1, 1, 0, 0, 1), '{"ruleId":"r","targetSensorId":"P_10001","expression":"window_avg(2) + 1","derivedSensorId":"P_10201"}')]
    for name, rows in (("sensors", sent), ("rules", told)):
        records = [(b"device-001", text.encode(), [], at, 0, n) for n, (at, text) in enumerate(rows)]
        spark.createDataFrame(records, schemas.RECORD).coalesce(1).write.parquet(f"{folder}/{name}")
    query = evaluate_records(
        file_records(spark, f"{folder}/sensors"), file_records(spark, f"{folder}/rules"), f"{folder}/out", f"{folder}/checkpoint", live=False,
    )
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    rows = spark.read.parquet(f"{folder}/out").orderBy("ts", "ord", "sensor_id").collect()
    assert [(r["sensor_id"], r["value"]) for r in rows] == [
        ("10001", 0.0), ("10002", 1.0), ("10201", 11.0), ("10001", 10.0), ("10002", 1.0), ("10201", 16.0), ("10001", 20.0),
        ("10002", 1.0), ("10201", 26.0), ("10001", 30.0), ("10002", 1.0),
    ]


def test_restart_goes_on_from_the_checkpoint(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    series = readings(spark, [float((i * 37) % 11) for i in range(30)])
    table = rules(spark, [(-1, "r", "10001", "window_avg(4) + window_max(6)", "x"), (22, "q", "10001", "value * 2", "x")])
    drop_files(spark, table, f"{folder}/rules", [(-1, 10)], time.time() - 1000)
    for number, (low, high) in enumerate([(0, 12), (13, 29)]):
        part = series.filter(F.col("seq").between(low, high)).coalesce(1)
        part.write.mode("append").parquet(f"{folder}/readings")
        if number:
            table.filter("seq = 22").coalesce(1).write.mode("append").parquet(f"{folder}/rules")
        query = evaluate_stream(
            spark.readStream.schema(schemas.ARRIVED_READING).parquet(f"{folder}/readings"),
            spark.readStream.schema(RULE_SCHEMA).parquet(f"{folder}/rules"), f"{folder}/out", f"{folder}/checkpoint", live=False,
        )
        try:
            assert query.awaitTermination(120)
        finally:
            query.stop()

    def rows(df):
        return sorted(tuple(r) for r in df.select("seq", "ord", "sensor_id", F.round("value", 6)).collect())

    assert rows(spark.read.parquet(f"{folder}/out")) == rows(apply_rules(series, table, as_of=True))


def test_observed_counters_over_restarts(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    series = readings(spark, [float(i % 7) for i in range(40)]).unionByName(readings(spark, [1.0] * 5, "10002")).unionByName(readings(spark, [2.0] * 6, "10003"))
    table = rules(spark, [(-1, "r", "10001", "value % 3 == 0 ? window_avg(4) : 10 / (value - value)", "x"), (-1, "s", "10003", "other + 1", "y")])
    drop_files(spark, table, f"{folder}/rules", [(-1, -1)], time.time() - 1000)
    for low, high in ((0, 12), (13, 30), (31, 39)):
        series.filter(F.col("seq").between(low, high)).coalesce(1).write.mode("append").parquet(f"{folder}/readings")
        query = evaluate_stream(
            spark.readStream.schema(schemas.ARRIVED_READING).parquet(f"{folder}/readings"),
            spark.readStream.schema(RULE_SCHEMA).parquet(f"{folder}/rules"), f"{folder}/out", f"{folder}/checkpoint", live=False, counters=f"{folder}/counters",
        )
        try:
            assert query.awaitTermination(120)
        finally:
            query.stop()
    assert spark.read.parquet(f"{folder}/counters").count() >= 3
    total = tuple(stream_counters(spark, f"{folder}/counters").first())
    assert total == tuple(rule_counters(evaluate_rules(series, table, as_of=True)).first())
    assert sum(total) == 51 and total[1] == 5 and total[2] >= 6


def test_streams_from_folders(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    table = rules(spark, [(0, "r", "10001", "value * 2", "x")]).withColumn("uses_window", F.lit(False))
    publish_rules(table, path=f"{folder}/published")
    record = spark.read.parquet(f"{folder}/published").select(
        "key", "value", F.array().cast(schemas.RECORD["headers"].dataType).alias("headers"), F.current_timestamp().alias("timestamp"),
        F.lit(0).alias("partition"), F.lit(1).cast("bigint").alias("offset"))
    record.write.parquet(f"{folder}/rules")
    told = read_rule_stream(spark, path=f"{folder}/rules")
    sent = read_sensor_stream(spark, path=f"{folder}/rules")
    assert told.isStreaming and sent.isStreaming and sent.schema.fieldNames() == schemas.RECORD.fieldNames()
    query = told.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(60)
    finally:
        query.stop()
    assert spark.read.parquet(f"{folder}/out").select("rule_id", "expression").collect() == [("r", "value * 2")]
