import os
import tempfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.functions import times
from sensorloom.operators import formulas as formula_jobs
from sensorloom.operators import latest, registry
from sensorloom.operators.composite import evaluate_composite
from sensorloom.operators.formulas import default_formulas
from sensorloom.operators.retention import drop_old_partitions
from sensorloom.operators.rules import apply_rules
from sensorloom.operators.sampling import bucket_start, parse_interval, sample_by
from sensorloom.operators.skew import first_rows, positions
from sensorloom.sources import exports, readings as store
from sensorloom.sources.rules import parse_rules
from sensorloom.streaming.evaluator import resync_rules
from tests.helpers import formulas, readings


@pytest.mark.parametrize("text", ["1s", "15m", "1h", "2d", "1w", "500ms", "3M", "1y"])
def test_intervals(text):
    assert parse_interval(text)


@pytest.mark.parametrize("text", ["0s", "1", "m", "-1s", "1 m", "1m; drop", "", None, "1S"])
def test_bad_intervals(text):
    with pytest.raises(ValueError):
        parse_interval(text)


def test_sampling(spark):
    series = readings(spark, [1, 3, 5]).unionByName(readings(spark, [9], first_seq=9)).withColumn(
        "ts", F.timestamp_seconds(F.when(F.col("seq") == 9, 1000).otherwise(F.col("seq") * 10)))
    rows = [(r["ts"].timestamp() - datetime(1970, 1, 1).timestamp(), r["value"]) for r in sample_by(series, "20s").orderBy("ts").collect()]
    assert rows[:3] == [(0.0, 2.0), (20.0, 5.0), (40.0, 5.0)] and rows[-1] == (1000.0, 9.0) and len(rows) == 51
    assert sample_by(series, "20s", fill=None).count() == 3
    assert sample_by(series, "20s", last=5).count() == 5
    months = spark.range(1).select(bucket_start(F.lit(7).cast("bigint"), "3M").cast("string")).first()[0]
    assert months == "1971-10-01 00:00:00"


def test_long_gaps_over_block_borders(spark):
    series = readings(spark, [1, 2, 3], step=200_000)
    filled = sample_by(series, "1s")
    assert filled.count() == 400_001
    assert [r["count"] for r in filled.groupBy("value").count().orderBy("value").collect()] == [200_000, 200_000, 1]


def test_positions_of_hot_keys(spark):
    df = readings(spark, range(200), step=0.001).unionByName(readings(spark, range(5), "10002"))
    rows = positions(df, ["sensor_id"], ["ts", "seq"], split_rows=7).collect()
    assert all(r["pos"] == r["value"] for r in rows) and len(rows) == 205


def test_first_rows_beyond_the_threshold(spark):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "3")
    try:
        rows = first_rows(readings(spark, range(50)), ["sensor_id"], [F.desc("ts")], 10).collect()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert sorted(r["value"] for r in rows) == [float(v) for v in range(40, 50)]


def test_latest(spark):
    series = readings(spark, range(10))
    assert [r["value"] for r in latest.latest_of_sensor(series, "10001", 3).collect()] == [7.0, 8.0, 9.0]
    assert [r["value"] for r in latest.latest_of_sensor(series, "10001", 0).collect()] == [9.0]
    held = latest.buffer_read(readings(spark, range(2050)).unionByName(series.withColumn("sensor_id", F.lit(None).cast("string"))), 2)
    assert sorted(r["value"] for r in held.collect()) == [50.0, 51.0]
    points = spark.range(500).withColumnRenamed("id", "pos")
    assert latest.preview(points).count() == 100


def test_table_of_readings(spark):
    folder = tempfile.mkdtemp(prefix="run-") + "/readings"
    assert store.table_or_empty(spark, folder).count() == 0
    store.ingest_batch(None, folder)
    series = readings(spark, range(4), step=86_400)
    store.ingest_batch(series, folder)
    store.ingest_batch(readings(spark, [7], sensor=None, device=" "), folder, cluster=False)
    stored = store.table_or_empty(spark, folder)
    assert stored.count() == 5
    assert stored.filter("sensor_id = ''").first()["device_id"] is None
    plan = stored.filter("date = DATE'2024-01-02' AND sensor_id = '10001'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(sensor_id,10001)" in plan
    assert drop_old_partitions(spark, folder, 30, date(2024, 2, 1)) == ["2024-01-02"]
    assert drop_old_partitions(spark, folder, 30, date(2024, 2, 1)) == []
    assert drop_old_partitions(spark, folder, 30, date(2024, 2, 2), mode="older") == ["2024-01-01", "2024-01-03"]
    assert sorted(os.path.basename(p) for p in os.listdir(folder) if p.startswith("date=")) == ["date=2024-01-04"]
    store.discard(series)


def test_exports(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    table = default_formulas(spark)
    exports.export_formulas(table, f"{folder}/formulas")
    merged, count = exports.import_formulas(spark, f"{folder}/formulas", table.limit(0))
    assert merged.count() == 5 and count.first()["imported"] == 5
    with open(f"{folder}/array.json", "w") as file:
        file.write('[\n {"id": "A", "name": "a", "expression": "value"},\n {"id": "B", "name": "b"}\n]')
    merged, count = exports.import_formulas(spark, f"{folder}/array.json", table)
    assert merged.count() == 6 and count.first()["imported"] == 1
    points = evaluate_composite(readings(spark, range(30)), table, "NORMALIZED_HEAT")
    exports.export_simulation_csv(points, f"{folder}/csv", "10001", "NORMALIZED_HEAT", ["TEMP_FAHRENHEIT", "NORMALIZED_HEAT"])
    rows = spark.read.option("header", True).csv(f"{folder}/csv")
    assert rows.columns == ["index", "timestamp", "sensor_10001", "TEMP_FAHRENHEIT", "computed_result"]
    assert rows.count() == 30 and rows.filter("index = 10").first()["computed_result"] == "9.5"


def test_registry_life(spark):
    seeded = registry.seed_registry(spark.createDataFrame([], schemas.REGISTRY)).persist()
    assert [r["serial"] for r in seeded.orderBy("serial").collect()] == list(range(10001, 10010))
    assert registry.seed_registry(seeded).count() == 9
    mapped = {(r["device_id"], r["sensor_index"]): r["serial"] for r in registry.mapping_table(seeded).collect()}
    assert mapped["DEVICE-002", 0] == 10003
    rules = registry.rules_from_registry(seeded)
    assert {r["rule_id"]: r["target_sensor_id"] for r in rules.collect()} == {
        "rule_FML-PUMP-EFF-01": "P_10002", "rule_FML-THERMAL-DELTA": "P_10001", "rule_TEMP_FAHRENHEIT": "P_10001",
        "rule_SMOOTHED_TEMP": "10001", "rule_POWER_EFFICIENCY_INDEX": "10001",
    }
    derived = apply_rules(readings(spark, [100.0]), rules.filter("seq = 10007")).filter("ord = 0").collect()
    assert [(r["sensor_id"], r["value"]) for r in derived] == [("10007", 212.0)]
    synced = registry.sync_devices(spark.createDataFrame([("DEVICE-001", 4), ("new one", 0)], "device_id string, sensor_count int"), seeded)
    assert [(r["serial"], r["sensor_code"]) for r in synced.orderBy("serial").collect()] == [
        (10010, "PHY-DEVICE001-S002"), (10011, "PHY-DEVICE001-S003"), (10012, "PHY-NEWONE-S000")]
    with pytest.raises(ValueError):
        registry.delete_sensors(seeded, spark.createDataFrame([(1,)], "serial long"))
    with pytest.raises(ValueError):
        registry.update_sensors(seeded, spark.createDataFrame([(1, "x")], "serial long, sensor_name string"))
    folder = tempfile.mkdtemp(prefix="run-") + "/rules"
    assert resync_rules(seeded, folder) == 5
    assert parse_rules(spark.read.parquet(folder)).count() == 5


def test_formula_table(spark):
    table = default_formulas(spark)
    more = formulas(spark, [(" new-one ", "value"), ("smoothed_temp", "value")])
    assert formula_jobs.add_formulas(table, more).count() == 6
    with pytest.raises(ValueError):
        formula_jobs.update_formulas(table, formulas(spark, [("NONE", "value")]))
    copied = formula_jobs.copy_formulas(table.unionByName(formulas(spark, [("SMOOTHED_TEMP_COPY", "value")])), table.select("id"))
    assert {r["id"] for r in copied.collect()} >= {"SMOOTHED_TEMP_COPY_2", "TEMP_FAHRENHEIT_COPY"}


def test_recent_range(spark):
    start, end = spark.range(1).select(*times.recent_range(3600)).first()
    assert (end - start).total_seconds() == 3600


def test_formula_sync_broadcasts_nothing_unasked(spark):
    known = spark.createDataFrame(
        [(f"F{k}", 20001 + k, f"f {k}", "value", "General", None) for k in range(6)],
        "id string, serial long, name string, expression string, category string, target_sensor string")
    changed = spark.createDataFrame(
        [(20003, "F2", "f 2", "FORMULA", "General", "P_10007 + 1", None), (20099, "new 1", "n", "FORMULA", "General", "value * 3", None)],
        "serial long, sensor_code string, sensor_name string, sensor_type string, category string, formula_expression string, description string")
    synced = formula_jobs.apply_formula_sync(known, changed).select("id", "expression", "target_sensor")
    assert "Broadcast" not in synced._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in synced.collect()} == {
        *((f"F{k}", "value", None) for k in range(6) if k != 2), ("F2", "P_10007 + 1", "10007"), ("NEW_1", "value * 3", "10001")}
