"""Results must not depend on how work is split, on nulls, or on how often something is listed."""

import math
import tempfile

import pytest
from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.functions.formula import FormulaError, WindowCall, parse_formula
from sensorloom.operators import catalog, formulas, registry
from sensorloom.operators.align import align_series
from sensorloom.operators.rules import apply_rules
from sensorloom.operators.skew import SPLIT_ROWS, first_rows, positions
from sensorloom.operators.windows import rolling
from sensorloom.sources import exports
from sensorloom.streaming.evaluator import evaluate_stream
from tests.helpers import readings, rules
from tests.helpers import formulas as formula_table


def gappy(spark):
    """One hot sensor and one without id; some readings without time, some at one time."""
    hot = readings(spark, [(i * 37) % 11 for i in range(60)])
    hot = hot.withColumn("ts", F.when(F.col("seq") % 5 != 0, F.date_trunc("minute", "ts") + F.expr("make_interval(0,0,0,0,0,0, seq div 3)")))
    return hot.unionByName(hot.withColumn("sensor_id", F.lit(None).cast("string")))


def values(df, *columns):
    rows = [tuple("nan" if x != x else x for x in r) for r in df.select(*columns).collect()]
    return sorted(rows, key=repr)


def test_split_equals_unsplit(spark):
    rows = gappy(spark)
    call = WindowCall("avg", 4)
    for size in (5, 17):
        assert values(positions(rows, ["sensor_id"], ["ts", "seq"], split_rows=size), "sensor_id", "seq", "pos") == values(
            positions(rows, ["sensor_id"], ["ts", "seq"]), "sensor_id", "seq", "pos")
        assert values(rolling(rows, [call], split_rows=size), "sensor_id", "seq", call.column) == values(rolling(rows, [call]), "sensor_id", "seq", call.column)
    two = rows.unionByName(readings(spark, range(40), "10002"))
    whole = values(align_series(two, ["10001", "10002"]), "pos", "10001", "10002")
    assert len(whole) == 40 and values(align_series(two, ["10001", "10002"], split_rows=7), "pos", "10001", "10002") == whole


def test_rules_split_equal_unsplit(spark):
    rows = gappy(spark)
    table = rules(spark, [(3, "r", "P_10001", "window_avg(3) + 1", "x"), (30, "q", "P_10001", "window_max(2)", "y")])
    for as_of in (False, True):
        columns = ["seq", "ord", "sensor_id", "value"]
        assert values(apply_rules(rows, table, as_of=as_of, split_rows=6), *columns) == values(apply_rules(rows, table, as_of=as_of), *columns)


def test_no_cap_unless_asked_for(spark):
    series = readings(spark, range(300))
    call = WindowCall("avg", 250)
    assert rolling(series, [call]).orderBy(F.desc("seq")).first()[call.column] == sum(range(50, 300)) / 250
    assert rolling(series, [call], cap=100).orderBy(F.desc("seq")).first()[call.column] == sum(range(200, 300)) / 100


def test_one_moment_twice(spark):
    rows = readings(spark, [1, 2], step=0).unionByName(readings(spark, [5], "10002"))
    assert [tuple(r)[2:] for r in align_series(rows, ["10001", "10002"], by="ts").collect()] == [(2.0, 5.0)]


def test_first_rows_shuffles_once(spark):
    plan = first_rows(readings(spark, range(50)), ["sensor_id"], [F.desc("ts")], 1500)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("WindowGroupLimit") > 0
    spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_changes_never_multiply_rows(spark):
    known = registry.seed_registry(spark.createDataFrame([], schemas.REGISTRY))
    serial = known.first()["serial"]
    twice = spark.createDataFrame([(serial, 1, "a", None), (serial, 2, None, "u")], "serial long, n int, sensor_name string, unit string")
    with pytest.raises(ValueError):
        registry.update_sensors(known, twice.drop("n"))
    done = registry.update_sensors(known, twice, order="n")
    assert done.count() == known.count() and done.filter(F.col("serial") == serial).select("sensor_name", "unit").first() == ("a", "u")
    table = formula_table(spark, [("A", "value"), ("B", "value * 2")])
    changes = spark.createDataFrame([("A", 1, "1"), ("A", 2, "2")], "id string, n int, expression string")
    with pytest.raises(ValueError):
        formulas.update_formulas(table, changes.drop("n"))
    assert values(formulas.update_formulas(table, changes, order="n"), "id", "expression") == [("A", "2"), ("B", "value * 2")]


def test_slots_and_codes_of_one_request_table(spark):
    none = spark.createDataFrame([], schemas.REGISTRY)
    fields = "request_id long, sensor_type string, sensor_name string, sensor_code string, category string, unit string, device_id string, device_sensor_index int, formula_expression string, description string, status string"
    asked = spark.createDataFrame([(n, "PHYSICAL", "x", None, None, None, d, 0, None, None, None) for n, d in enumerate([" D1", "D1", "D1 "])], fields)
    assert registry.create_sensors(asked, none).count() == 1
    devices = spark.createDataFrame([("DEV-1", 1), ("DEV1", 1), ("dev_1", 2), ("DEV-1 ", 3), ("BIG", 1001)], "device_id string, sensor_count int")
    made = registry.sync_devices(devices, none)
    assert made.count() == 3 + 1 + 2 + 1001
    assert made.select("sensor_code").distinct().count() == made.count() == made.select("device_id", "device_sensor_index").distinct().count()


def test_lookup_with_a_code_in_use_twice(spark):
    row = registry.seed_registry(spark.createDataFrame([], schemas.REGISTRY))
    double = row.unionByName(row.withColumn("serial", F.col("serial") + 1000))
    code = row.first()["sensor_code"]
    found = catalog.lookup_sensor_meta(spark.createDataFrame([(code,)], "sensor_id string"), double, catalog.registry_to_catalog(double)).collect()
    assert len(found) == 1 and found[0]["found_by"] == "code" and found[0]["meta"]["serial"] == row.first()["serial"]


def test_mixed_import_files(spark, tmp_path):
    item = '{{"id":"{0}","name":"n","expression":"value"}}'
    (tmp_path / "array.json").write_text("\n [" + ",\n".join(item.format(x) for x in "ABC") + "]")
    (tmp_path / "lines.json").write_text("\n".join(item.format(x) for x in "DEF"))
    (tmp_path / "more.json").write_text('[{"id":"G","name":"n","expression":"value","serialNumber":7,"targetSensor":"10001","description":"d","createdAt":"2024-01-01T00:00:00Z"}]')
    table, imported = exports.import_formulas(spark, str(tmp_path), formula_table(spark, [("A", "1")]))
    assert imported.first()["imported"] == 7 and table.count() == 7
    last = table.filter("id = 'G'").first()
    assert (last["serial"], last["target_sensor"], last["description"], last["created_at"].year) == (7, "10001", "d", 2024)


@pytest.mark.parametrize("text", ["value if value > 1 else 2", "value > 1 and value < 9 ? 1 : 0", "not value", "None", "True", "value is 1", "lambda"])
def test_words_of_python(text):
    with pytest.raises(FormulaError):
        parse_formula(text)


def test_stream_keeps_nan_and_readings_without_id(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    series = readings(spark, [math.nan if i == 2 else i for i in range(6)])
    series = series.withColumn("value", F.when(F.col("seq") != 4, F.col("value")))
    series = series.unionByName(readings(spark, [7.0], sensor=None, first_seq=50))
    table = rules(spark, [(0, "r", "P_10001", "window_avg(2) + window_max(3)", "x")])
    for name, df in (("series", series), ("rules", table)):
        df.coalesce(1).write.parquet(f"{folder}/{name}")
    stream = lambda name, df: spark.readStream.schema(df.schema).parquet(f"{folder}/{name}")
    query = evaluate_stream(stream("series", series), stream("rules", table), f"{folder}/out", f"{folder}/checkpoint", live=False)
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    columns = ["seq", "ord", "sensor_id", "value"]
    stored = spark.read.parquet(f"{folder}/out").withColumn("sensor_id", F.when(F.col("sensor_id") != "", F.col("sensor_id")))  # stored as empty text
    assert values(stored, *columns) == values(apply_rules(series, table, as_of=True), *columns)


def test_rules_of_changes(spark):
    before = registry.seed_registry(spark.createDataFrame([], schemas.REGISTRY))
    assert registry.rules_of_changes(before, before).count() == 0
    one = before.filter("sensor_type = 'FORMULA'").orderBy("serial").first()["serial"]
    change = spark.createDataFrame([(one, "value * 3")], "serial long, formula_expression string")
    assert [r["expression"] for r in registry.rules_of_changes(before, registry.update_sensors(before, change)).collect()] == ["value * 3"]
    off = spark.createDataFrame([(one, "INACTIVE")], "serial long, status string")
    assert registry.rules_of_changes(before, registry.update_sensors(before, off)).count() == 0


def largest_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_split_keys_fill_tasks_evenly(spark):
    rows = readings(spark, [i % 37 for i in range(4000)])
    calls = [WindowCall("max", 300), WindowCall("rate", 5)]
    split = rolling(rows, calls, split_rows=400)
    names = [c.column for c in calls]
    assert values(split, "seq", *names) == values(rolling(rows, calls), "seq", *names)
    # windows of 300 rows make chunks of 300 rows; no task gathers chunks for being small in bytes
    assert largest_task(split) <= 1600
    assert largest_task(positions(rows, ["sensor_id"], ["ts", "seq"], split_rows=400)) <= 1600


def test_a_task_of_usual_size():
    assert SPLIT_ROWS <= 1_000_000  # wide windows take about 1 KB a row


def test_aligned_by_the_value_too(spark):
    two = readings(spark, range(40)).unionByName(readings(spark, range(100, 150), "10002"))
    whole = values(align_series(two, ["10001", "10002"], order=["ts", "value"]), "pos", "10001", "10002")
    assert len(whole) == 40
    assert values(align_series(two, ["10001", "10002"], order=["ts", "value"], split_rows=7), "pos", "10001", "10002") == whole
