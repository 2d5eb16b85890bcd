import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.functions import ids
from sensorloom.operators.registry import resolve_serials
from sensorloom.sources.messages import decode_device_records, rejected_records
from sensorloom.sources.rules import parse_rules, rule_records

MS = 1729152000000


def records(spark, rows):
    """Rows of (value, headers, key)."""
    data = []
    for n, (value, headers, key) in enumerate(rows):
        heads = [(k, v.encode()) for k, v in headers.items()]
        text = value if value is None or isinstance(value, str) else json.dumps(value)
        data.append((key and key.encode(), None if text is None else text.encode(), heads, datetime(2024, 1, 1), 0, n))
    return spark.createDataFrame(data, schemas.RECORD)


@pytest.fixture(scope="module")
def mappings(spark):
    rows = [("DEVICE-001", 5, 10005), ("DEVICE-001", 99, 10099), ("DEVICE-002", 12, 10112), ("DEVICE-003", 7, 10207)]
    return spark.createDataFrame(rows, "device_id string, sensor_index int, serial bigint")


def test_shapes(spark, mappings):
    head = {"deviceId": "DEVICE-001", "timestamp": str(MS)}
    df = records(spark, [
        ([{"sensorIndex": 5, "value": 24.5, "status": "normal"}, {"sensorIndex": 99, "value": 1, "status": "down"}], head, None),
        ({"header": {"deviceId": "DEVICE-002", "timestamp": 1729153000000}, "body": [{"sensorIndex": 12, "value": 78.4}]}, head, None),
        ({"sensorIndex": 7, "value": 3.5, "status": "DOWN"}, {"timestamp": "2026-10-18T22:45"}, "DEVICE-003"),
        ({"sensorId": "10001", "value": 9.0, "hasInaccurateData": True}, {}, None),
        ([], head, None), ("", head, None), (None, head, None), ("{bad", head, None), ({"x": 1}, head, None),
        ([{"sensorIndex": 1, "value": "abc"}], head, None), ([{"sensorIndex": 1, "extra": 2}], head, None),
    ])
    out = decode_device_records(df, mappings, ["offset"]).withColumn("ms", F.unix_millis("ts"))
    rows = [tuple(r) for r in out.orderBy("offset", "item_number").select(
        "offset", "sensor_id", "device_id", "sensor_index", "ms", "value", "state", "has_inaccurate_data").collect()]
    local = int(datetime(2026, 10, 18, 22, 45).timestamp() - datetime(1970, 1, 1).timestamp()) * 1000
    assert rows == [
        (0, "10005", "DEVICE-001", 5, MS, 24.5, 0, False), (0, "10099", "DEVICE-001", 99, MS, 1.0, 1, False),
        (1, "10112", "DEVICE-002", 12, 1729153000000, 78.4, 0, False), (2, "10207", "DEVICE-003", 7, local, 3.5, 1, False),
        (3, "10001", "DEVICE-DEFAULT", None, 1704067200000, 9.0, 0, True),
    ]
    reasons = {r["offset"]: r["reason"] for r in rejected_records(df).collect()}
    assert reasons == {5: "empty", 6: "empty", 7: "malformed", 8: "unknown_shape", 9: "malformed", 10: "malformed"}


def test_zone(spark):
    df = records(spark, [({"sensorIndex": 0, "value": 1}, {"timestamp": "2024-01-01 09:00:00"}, "D-1")])
    assert decode_device_records(df, zone="Asia/Seoul").select(F.unix_millis("ts")).first()[0] == 1704067200000


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, x {kind}")
    return [r[0] for r in df.orderBy("n").select(make(F.col("x"))).collect()]


def test_ids(spark):
    assert column(spark, ["P_10001", "SN_10001", " 10001 ", "P_x", "sensor_1", None], ids.canonical_serial_id) == [
        "10001", "10001", "10001", "P_x", "sensor_1", None]
    assert column(spark, ["10001", "P_10001", "SN_7", "TEMP_RAW"], ids.counterpart_serial_id) == ["P_10001", "10001", "7", None]
    assert column(spark, [" device-001 ", None, " "], ids.normalize_device_id) == ["DEVICE-001", "DEVICE-DEFAULT", "DEVICE-DEFAULT"]
    assert column(spark, ["P_10001", "99999999999999999999", "x"], ids.parse_serial) == [10001, None, None]
    assert column(spark, ["P_10001 * 1.8 + 32", "window_avg(10) + 10002", "value * 2.0", None], ids.target_sensor_of) == [
        "P_10001", "10002", "10001", "10001"]
    assert column(spark, ["value * 1000", "SN_10003 + 5000"], lambda c: ids.target_sensor_of(c, strict=True)) == ["10001", "SN_10003"]
    assert column(spark, ["P_10004 + 1", "a + sensor_012", "x"], ids.primary_sensor_of) == ["10004", "sensor_012", "10001"]
    parsed = column(spark, ["dev-1#5", "dev:7", "#5", "dev#", "dev#x", "a:1#2", "d# 3 ", "d#99999999999"], ids.parse_composite_id)
    assert [p and tuple(p) for p in parsed] == [("DEV-1", 5), ("DEV", 7), None, None, None, ("A:1", 2), ("D", 3), None]
    assert column(spark, ["P_10201", None, " "], lambda c: ids.output_sensor_id(c, F.lit("10001"))) == ["10201", "10001_derived", "10001_derived"]


def java_hash(text):
    h = 0
    units = text.encode("utf-16-be")
    for c in (int.from_bytes(units[i:i + 2]) for i in range(0, len(units), 2)):
        h = (h * 31 + c) & 0xFFFFFFFF
    return h - 2 ** 32 if h >= 2 ** 31 else h


def test_fallback(spark):
    names = ["device-001", "device-002", "device-000", "pump", "compressor-main-unit", "d99999999999999999999", "größe", "pump-🙂"]
    found = column(spark, names, lambda c: ids.fallback_serial(c, F.lit(0)))
    hashed = [500000 + (abs(java_hash(n.upper())) % 500 + 1) * 1000 + 1 for n in names[3:]]
    assert found == [10001, 11001, 10001, *hashed]


def test_registered_before_fallback(spark, mappings):
    slots = spark.createDataFrame([("device-001", 5), ("DEVICE-001", 6)], "device_id string, sensor_index int")
    assert {r["sensor_index"]: r["serial"] for r in resolve_serials(slots, mappings).collect()} == {5: 10005, 6: 10007}


def test_rule_records(spark):
    rules = spark.createDataFrame([("r", "P_1", "value", False, None), ("s", None, "value", False, "1")], schemas.RULE)
    sent = rule_records(rules)
    assert [json.loads(r["value"].decode()) for r in sent.collect()] == [
        {"ruleId": "r", "targetSensorId": "P_1", "expression": "value", "usesWindow": False, "derivedSensorId": None}]
    assert parse_rules(sent).collect()[0].asDict() == dict(zip(schemas.RULE.fieldNames(), ("r", "P_1", "value", False, None)))
