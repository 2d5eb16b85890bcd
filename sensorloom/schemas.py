"""Schemas of the tables and messages."""

from pyspark.sql import types as T

READING = T.StructType([
    T.StructField("sensor_id", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("sensor_index", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("state", T.IntegerType()),
    T.StructField("has_inaccurate_data", T.BooleanType()),
])

# A reading with its arrival number, as the order-dependent jobs use it.
ARRIVED_READING = T.StructType([T.StructField("seq", T.LongType()), *READING.fields])

RULE = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("target_sensor_id", T.StringType()),
    T.StructField("expression", T.StringType()),
    T.StructField("uses_window", T.BooleanType()),
    T.StructField("derived_sensor_id", T.StringType()),
])

# Field names of a rule as they stand in its JSON text.
RULE_JSON = "ruleId string, targetSensorId string, expression string, usesWindow boolean, derivedSensorId string"

REGISTRY = T.StructType([
    T.StructField("serial", T.LongType()),
    T.StructField("sensor_code", T.StringType()),
    T.StructField("sensor_name", T.StringType()),
    T.StructField("sensor_type", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("device_sensor_index", T.IntegerType()),
    T.StructField("formula_expression", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

FORMULA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("serial", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("expression", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("target_sensor", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("sensor_code", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

# Names of these fields in JSON files, besides their own.
FORMULA_JSON = {
    "serialNumber": "serial", "targetSensor": "target_sensor", "sensorCode": "sensor_code", "createdAt": "created_at", "updatedAt": "updated_at",
}

# One transport record as the message source delivers it.
RECORD = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("headers", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()),
        T.StructField("value", T.BinaryType()),
    ]))),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
])

ITEM = "sensorIndex int, value double, status string"
ITEM_LIST = f"array<struct<{ITEM}>>"
