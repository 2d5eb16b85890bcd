"""Rules in and out as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.sources.messages import file_records, kafka_records

_NAMES = {
    "ruleId": "rule_id", "targetSensorId": "target_sensor_id", "expression": "expression",
    "usesWindow": "uses_window", "derivedSensorId": "derived_sensor_id",
}


def parse_rules(records: DataFrame, column: str = "value") -> DataFrame:
    """Rules from JSON texts; texts that are no JSON objects are left out."""
    rule = F.from_json(F.col(column).cast("string"), schemas.RULE_JSON)
    kept = [c for c in records.columns if c not in (column, "key")]
    valid = F.json_object_keys(F.col(column).cast("string")).isNotNull()
    parsed = records.filter(valid).withColumn("_rule", rule)
    return parsed.select(*kept, *[F.col(f"_rule.{name}").alias(alias) for name, alias in _NAMES.items()])


def read_rule_stream(spark: SparkSession, path: str | None = None, servers: str | None = None, topic: str | None = None, starting: str = "earliest") -> DataFrame:
    """Rules from a Kafka topic, or from a folder of record files when `path` is given.

    Starting from the earliest record makes a new job see all rules published so far.
    """
    return parse_rules(file_records(spark, path) if path else kafka_records(spark, servers, topic, starting))


def rule_records(rules: DataFrame) -> DataFrame:
    """Rules as records: the target sensor as key, the JSON text as value."""
    fields = [F.col(alias).alias(name) for name, alias in _NAMES.items()]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    kept = rules.filter(F.col("target_sensor_id").isNotNull())
    return kept.select(F.col("target_sensor_id").cast("binary").alias("key"), text.cast("binary").alias("value"))


def publish_rules(rules: DataFrame, path: str | None = None, servers: str | None = None, topic: str | None = None) -> None:
    """Append the rules to a Kafka topic, or as a record file to a folder when `path` is given."""
    records = rule_records(rules)
    if path:
        records.write.mode("append").parquet(path)
    else:
        records.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
