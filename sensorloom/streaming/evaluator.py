"""The streaming job: readings and rules in, raw and derived readings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorloom.functions.formula import WindowCall
from sensorloom.functions.ids import is_blank
from sensorloom.operators.registry import rules_from_registry
from sensorloom.operators.rules import RETENTION_SECONDS, counter_columns, emit_raw_and_derived
from sensorloom.operators.templates import evaluate_shapes, shapes_of, with_shape
from sensorloom.operators.windows import known_windows, window_over_history
from sensorloom.sources.messages import arrival_number, decode_device_records
from sensorloom.sources.readings import stored_form
from sensorloom.sources.record_log import log_arrival
from sensorloom.sources.rules import parse_rules, publish_rules
from sensorloom.streaming.sliding import BUILT_IN
from sensorloom.streaming.state import with_rule_state

# State lives on disk and is saved as changes, not as a whole.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


# Files that a batch writes for a day at most; without a bound each task writes one for each day.
FILES_A_DAY = 8

COUNTERS = ["hits", "misses", "errors"]
_COUNTED = "batch long, hits long, misses long, errors long"


def configure_state(spark: SparkSession) -> SparkSession:
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def _window_column(call: WindowCall) -> Column | None:
    """The result that the state holds; 0 where the rule keeps no history."""
    if call.name not in known_windows():
        return None
    if call.name in BUILT_IN:
        key = F.lit(call.column)
        there = F.coalesce(F.map_contains_key("windows", key), F.lit(False))
        return F.when(there, F.try_element_at("windows", key)).otherwise(0.0)
    return window_over_history(call, F.coalesce("history", F.array().cast("array<double>")))


def evaluate_batch(stateful: DataFrame) -> DataFrame:
    """`result` for readings that carry their rule and window results: one Column per formula shape."""
    shaped = with_shape(stateful)
    return evaluate_shapes(shaped, shapes_of(shaped), _window_column)


def evaluate_stream(
    readings: DataFrame,
    rules: DataFrame,
    path: str,
    checkpoint: str,
    retention_seconds: float = RETENTION_SECONDS,
    live: bool = True,
    every: str = "10 seconds",
    counters: str | None = None,
) -> StreamingQuery:
    """Start the job; output goes to `path` by day and batch, counts to `counters` if given, see `stream_counters`.

    Counts are observed while the output is written, so they take no pass of their own. A batch that is run again after a failure replaces its own output. With `live=False`
    history ages by the readings' times and the query ends when the input is used up.
    """
    configure_state(readings.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        seen = Observation(f"rule counters {number}")
        evaluated = evaluate_batch(held).observe(seen, *counter_columns())
        rows = emit_raw_and_derived(evaluated).withColumn("batch", F.lit(number))
        stored = stored_form(rows, keep=["seq", "ord", "batch"])
        dealt = stored.repartition("date", F.pmod(F.hash("sensor_id"), F.lit(FILES_A_DAY)))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path)
        if counters:
            counted = batch.sparkSession.createDataFrame([(number, *(seen.get[c] for c in COUNTERS))], _COUNTED)
            counted.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(counters)
        held.unpersist()

    stateful = with_rule_state(readings, rules, retention_seconds, live)
    writer = stateful.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if live else writer.trigger(availableNow=True)
    return writer.start()


def stream_counters(spark: SparkSession, counters: str) -> DataFrame:
    """Hits, misses and errors of all batches so far, over restarts: a batch that was run again counts once."""
    held = spark.read.schema(_COUNTED).parquet(counters)
    return held.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])


def evaluate_records(
    sensor_records: DataFrame, rule_records: DataFrame, path: str, checkpoint: str, mappings: DataFrame | None = None,
    from_logs: bool = False, **options,
) -> StreamingQuery:
    """The whole job from record streams: decode messages and rules, number them, evaluate, write.

    `mappings` is the registry's table of device slots; `from_logs` says that both streams come from `log_records`,
    whose arrival numbers are unique; options as in `evaluate_stream`.
    """
    carried = ["timestamp", "offset", "partition"]

    def numbered(df: DataFrame) -> DataFrame:
        moment = F.col("timestamp")
        return df.withColumn("seq", log_arrival(moment, F.col("partition")) if from_logs else arrival_number(moment, F.col("offset")))

    readings = numbered(decode_device_records(sensor_records, mappings, carried))
    return evaluate_stream(readings, numbered(parse_rules(rule_records)), path, checkpoint, **options)


def resync_rules(registry: DataFrame, path: str | None = None, servers: str | None = None, topic: str | None = None) -> int:
    """Publish the rules of all active formula sensors again and return their number."""
    rules = rules_from_registry(registry).filter(~is_blank(F.col("expression")))
    publish_rules(rules, path, servers, topic)
    return rules.count()
