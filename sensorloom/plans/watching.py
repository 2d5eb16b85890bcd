"""Registered queries over rules, messages and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators import registry
from sensorloom.operators.rules import apply_rules, current_rules, evaluate_rules, match_rules, rule_counters, rules_as_of
from sensorloom.plans.registered import query
from sensorloom.plans.tables import SQL, Tables
from sensorloom.plans.values import fallback_sql
from sensorloom.session import shared_folder
from sensorloom.sources.messages import decode_device_records, rejected_records
from sensorloom.sources.rules import parse_rules, rule_records
from sensorloom.streaming.evaluator import evaluate_stream

# -- rules -------------------------------------------------------------------------
# Rule k: shape k % 7; 3 is no valid text and 5 names another sensor.
_USABLE = """usable AS (SELECT *, seq // 5 AS k, regexp_replace(target_sensor_id, '^(P_|SN_)', '') AS rule_key,
              contains(expression, 'window_') AS windowed FROM rules WHERE (seq // 5) % 7 <> 3)"""
_LAST = """last AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY rule_key ORDER BY seq DESC) = 1)"""


def _history(source: str, seconds: int, parts: str) -> str:
    """Windows over the last values of a run inside the retention time."""
    return f"""held AS (SELECT *, list({{'at': ts, 'v': value}}) OVER (PARTITION BY {parts} ORDER BY seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS held FROM {source}),
    windows AS (SELECT *, list_reverse(list_transform(list_filter(held, lambda h: h.at > ts - INTERVAL {seconds} SECOND), lambda h: h.v)) AS w FROM held)"""


_RESULT = """CASE k % 7 WHEN 0 THEN value * 1.5 + k % 10 WHEN 1 THEN list_avg(w[1:k % 5 + 1]) * 2.0 WHEN 2 THEN value - 3
             WHEN 4 THEN list_max(w[1:4]) + list_avg(w[1:2]) WHEN 6 THEN CASE WHEN value > 10 AND state = 0 THEN value / 4 ELSE 0 - value END END"""


def _run_sql(join: str, seconds: int, start: str) -> str:
    """Matched readings with run, history and result."""
    return f"""matched AS (SELECT r.*, u.k, u.rule_id, u.derived_sensor_id, coalesce(u.windowed, FALSE) AS windowed, coalesce(u.seq, -1) AS rule_from FROM readings r {join}),
    runs AS (SELECT *, sum(CASE WHEN windowed THEN 0 ELSE 1 END) OVER (PARTITION BY sensor_id ORDER BY seq) AS run FROM matched),
    begun AS (SELECT *, {start} OVER (PARTITION BY sensor_id, run, windowed) AS run_start FROM runs),
    {_history('begun', seconds, 'sensor_id, run, windowed')},
    results AS (SELECT *, {_RESULT} AS result, windowed AND ts - run_start < INTERVAL {seconds} SECOND AS young FROM windows)"""


_OUTPUT = """SELECT seq, CAST(0 AS INT) AS ord, coalesce(regexp_replace(derived_sensor_id, '^P_', ''), sensor_id || '_derived') AS sensor_id, device_id, sensor_index,
       epoch_us(ts) AS ts_us, round(result, 6) + 0.0 AS value, state, young AS has_inaccurate_data FROM results WHERE result IS NOT NULL
    UNION ALL SELECT seq, CAST(1 AS INT), sensor_id, device_id, sensor_index, epoch_us(ts), value, state, has_inaccurate_data FROM readings"""

_LATEST_RUNS = _run_sql("LEFT JOIN last u ON u.rule_key = r.sensor_id", 43200, "min(ts)")
_AS_OF_RUNS = _run_sql("ASOF LEFT JOIN usable u ON u.rule_key = r.sensor_id AND u.seq <= r.seq", 43200, "min(ts)")
HALF_DAY = 43200


@query(f"WITH {_USABLE}, {_LAST} SELECT rule_id, rule_key, seq FROM last")
def current_rule_per_target(t: Tables) -> DataFrame:
    return current_rules(t.rules).select("rule_id", "rule_key", "seq")


@query(f"WITH {_USABLE}, {_LAST} SELECT r.seq, r.sensor_id, l.rule_id FROM readings r LEFT JOIN last l ON l.rule_key = r.sensor_id")
def readings_with_current_rule(t: Tables) -> DataFrame:
    return match_rules(t.readings, t.rules).select("seq", "sensor_id", "rule_id")


@query(f"WITH {_USABLE} SELECT r.seq, r.sensor_id, u.rule_id FROM readings r ASOF LEFT JOIN usable u ON u.rule_key = r.sensor_id AND u.seq <= r.seq")
def readings_with_rule_as_of_arrival(t: Tables) -> DataFrame:
    return rules_as_of(t.readings, t.rules).select("seq", "sensor_id", "rule_id")


@query(f"WITH {_USABLE}, {_LAST}, {_LATEST_RUNS} {_OUTPUT}")
def apply_current_rules(t: Tables) -> DataFrame:
    return apply_rules(t.readings, t.rules, retention_seconds=HALF_DAY)


@query(f"WITH {_USABLE}, {_AS_OF_RUNS} {_OUTPUT}")
def apply_changing_rules(t: Tables) -> DataFrame:
    return apply_rules(t.readings, t.rules, as_of=True, retention_seconds=HALF_DAY)


@query(f"""WITH {_USABLE}, {_history('readings', HALF_DAY, 'sensor_id')},
    results AS (SELECT w.seq, u.rule_id, {_RESULT} AS result FROM windows w JOIN usable u ON u.rule_key = w.sensor_id)
    SELECT seq, rule_id, round(result, 6) + 0.0 AS result FROM results WHERE result IS NOT NULL""")
def apply_all_rules_of_each_target(t: Tables) -> DataFrame:
    done = evaluate_rules(t.readings, t.rules, multi=True, retention_seconds=HALF_DAY)
    return done.filter(F.col("result").isNotNull()).select("seq", "rule_id", "result")


@query(f"""WITH {_USABLE}, matched AS (SELECT r.seq, u.k FROM readings r ASOF LEFT JOIN usable u ON u.rule_key = r.sensor_id AND u.seq <= r.seq)
    SELECT count(*) FILTER (k % 7 <> 5) AS hits, count(*) FILTER (k IS NULL) AS misses, count(*) FILTER (k % 7 = 5) AS errors FROM matched""")
def rule_evaluation_counts(t: Tables) -> DataFrame:
    return rule_counters(evaluate_rules(t.readings, t.rules, as_of=True))


@query("""SELECT serial AS seq, 'rule_' || sensor_code AS rule_id, trim(formula_expression) AS expression, contains(formula_expression, 'window_') AS uses_window,
          coalesce(nullif(regexp_extract(formula_expression, '\\b(?:P_|SN_)?\\d{4,6}\\b'), ''), '10001') AS target_sensor_id, CAST(serial AS STRING) AS derived_sensor_id
          FROM registry WHERE sensor_type = 'FORMULA' AND status = 'ACTIVE' AND trim(formula_expression) <> ''""")
def rules_of_registry(t: Tables) -> DataFrame:
    return registry.rules_from_registry(t.registry)


@query("SELECT count(*) AS published FROM registry WHERE sensor_type = 'FORMULA' AND status = 'ACTIVE' AND trim(formula_expression) <> ''")
def published_rule_count(t: Tables) -> DataFrame:
    return registry.rule_count(t.registry)


# The JSON form of every rule, written and read again.
@query("SELECT rule_id, target_sensor_id, expression, contains(expression, 'window_') AS uses_window, derived_sensor_id, target_sensor_id AS record_key FROM rules")
def rules_as_records(t: Tables) -> DataFrame:
    rules = t.rules.withColumn("uses_window", F.col("expression").contains("window_"))
    records = rule_records(rules).withColumn("record_key", F.col("key").cast("string"))
    return parse_rules(records)


# -- messages ------------------------------------------------------------------------
# Shapes by seq % 8: list of two items, one item, envelope, finished reading, empty, malformed, unknown, bad number.
def _records(t: Tables) -> DataFrame:
    kind = F.col("seq") % 8
    item = F.struct(F.col("sensor_index").alias("sensorIndex"), "value", F.when(F.col("state") == 1, "down").otherwise("normal").alias("status"))
    second = F.struct((F.col("sensor_index") + 1).alias("sensorIndex"), (F.col("value") + 1).alias("value"), F.lit("DOWN").alias("status"))
    head = F.struct(F.col("device_id").alias("deviceId"), F.unix_millis("ts").alias("timestamp"))
    reading = F.struct(F.col("sensor_id").alias("sensorId"), "value", "state", F.col("has_inaccurate_data").alias("hasInaccurateData"))
    text = (
        F.when(kind == 0, F.to_json(F.array(item, second))).when(kind == 1, F.to_json(item))
        .when(kind == 2, F.to_json(F.struct(head.alias("header"), F.array(item).alias("body"))))
        .when(kind == 3, F.to_json(reading)).when(kind == 4, F.lit(" ")).when(kind == 5, F.substr(F.to_json(item), F.lit(1), F.lit(12)))
        .when(kind == 6, F.to_json(F.struct(F.col("value").alias("reading")))).otherwise(F.lit('[{"sensorIndex":1,"value":"high"}]'))
    )

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value"))

    # The device comes by header or by key, the time as milliseconds or as local text.
    local = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.when(F.col("seq") % 16 < 8, F.unix_millis("ts").cast("string")).otherwise(local)
    headers = F.when(F.col("seq") % 3 == 0, F.array(header("deviceId", F.lit("other")), header("deviceId", F.col("device_id")), header("timestamp", stamp)))
    headers = headers.otherwise(F.array(header("timestamp", stamp)))
    return t.readings.select(
        "seq", F.lower("device_id").cast("binary").alias("key"), text.cast("binary").alias("value"), headers.alias("headers"),
        F.col("ts").alias("timestamp"),
    )


@query(f"""
    WITH known AS (SELECT device_id AS dev, device_sensor_index AS idx, serial FROM registry WHERE sensor_type = 'PHYSICAL'),
    told AS (SELECT *, CASE WHEN seq % 16 < 8 THEN epoch_us(ts) // 1000 * 1000 ELSE epoch_us(ts) // 1000000 * 1000000 END AS stamp,
                    CASE WHEN seq % 3 = 0 THEN device_id ELSE lower(device_id) END AS dev FROM readings),
    items AS (SELECT seq, 0 AS item_number, dev AS device_id, sensor_index, stamp AS ts_us, value, state FROM told WHERE seq % 8 IN (0, 1)
        UNION ALL SELECT seq, 1, dev, sensor_index + 1, stamp, value + 1, 1 FROM told WHERE seq % 8 = 0
        UNION ALL SELECT seq, 0, device_id, sensor_index, epoch_us(ts) // 1000 * 1000, value, state FROM told WHERE seq % 8 = 2)
    SELECT i.seq, CAST(item_number AS INT) AS item_number, CAST(coalesce(serial, {fallback_sql('upper(device_id)', 'sensor_index')}) AS STRING) AS sensor_id, device_id, sensor_index,
           ts_us, round(value, 6) + 0.0 AS value, CAST(state AS INT) AS state, FALSE AS has_inaccurate_data FROM items i LEFT JOIN known ON dev = upper(device_id) AND idx = sensor_index
    UNION ALL SELECT seq, 0, sensor_id, dev, NULL, stamp, value, state, has_inaccurate_data FROM told WHERE seq % 8 = 3""")
def decoded_messages(t: Tables) -> DataFrame:
    return decode_device_records(_records(t), registry.mapping_table(t.registry), ["seq"])


@query("SELECT seq, CASE seq % 8 WHEN 4 THEN 'empty' WHEN 6 THEN 'unknown_shape' ELSE 'malformed' END AS reason FROM readings WHERE seq % 8 >= 4")
def rejected_messages(t: Tables) -> DataFrame:
    return rejected_records(_records(t)).select("seq", "reason")


# -- the stream ------------------------------------------------------------------------
@query(f"WITH {_USABLE}, {_AS_OF_RUNS} {_OUTPUT}")
def stream_with_changing_rules(t: Tables) -> DataFrame:
    """Both tables as streams through the stateful job, read back from its output."""
    spark = t.spark
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"

    def stream(name: str, made: str) -> DataFrame:
        table = spark.readStream.schema(t.given(name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)
        return spark.sql(SQL[made].replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: table})

    query_ = evaluate_stream(
        stream("events", "readings"), stream("part", "rules"), f"{folder}/out", f"{folder}/checkpoint", HALF_DAY, live=False,
    )
    try:
        query_.awaitTermination()
    finally:
        query_.stop()
    out = spark.read.parquet(f"{folder}/out")
    return out.select("seq", "ord", "sensor_id", "device_id", "sensor_index", "ts", "value", "state", "has_inaccurate_data")
