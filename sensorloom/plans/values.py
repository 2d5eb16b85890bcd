"""Registered queries over identifiers, times, numbers, categories and rule texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import categories, ids, numbers, times
from sensorloom.functions.audit import audit_rules, usable_rules, uses_window
from sensorloom.operators import catalog, registry
from sensorloom.plans.registered import query
from sensorloom.plans.tables import Tables

# The 32-bit hash of a name and the fallback serial, as DuckDB text.
_HASH = """list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)),
                       lambda h, c: (h * 31 + c) % 4294967296)"""
_FALLBACK = """CASE WHEN regexp_matches({0}, '\\d$')
    THEN 10000 + greatest(0, CAST(regexp_extract({0}, '(\\d+)$', 1) AS BIGINT) - 1) * 1000
    ELSE 500000 + (abs(CASE WHEN {h} > 2147483647 THEN {h} - 4294967296 ELSE {h} END) % 500 + 1) * 1000 END + {1} + 1"""


def fallback_sql(device: str, index: str) -> str:
    return _FALLBACK.format(device, index, h=_HASH.format(device))


@query("""
    SELECT n, trim(raw) AS trimmed,
           regexp_replace(trim(raw), '^(?:P_|SN_)(\\d+)$', '\\1') AS canonical,
           CASE WHEN regexp_full_match(trim(raw), '\\d+') THEN 'P_' || trim(raw)
                WHEN regexp_full_match(trim(raw), '(P_|SN_)\\d+') THEN regexp_extract(trim(raw), '(\\d+)$', 1) END AS counterpart,
           CAST(CASE WHEN regexp_full_match(trim(raw), '(P_|SN_)?\\d+') THEN regexp_extract(trim(raw), '(\\d+)$', 1) END AS BIGINT) AS serial,
           coalesce(nullif(upper(trim(raw)), ''), 'DEVICE-DEFAULT') AS device
    FROM raw_ids""")
def sensor_id_spellings(t: Tables) -> DataFrame:
    raw = F.col("raw")
    return t.raw_ids.select(
        "n", F.trim(raw).alias("trimmed"), ids.canonical_serial_id(raw).alias("canonical"),
        ids.counterpart_serial_id(raw).alias("counterpart"), ids.parse_serial(raw).alias("serial"),
        ids.normalize_device_id(raw).alias("device"),
    )


@query("""
    WITH cut AS (SELECT n, raw, CASE WHEN strpos(raw, '#') > 0 THEN strpos(raw, '#') ELSE strpos(raw, ':') END AS cut_at FROM raw_ids)
    SELECT n, upper(trim(substr(raw, 1, cut_at - 1))) AS device_id, CAST(substr(raw, cut_at + 1) AS INT) AS sensor_index,
           upper(trim(substr(raw, 1, cut_at - 1))) || '#' || substr(raw, cut_at + 1) AS composite
    FROM cut WHERE cut_at > 1 AND regexp_full_match(substr(raw, cut_at + 1), '\\d+')""")
def composite_ids(t: Tables) -> DataFrame:
    parsed = t.raw_ids.withColumn("slot", ids.parse_composite_id(F.col("raw"))).filter(F.col("slot").isNotNull())
    device, index = F.col("slot.device_id"), F.col("slot.sensor_index")
    return parsed.select("n", device.alias("device_id"), index.alias("sensor_index"), ids.composite_id(device, index).alias("composite"))


_KEEP = f"""
    WITH named AS (SELECT n, trim(raw) AS s, raw, CASE WHEN strpos(trim(raw), '#') > 0 THEN strpos(trim(raw), '#') ELSE strpos(trim(raw), ':') END AS cut_at FROM raw_ids),
    slots AS (SELECT *, CASE WHEN cut_at > 1 AND regexp_full_match(substr(s, cut_at + 1), '\\d+') AND NOT s LIKE 'P\\_%' ESCAPE '\\' THEN upper(trim(substr(s, 1, cut_at - 1))) END AS device,
              CASE WHEN cut_at > 1 AND regexp_full_match(substr(s, cut_at + 1), '\\d+') THEN CAST(substr(s, cut_at + 1) AS INT) END AS idx FROM named),
    known AS (SELECT device_id, device_sensor_index, serial FROM registry WHERE sensor_type = 'PHYSICAL')
    SELECT n, CASE WHEN device IS NOT NULL THEN CAST(coalesce(k.serial, {fallback_sql('device', 'idx')}) AS STRING)
                   WHEN regexp_full_match(s, '\\d+|(P_|SN_).*') THEN s ELSE raw END AS sensor_id
    FROM slots LEFT JOIN known k ON k.device_id = device AND k.device_sensor_index = idx"""


@query(_KEEP)
def resolve_or_keep_ids(t: Tables) -> DataFrame:
    return registry.resolve_or_keep(t.raw_ids, registry.mapping_table(t.registry), "raw", "sensor_id").select("n", "sensor_id")


@query(f"""
    SELECT s_suppkey, {fallback_sql("upper(trim(s_name))", "5")} AS by_name,
           {fallback_sql("upper(n_name)", "s_nationkey")} AS by_nation
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def fallback_serials(t: Tables) -> DataFrame:
    joined = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(
        "s_suppkey", ids.fallback_serial(F.col("s_name"), F.lit(5)).alias("by_name"),
        ids.fallback_serial(F.col("n_name"), F.col("s_nationkey")).alias("by_nation"),
    )


@query("""
    SELECT id, coalesce(nullif(regexp_extract(expression, '\\b(?:P_|SN_)?\\d{4,6}\\b'), ''), target_sensor, '10001') AS target,
           coalesce(nullif(regexp_extract(expression, '\\b(?:P_|SN_)\\d{4,6}\\b'), ''), target_sensor, '10001') AS strict_target,
           coalesce(nullif(regexp_extract(expression, '\\b(?:P_|SN_)?(\\d{4,6})\\b', 1), ''),
                    nullif(regexp_extract(expression, '(?i)\\b(sensor_\\d+)\\b', 1), ''), '10001') AS primary_sensor
    FROM formulas""")
def target_sensors(t: Tables) -> DataFrame:
    text, own = F.col("expression"), F.col("target_sensor")
    return t.formulas.select(
        "id", ids.target_sensor_of(text, own).alias("target"), ids.target_sensor_of(text, own, strict=True).alias("strict_target"),
        ids.primary_sensor_of(text).alias("primary_sensor"),
    )


@query("""
    SELECT rule_id, coalesce(regexp_replace(derived_sensor_id, '^P_', ''), target_sensor_id || '_derived') AS stream_id,
           target_sensor_id || '_ondemand_eval' AS on_demand_id,
           'P_' || CAST(300001 + seq AS STRING) AS prefixed FROM rules""")
def output_ids(t: Tables) -> DataFrame:
    target = F.col("target_sensor_id")
    return t.rules.select(
        "rule_id", ids.output_sensor_id(F.col("derived_sensor_id"), target).alias("stream_id"),
        ids.output_sensor_id(F.lit(None), target, "_ondemand_eval").alias("on_demand_id"),
        ids.prefixed_serial(F.col("seq") + 300001).alias("prefixed"),
    )


@query("""
    SELECT event_type, CAST(CASE WHEN lower(CASE WHEN event_type = 'error' THEN 'DOWN' ELSE event_type END) = 'down' THEN 1 ELSE 0 END AS INT) AS state,
           count(*) AS n FROM events GROUP BY event_type""")
def status_states(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "DOWN").otherwise(F.col("event_type"))
    return t.events.select("event_type", ids.status_to_state(status).alias("state")).groupBy("event_type", "state").agg(F.count("*").alias("n"))


@query("""
    SELECT seq, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000 * 1000000 AS ns, epoch_us(ts) // 1000 AS back,
           epoch_us(ts) // 1000 AS kept FROM readings""")
def epoch_numbers(t: Tables) -> DataFrame:
    ms = F.unix_millis("ts")
    ns = times.millis_to_nanos(ms)
    return t.readings.select(
        "seq", ms.alias("ms"), ns.alias("ns"), times.epoch_number_to_millis(ns).alias("back"), times.epoch_number_to_millis(ms).alias("kept"),
    )


@query("""
    WITH whole AS (SELECT seq, epoch_us(date_trunc('second', ts)) AS us, epoch_us(ts) AS full_us FROM readings)
    SELECT seq, CASE seq % 4 WHEN 0 THEN full_us WHEN 1 THEN us - 9 * 3600000000 WHEN 2 THEN us - 9 * 3600000000 ELSE 0 END AS parsed_us FROM whole""")
def parsed_times(t: Tables) -> DataFrame:
    kind = F.col("seq") % 4
    text = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(kind == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("yesterday"))
    )
    return t.readings.select("seq", times.parse_timestamp(text, "Asia/Seoul", F.timestamp_micros(F.lit(0))).alias("parsed"))


@query("""
    SELECT seq, strftime(ts + INTERVAL 9 HOUR, '%H:%M:%S') AS clock, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS date_time,
           strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') AS iso, epoch_us(ts + INTERVAL 9 HOUR) AS local_us,
           epoch_us(ts) AS round_trip_us FROM readings""")
def local_times(t: Tables) -> DataFrame:
    ts, zone = F.col("ts"), "Asia/Seoul"
    local = times.to_local(ts, zone)
    return t.readings.select(
        "seq", times.format_local_time(ts, zone).alias("clock"), times.format_local_date_time(ts, zone).alias("date_time"),
        times.format_local_iso(ts, zone).alias("iso"), local.alias("local"), times.from_local(local, zone, ts).alias("round_trip"),
    )


@query("""
    SELECT seq, floor(value * 100 + 0.5) / 100 AS two, floor((0 - value) * 10 + 0.5) / 10 + 0.0 AS below,
           least(greatest(value, 10.0), 20.0) AS clamped, greatest(0.0, value - 4.0 * 2.5) AS low, value + 4.0 * 2.5 AS high FROM readings""")
def rounding_and_clamping(t: Tables) -> DataFrame:
    value = F.col("value")
    low, high = numbers.clamp_bounds(value, F.lit(2.5))
    return t.readings.select(
        "seq", numbers.round_half_up(value, 2).alias("two"), numbers.round_half_up(-value, 1).alias("below"),
        numbers.clamp(value, F.lit(10.0), F.lit(20.0)).alias("clamped"), low.alias("low"), high.alias("high"),
    )


@query("""
    WITH labelled AS (SELECT p_partkey, ['Temperature', 'Pressure', 'Vibration', 'Electrical', 'Flow', 'Mechanical', 'Environmental'][p_partkey % 7 + 1] AS category,
                      p_brand, p_size FROM part)
    SELECT p_partkey, category, CASE category WHEN 'Temperature' THEN '°C' WHEN 'Pressure' THEN 'bar' WHEN 'Vibration' THEN 'mm/s'
               WHEN 'Electrical' THEN 'kW' WHEN 'Flow' THEN 'm³/h' WHEN 'Mechanical' THEN 'RPM' ELSE '%' END AS unit,
           'PHY-' || upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || '-S' || printf('%03d', p_size) AS code,
           regexp_replace(upper(trim(' ' || p_brand || ' x')), '[^A-Z0-9_]', '_', 'g') AS clean_id, 'FML-' || CAST(p_partkey AS STRING) AS formula_code,
           CASE category WHEN 'Temperature' THEN 65.0 WHEN 'Pressure' THEN 100.0 WHEN 'Vibration' THEN 12.0 WHEN 'Electrical' THEN 220.0
               WHEN 'Flow' THEN 45.0 ELSE 50.0 END::DOUBLE AS mean,
           CASE category WHEN 'Electrical' THEN 'V' WHEN 'Flow' THEN 'L/min' WHEN 'Temperature' THEN '°C' WHEN 'Pressure' THEN 'bar'
               WHEN 'Vibration' THEN 'mm/s' WHEN 'Mechanical' THEN 'RPM' ELSE '%' END AS profile_unit
    FROM labelled""")
def categories_and_codes(t: Tables) -> DataFrame:
    category = categories.default_category(F.col("p_partkey"))
    profile = categories.category_profile(category)
    return t.part.select(
        "p_partkey", category.alias("category"), categories.default_unit(category).alias("unit"),
        categories.sensor_code(F.col("p_brand"), F.col("p_size")).alias("code"),
        categories.clean_formula_id(F.concat(F.lit(" "), "p_brand", F.lit(" x"))).alias("clean_id"),
        categories.formula_code(F.col("p_partkey")).alias("formula_code"),
        profile["mean"].alias("mean"), profile["unit"].alias("profile_unit"),
    )


@query("""
    WITH cleaned AS (SELECT serial, id, name, category, expression, target_sensor FROM formulas)
    SELECT upper(r.sensor_code) AS id, r.serial, r.sensor_name AS name,
           coalesce(nullif(r.formula_expression, ''), 'value * 1.0') AS expression, r.category,
           coalesce(nullif(regexp_extract(r.formula_expression, '\\b(?:P_|SN_)?(\\d{4,6})\\b', 1), ''),
                    nullif(regexp_extract(r.formula_expression, '(?i)\\b(sensor_\\d+)\\b', 1), ''), '10001') AS target_sensor
    FROM registry r WHERE r.sensor_type = 'FORMULA'""")
def registry_formulas(t: Tables) -> DataFrame:
    return catalog.registry_to_formulas(t.registry).select("id", "serial", "name", "expression", "category", "target_sensor")


# -- rule texts ------------------------------------------------------------------
_TEXTS = """
        SELECT p_partkey AS n, CASE p_partkey % 12 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN repeat('value + ', 60) || p_name || ' + 1.0' || repeat(' ', 30)
            WHEN 3 THEN 'a = ' || CAST(p_size AS STRING) WHEN 4 THEN p_brand || ' + value' WHEN 5 THEN 'exec(' || CAST(p_size AS STRING) || ')'
            WHEN 6 THEN 'value >= ' || CAST(p_size AS STRING) || ' ? window_avg(3) : 0' WHEN 7 THEN 'A == 100 && B != ' || CAST(p_size AS STRING)
            WHEN 8 THEN 'new ' || p_type WHEN 9 THEN 'previous_value + renewal' WHEN 10 THEN 'val[' || CAST(p_size AS STRING) || ']'
            ELSE 'value <= 10 || state == ' || CAST(p_size AS STRING) END AS expression FROM part"""


@query(f"""
    WITH texts AS ({_TEXTS}),
    judged AS (SELECT n, coalesce(trim(expression), '') = '' AS fails_empty, coalesce(length(expression) > 500, FALSE) AS fails_too_long,
        coalesce(NOT regexp_full_match(expression, '[a-zA-Z0-9_\\s+\\-*/%?:><=!&|(),.]+'), FALSE) AS fails_bad_character,
        coalesce(contains(replace(replace(replace(replace(expression, '==', ''), '!=', ''), '>=', ''), '<=', ''), '='), FALSE) AS fails_assignment,
        coalesce(regexp_matches(expression, '(?i)\\b(let|fn|def|while|for|in|return|try|catch|throw|use|import|include|load|new|class|system|runtime|process|processbuilder|exec|eval|sys|java|javax|org|com|net|lambda|nil|null)\\b'), FALSE) AS fails_banned_word
        FROM texts)
    SELECT *, CASE WHEN fails_empty THEN 'empty' WHEN fails_too_long THEN 'too_long' WHEN fails_bad_character THEN 'bad_character'
        WHEN fails_assignment THEN 'assignment' WHEN fails_banned_word THEN 'banned_word' END AS reason,
        NOT (fails_empty OR fails_too_long OR fails_bad_character OR fails_assignment OR fails_banned_word) AS valid FROM judged""")
def audit_rule_texts(t: Tables) -> DataFrame:
    return audit_rules(t.sql(_TEXTS)).drop("expression")


@query("""
    SELECT rule_id, seq, regexp_replace(target_sensor_id, '^(P_|SN_)', '') AS rule_key, contains(expression, 'window_') AS uses_window
    FROM rules WHERE NOT regexp_matches(expression, '[^=!<>]=[^=]')""")
def usable_rule_table(t: Tables) -> DataFrame:
    return usable_rules(t.rules).select("rule_id", "seq", "rule_key", "uses_window")


@query("SELECT id, contains(expression, 'window_') OR contains(expression, 'previous_') AS uses_window FROM formulas")
def window_flags(t: Tables) -> DataFrame:
    return t.formulas.select("id", uses_window(F.col("expression")).alias("uses_window"))
