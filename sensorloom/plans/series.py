"""Registered queries over series: sampling, windows, formulas, latest readings, several sensors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.formula import WindowCall
from sensorloom.operators import latest
from sensorloom.operators.align import align_series, decimate
from sensorloom.operators.composite import dry_run_table, evaluate_composite, simulation_metrics
from sensorloom.operators.evaluate import evaluate_on_demand, evaluate_series, range_of
from sensorloom.operators.formulas import default_formulas
from sensorloom.operators.retention import retain
from sensorloom.operators.sampling import most_buckets_of, sample_by, sampled_tail
from sensorloom.operators.windows import register_mergeable, rolling
from sensorloom.plans.registered import query
from sensorloom.plans.tables import Tables
from sensorloom.sources.readings import series_with_fallback, stored_form

FROM, TO = "2024-01-05 00:00:00", "2024-01-12 00:00:00"


# -- sampling --------------------------------------------------------------------
def sampled_sql(micros: int, source: str = "readings", where: str = "TRUE") -> str:
    """Filled buckets of a fixed width."""
    return f"""
    WITH got AS (SELECT sensor_id, epoch_us(ts) // {micros} AS b, avg(value) AS value, max(state) AS state, bool_or(has_inaccurate_data) AS bad
                 FROM {source} WHERE {where} GROUP BY ALL),
    span AS (SELECT sensor_id, unnest(range(min(b), max(b) + 1)) AS b FROM got GROUP BY sensor_id),
    sampled AS (SELECT sensor_id, b * {micros} AS ts_us, last_value(value IGNORE NULLS) OVER w AS value,
                       last_value(state IGNORE NULLS) OVER w AS state, last_value(bad IGNORE NULLS) OVER w AS has_inaccurate_data
                FROM span LEFT JOIN got USING (sensor_id, b) WINDOW w AS (PARTITION BY sensor_id ORDER BY b))"""


def _round(*names: str) -> str:
    return ", ".join(f"round({name}, 6) + 0.0 AS {name}" for name in names)


@query(sampled_sql(3_600_000_000) + f" SELECT sensor_id, ts_us, {_round('value')}, state, has_inaccurate_data FROM sampled")
def sample_by_hour(t: Tables) -> DataFrame:
    return sample_by(t.readings, "1h")


@query(sampled_sql(900_000_000, where=f"ts BETWEEN '{FROM}' AND '{TO}'")
       + f" SELECT sensor_id, ts_us, {_round('value')}, state, has_inaccurate_data FROM sampled")
def sample_by_quarter_hour_in_range(t: Tables) -> DataFrame:
    return sample_by(t.readings, "15m", start=FROM, end=TO)


@query(sampled_sql(60_000_000) + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY ts_us DESC) AS rn FROM sampled)
    SELECT sensor_id, ts_us, {_round('value')}, state, has_inaccurate_data FROM ranked WHERE rn <= 3600""")
def sampled_tail_by_minute(t: Tables) -> DataFrame:
    return sampled_tail(t.readings, "1m")


@query("""
    WITH rows AS (SELECT l_suppkey % 7 AS sensor_id, CAST(l_shipdate AS TIMESTAMP) AS ts, l_quantity AS value, CAST(l_linenumber AS INT) AS state, l_discount > 0.05 AS bad FROM lineitem),
    units AS (SELECT *, unnest(['2d', '1w', '2M', '1y', '500ms']) AS unit FROM rows),
    numbered AS (SELECT *, CASE unit WHEN '2d' THEN epoch_us(ts) // 172800000000 WHEN '1w' THEN epoch_us(ts) // 604800000000
                     WHEN '2M' THEN ((year(ts) - 1970) * 12 + month(ts) - 1) // 2 WHEN '1y' THEN year(ts) - 1970 ELSE epoch_us(ts) // 500000 END AS b FROM units)
    SELECT unit, CAST(sensor_id AS STRING) AS sensor_id,
           CASE unit WHEN '2d' THEN b * 172800000000 WHEN '1w' THEN b * 604800000000 WHEN '500ms' THEN b * 500000
               WHEN '2M' THEN epoch_us(TIMESTAMP '1970-01-01' + to_months(CAST(b * 2 AS INT))) ELSE epoch_us(TIMESTAMP '1970-01-01' + to_years(CAST(b AS INT))) END AS ts_us,
           round(avg(value), 6) + 0.0 AS value, max(state) AS state, bool_or(bad) AS has_inaccurate_data
    FROM numbered GROUP BY unit, sensor_id, b""")
def sample_units(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        (F.col("l_suppkey") % 7).cast("string").alias("sensor_id"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_quantity").alias("value"), F.col("l_linenumber").cast("int").alias("state"),
        (F.col("l_discount") > 0.05).alias("has_inaccurate_data"),
    )
    parts = [sample_by(rows, unit, fill=None).withColumn("unit", F.lit(unit)) for unit in ("2d", "1w", "2M", "1y", "500ms")]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# All orders, one series per customer: months without an order are the gaps.
@query("""
    WITH m AS (SELECT o_custkey AS sensor_id, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS b, avg(o_totalprice) AS value, max(o_orderkey % 3) AS state,
                      bool_or(o_orderkey % 50 = 0) AS bad FROM orders GROUP BY ALL),
    span AS (SELECT sensor_id, unnest(range(min(b), max(b) + 1)) AS b FROM m GROUP BY sensor_id)
    SELECT CAST(sensor_id AS STRING) AS sensor_id, epoch_us(make_timestamp(b // 12, b % 12 + 1, 1, 0, 0, 0)) AS ts_us, round(last_value(value IGNORE NULLS) OVER w, 4) + 0.0 AS value,
           CAST(last_value(state IGNORE NULLS) OVER w AS INT) AS state, last_value(bad IGNORE NULLS) OVER w AS has_inaccurate_data
    FROM span LEFT JOIN m USING (sensor_id, b) WINDOW w AS (PARTITION BY sensor_id ORDER BY b)""")
def sample_months_filled(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_custkey").cast("string").alias("sensor_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("value"),
        (F.col("o_orderkey") % 3).cast("int").alias("state"), (F.col("o_orderkey") % 50 == 0).alias("has_inaccurate_data"),
    )
    sampled = sample_by(rows, "1M")
    return sampled.withColumn("value", F.round("value", 4))


# -- windows ---------------------------------------------------------------------
_OVER = "OVER (PARTITION BY sensor_id ORDER BY ts, seq ROWS BETWEEN {0} PRECEDING AND CURRENT ROW)"


def over(n: int) -> str:
    return _OVER.format(n - 1)


@query(f"""
    SELECT seq, round(avg(value) {over(10)}, 6) + 0.0 AS window_avg_10, max(value) {over(5)} AS window_max_5, min(value) {over(7)} AS window_min_7,
           round(avg(value) {over(150)}, 6) + 0.0 AS window_avg_150, -1.7976931348623157e308::DOUBLE AS window_max_0,
           round(CASE WHEN count(*) {over(4)} < 2 OR first_value(value) {over(4)} = 0 THEN 0.0
                      ELSE (value - first_value(value) {over(4)}) / first_value(value) {over(4)} * 100 END, 6) + 0.0 AS window_rate_4
    FROM readings""")
def window_functions(t: Tables) -> DataFrame:
    calls = [WindowCall(n, s) for n, s in [("avg", 10), ("max", 5), ("min", 7), ("avg", 150), ("max", 0), ("rate", 4)]]
    return rolling(t.readings, calls).select("seq", *[c.column for c in calls])


@query(f"""
    WITH held AS (SELECT seq, ts, list({{'at': ts, 'v': value}}) {over(6)} AS rows FROM readings),
    fresh AS (SELECT seq, list_transform(list_filter(rows, lambda r: r.at > ts - INTERVAL 12 HOUR), lambda r: r.v) AS v FROM held)
    SELECT seq, round(list_avg(v), 6) + 0.0 AS window_avg_6, list_max(v) AS window_max_6 FROM fresh""")
def window_functions_within_time(t: Tables) -> DataFrame:
    calls = [WindowCall("avg", 6), WindowCall("max", 6)]
    windows = rolling(t.readings, calls, cap=None, within=("ts", 12 * 3600))
    return windows.select("seq", *[c.column for c in calls])


@query(f"""
    WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS seq, l_suppkey AS sensor_id, l_shipdate AS ts, l_quantity AS value, l_extendedprice, l_partkey FROM lineitem),
    o AS (SELECT sensor_id, avg(value) OVER (PARTITION BY sensor_id ORDER BY ts, seq, l_partkey, value, l_extendedprice ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS w FROM r)
    SELECT CAST(sensor_id AS STRING) AS sensor_id, count(*) AS n, round(sum(w), 4) + 0.0 AS total FROM o GROUP BY sensor_id""")
def window_avg_of_suppliers(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_suppkey").cast("string").alias("sensor_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_quantity").alias("value"), "l_extendedprice", "l_partkey",
    )
    call = WindowCall("avg", 10)
    windows = rolling(rows, [call], order=["ts", "seq", "l_partkey", "value", "l_extendedprice"])
    return windows.groupBy("sensor_id").agg(F.count("*").alias("n"), F.round(F.sum(call.column), 4).alias("total"))


# Windows of thousands of rows over three long series; the order has no ties but equal rows.
_SHIPPED = """shipped AS (SELECT l_orderkey, l_linenumber, l_returnflag AS sensor_id, l_extendedprice AS value,
    row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS place FROM lineitem)"""


def _last(n: int) -> str:
    return f"OVER (PARTITION BY sensor_id ORDER BY place ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _shipped(t: Tables, calls: list[WindowCall]) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("sensor_id"), F.col("l_shipdate").alias("ts"), "l_partkey", "l_quantity", F.col("l_extendedprice").alias("value"))
    windows = rolling(rows, calls, order=["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "value"])
    return windows.select("l_orderkey", "l_linenumber", "value", *[c.column for c in calls])


@query(f"""WITH {_SHIPPED} SELECT l_orderkey, l_linenumber, value, max(value) {_last(5000)} AS window_max_5000, min(value) {_last(5000)} AS window_min_5000,
           round(avg(value) {_last(700)}, 6) + 0.0 AS window_avg_700 FROM shipped""")
def wide_windows_of_lineitem(t: Tables) -> DataFrame:
    return _shipped(t, [WindowCall("max", 5000), WindowCall("min", 5000), WindowCall("avg", 700)])


@query(f"""WITH {_SHIPPED}, got AS (SELECT l_orderkey, l_linenumber, value, first_value(value) {_last(2000)} AS f, count(*) {_last(2000)} AS n,
           max(value) {_last(3000)} - min(value) {_last(3000)} AS window_spread_3000 FROM shipped)
           SELECT l_orderkey, l_linenumber, value, window_spread_3000, round(CASE WHEN n < 2 OR f = 0 THEN 0.0 ELSE (value - f) / f * 100 END, 6) + 0.0 AS window_rate_2000 FROM got""")
def wide_custom_windows_of_lineitem(t: Tables) -> DataFrame:
    register_mergeable("spread", {"low": ("min", lambda v: v), "high": ("max", lambda v: v)}, lambda p: p["high"] - p["low"])
    return _shipped(t, [WindowCall("rate", 2000), WindowCall("spread", 3000)])


# -- one formula -------------------------------------------------------------------
def _evaluated(expression: str) -> str:
    return f"""SELECT seq, sensor_id || '_ondemand_eval' AS sensor_id, epoch_us(ts) AS ts_us, round({expression}, 6) + 0.0 AS value,
               state, has_inaccurate_data FROM readings"""


@query(_evaluated(f"value * 1.8 + avg(value) {over(10)}"))
def evaluate_windowed_formula(t: Tables) -> DataFrame:
    return evaluate_series(t.readings, "value * 1.8 + window_avg(10)")


@query(_evaluated("CASE WHEN value > 50 AND state = 0 OR value < 5 THEN value * 1.1 ELSE CASE WHEN value >= 20 THEN value / 2 ELSE -value END END"))
def evaluate_conditions(t: Tables) -> DataFrame:
    return evaluate_series(t.readings, "value > 50 && state == 0 || value < 5 ? value * 1.1 : value >= 20 ? value / 2 : -value")


@query(_evaluated("CASE WHEN NOT (state = 1) AND seq >= 0 THEN 7 // 2 + 7 % 4 + value % 3 ELSE (7 / 2.0) * -1 END"))
def evaluate_whole_numbers(t: Tables) -> DataFrame:
    return evaluate_series(t.readings, "!(state == 1) ? 7 / 2 + 7 % 4 + value % 3 : 7 / 2.0 * -1")


@query(_evaluated("abs(10 - value) + sqrt(value) + floor(value + 0.5) + floor(value) - ceil(value) + least(value, 20) * greatest(value, 3) "
                  "+ pow(value, 2) - ln(value + 1) + sin(value) * cos(value)"))
def evaluate_functions(t: Tables) -> DataFrame:
    text = "abs(10 - value) + sqrt(value) + round(value) + floor(value) - ceil(value) + min(value, 20) * max(value, 3) + pow(value, 2) - math.log(value + 1) + sin(value) * cos(value)"
    return evaluate_series(t.readings, text)


# A quotient of 0 / 0 is no number and x / 0 infinite; both are told apart by comparisons.
@query(_evaluated("CASE WHEN state = 0 THEN 1 ELSE 2 END + 0.0::DOUBLE + CASE WHEN value / (state + 1) > 1000000 THEN 1 ELSE 0 END"))
def evaluate_divisions_by_zero(t: Tables) -> DataFrame:
    return evaluate_series(t.readings, "((value + 1) / (state * 1.0) > 1000000 ? 1 : 2) + ((state * 1.0) / (value - value) > 1 && state == 0 ? 5 : 0)")


@query("""SELECT seq, sensor_id || '_ondemand_eval' AS sensor_id, epoch_us(ts) AS ts_us, round(value * 2 + state, 6) AS value, state, has_inaccurate_data
          FROM readings WHERE sensor_id = '10007'""")
def evaluate_drops_failing_points(t: Tables) -> DataFrame:
    return evaluate_series(t.readings, "P_10007 * 2 + state")


@query("""SELECT count(*) AS points, count(*) FILTER (sensor_id <> '10007') AS failed, round(sum(CASE WHEN sensor_id = '10007' THEN value * 2 ELSE 0 END), 4) AS total FROM readings""")
def evaluate_counts_failing_points(t: Tables) -> DataFrame:
    done = evaluate_series(t.readings, "SN_10007 * 2", on_error="count")
    return done.agg(F.count("*").alias("points"), F.sum("failed").cast("bigint").alias("failed"), F.round(F.sum("value"), 4).alias("total"))


@query(sampled_sql(3_600_000_000, where=f"sensor_id = '10007' AND ts BETWEEN '{FROM}' AND '{TO}'") + f"""
    SELECT '10007_ondemand_eval' AS sensor_id, ts_us, state, has_inaccurate_data,
           round(value * 1.8 + avg(value) OVER (ORDER BY ts_us ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) + 0.0 AS value FROM sampled""")
def evaluate_on_demand_sampled(t: Tables) -> DataFrame:
    return evaluate_on_demand(t.readings, "10007", "value * 1.8 + window_avg(10)", FROM, TO, "1h")


# The whole table, sampled by hour, under one formula.
@query(sampled_sql(3_600_000_000) + """
    SELECT sensor_id || '_ondemand_eval' AS sensor_id, ts_us, state, has_inaccurate_data,
           round(value * 1.8 + avg(value) OVER (PARTITION BY sensor_id ORDER BY ts_us ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) + 0.0 AS value FROM sampled""")
def evaluate_sampled_fleet(t: Tables) -> DataFrame:
    most = most_buckets_of(t.readings, "1h")
    return evaluate_series(sample_by(t.readings, "1h"), "value * 1.8 + window_avg(10)", most_rows=most)


# -- latest ------------------------------------------------------------------------
def _ranked(order: str, where: str, columns: str = "seq, sensor_id, epoch_us(ts) AS ts_us, value", source: str = "readings") -> str:
    return f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY {order}) AS rn FROM {source})
               SELECT {columns} FROM ranked WHERE {where}"""


_POINT = ["seq", "sensor_id", "ts", "value"]


@query(_ranked("ts DESC, seq DESC", "rn <= 5"))
def latest_points(t: Tables) -> DataFrame:
    return latest.latest_points(t.readings, 5).select(_POINT)


@query("SELECT seq, sensor_id, epoch_us(ts) AS ts_us, value, CAST(NULL AS STRING) AS device_id FROM readings WHERE sensor_id = '10003' ORDER BY ts DESC LIMIT 25")
def latest_points_of_old_table(t: Tables) -> DataFrame:
    old = t.readings.drop("device_id", "sensor_index")
    return latest.latest_of_sensor(old, "10003", 25).select(*_POINT, "device_id")


@query(_ranked("ts DESC, seq DESC", "rn <= 360"))
def trailing_points(t: Tables) -> DataFrame:
    return latest.trailing_points(t.readings).select(_POINT)


# Series longer than any usual cap: one per event type.
_LONG = "typed AS (SELECT event_id AS seq, event_type AS sensor_id, ts, value FROM events)"


def _long(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("sensor_id"), "ts", "value")


@query(f"""WITH {_LONG} SELECT seq, round(avg(value) OVER (PARTITION BY sensor_id ORDER BY ts, seq ROWS BETWEEN 149 PRECEDING AND CURRENT ROW), 6) + 0.0 AS window_avg_150,
           max(value) OVER (PARTITION BY sensor_id ORDER BY ts, seq ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS window_max_400 FROM typed""")
def window_avg_150_of_event_types(t: Tables) -> DataFrame:
    calls = [WindowCall("avg", 150), WindowCall("max", 400)]
    return rolling(_long(t), calls).select("seq", *[c.column for c in calls])


@query(f"WITH {_LONG}, " + _ranked("ts DESC, seq DESC", "rn <= 360", source="typed").removeprefix("WITH "))
def trailing_points_of_event_types(t: Tables) -> DataFrame:
    return latest.trailing_points(_long(t)).select(_POINT)


@query(f"SELECT seq, sensor_id, epoch_us(ts) AS ts_us, value FROM readings WHERE sensor_id = '10007' AND ts BETWEEN '{FROM}' AND '{TO}'")
def sensor_range(t: Tables) -> DataFrame:
    return range_of(t.readings, "10007", FROM, TO).select(_POINT)


@query(f"SELECT seq, sensor_id, epoch_us(ts) AS ts_us, value FROM readings WHERE sensor_id = '10007' AND ts BETWEEN '{FROM}' AND '{TO}' ORDER BY ts LIMIT 10")
def range_scan(t: Tables) -> DataFrame:
    return latest.range_scan(t.readings, "10007", FROM, TO, 10).select(_POINT)


@query(f"WITH bounded AS (SELECT * FROM readings WHERE ts BETWEEN '{FROM}' AND '{TO}'), "
       + _ranked("ts, seq", "rn <= 4", source="bounded").removeprefix("WITH "))
def range_heads(t: Tables) -> DataFrame:
    return latest.range_head(t.readings, FROM, TO, 4).select(_POINT)


@query("SELECT seq, sensor_id, epoch_us(ts) AS ts_us, value FROM readings WHERE sensor_id IN ('10001', '10002', '10003') ORDER BY ts DESC LIMIT 20")
def latest_listing(t: Tables) -> DataFrame:
    return latest.latest_listing(t.readings, ["10001", "10002", "10003"]).select(_POINT)


@query("""WITH newest AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq DESC) AS back FROM readings),
          held AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq) AS rn FROM newest WHERE back <= 40)
          SELECT seq, sensor_id, epoch_us(ts) AS ts_us, value FROM held WHERE rn <= 15""")
def buffer_read(t: Tables) -> DataFrame:
    return latest.buffer_read(t.readings, 15, held=40).select(_POINT)


@query("""WITH newest AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq DESC) AS back FROM (SELECT event_id AS seq, event_type AS sensor_id, value FROM events)),
          held AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq) AS rn FROM newest WHERE back <= 2000)
          SELECT seq, sensor_id, value FROM held WHERE rn <= 1000""")
def buffer_read_of_event_types(t: Tables) -> DataFrame:
    typed = t.events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("sensor_id"), "value")
    return latest.buffer_read(typed, 1000)


@query("SELECT seq, sensor_id, epoch_us(ts) AS ts_us, value FROM readings WHERE CAST(ts AS DATE) > DATE '2024-01-15'")
def retained_readings(t: Tables) -> DataFrame:
    from datetime import date

    return retain(t.readings, 15, date(2024, 1, 30)).select(_POINT)


@query("""SELECT seq, coalesce(CASE WHEN seq % 3 > 0 THEN sensor_id END, '') AS sensor_id, CASE WHEN seq % 5 > 0 THEN device_id END AS device_id, sensor_index,
          epoch_us(ts) AS ts_us, epoch_us(ts) // 1000 * 1000000 AS ts_ns, value, state, has_inaccurate_data, CAST(CAST(ts AS DATE) AS STRING) AS day FROM readings WHERE seq % 7 > 0""")
def stored_readings(t: Tables) -> DataFrame:
    n = F.col("seq")
    given = t.readings.withColumns({
        "sensor_id": F.when(n % 3 > 0, F.col("sensor_id")), "device_id": F.when(n % 5 > 0, F.col("device_id")).otherwise(" "),
        "ts": F.when(n % 7 > 0, F.col("ts")),
    })
    return stored_form(given, nanos=True, keep=["seq"]).withColumn("day", F.col("date").cast("string")).drop("date")


@query(f"""WITH a AS (SELECT sensor_id, seq, value, 'STORE' AS source FROM readings WHERE ts BETWEEN '{FROM}' AND '2024-01-05 06:00:00'),
           b AS (SELECT sensor_id, seq, value, 'LATEST' FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY ts DESC) AS rn FROM readings WHERE state = 1) WHERE rn <= 3
                 AND sensor_id NOT IN (SELECT sensor_id FROM a)),
           c AS (SELECT id, NULL::BIGINT, mean, 'CATALOG' FROM catalog WHERE id NOT IN (SELECT sensor_id FROM a) AND id NOT IN (SELECT sensor_id FROM b))
           SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def series_by_source(t: Tables) -> DataFrame:
    columns = ["sensor_id", "seq", "value"]
    stored = t.readings.filter(F.col("ts").between(F.lit(FROM).cast("timestamp"), F.lit("2024-01-05 06:00:00").cast("timestamp"))).select(columns)
    newest = latest.latest_points(t.readings.filter("state = 1"), 3).select(columns)
    fallback = t.catalog.select(F.col("id").alias("sensor_id"), F.lit(None).cast("bigint").alias("seq"), F.col("mean").alias("value"))
    return series_with_fallback(("STORE", stored), ("LATEST", newest), ("CATALOG", fallback))


# -- several sensors -----------------------------------------------------------------
_PLACED = """placed AS (SELECT sensor_id, value, epoch_us(ts) AS ts_us, row_number() OVER (PARTITION BY sensor_id ORDER BY ts, seq) - 1 AS pos FROM typed)"""
_TYPED = """typed AS (SELECT event_id AS seq, event_type AS sensor_id, ts, value FROM events)"""
_TYPES = ["click", "view", "error", "purchase", "signup"]


def _by_type(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("sensor_id"), F.col("ts").cast("timestamp").alias("ts"), "value",
    )


@query(f"""WITH {_TYPED}, {_PLACED} SELECT c.pos, c.ts_us, c.value AS click, v.value AS view, e.value AS error
           FROM placed c JOIN placed v ON v.pos = c.pos AND v.sensor_id = 'view' JOIN placed e ON e.pos = c.pos AND e.sensor_id = 'error' WHERE c.sensor_id = 'click'""")
def align_by_position(t: Tables) -> DataFrame:
    return align_series(_by_type(t), ["click", "view", "error"])


@query(f"""WITH {_TYPED}, {_PLACED} SELECT c.pos, c.ts_us, c.value AS click, v.value AS view, 0.0::DOUBLE AS nothing
           FROM placed c JOIN placed v ON v.pos = c.pos AND v.sensor_id = 'view' WHERE c.sensor_id = 'click'""")
def align_with_missing_series(t: Tables) -> DataFrame:
    return align_series(_by_type(t), ["click", "view", "nothing"], missing="zero")


_DAILY = """daily AS (SELECT event_type AS sensor_id, date_trunc('hour', ts) AS ts, max(value) AS value FROM events GROUP BY ALL)"""


@query(f"""WITH {_DAILY} SELECT row_number() OVER (ORDER BY c.ts) - 1 AS pos, epoch_us(c.ts) AS ts_us, c.value AS click, v.value AS view
           FROM daily c JOIN daily v ON v.ts = c.ts AND v.sensor_id = 'view' WHERE c.sensor_id = 'click'""")
def align_by_time(t: Tables) -> DataFrame:
    hourly = _by_type(t).groupBy("sensor_id", F.date_trunc("hour", "ts").alias("ts")).agg(F.max("value").alias("value"))
    return align_series(hourly, ["click", "view"], by="ts")


@query(f"WITH {_TYPED}, {_PLACED} SELECT pos, value FROM placed WHERE sensor_id = 'click' AND pos % 10 = 0")
def decimated_series(t: Tables) -> DataFrame:
    return decimate(align_series(_by_type(t), ["click"]), 10).select("pos", F.col("click").alias("value"))


# The five default formulas over long series: sensor 10001 is all clicks, 10002 all views, 10004 all errors.
def _fleet(t: Tables) -> DataFrame:
    names = {"click": "10001", "view": "10002", "error": "10004"}
    code = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    typed = _by_type(t).filter(F.col("sensor_id").isin(list(names)))
    return typed.withColumn("sensor_id", F.try_element_at(code, F.col("sensor_id")))


_COMPOSITE = f"""
    {_TYPED}, {_PLACED},
    base AS (SELECT pos, ts_us, value, value * 1.8 + 32 AS f, avg(value) OVER (ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s FROM placed WHERE sensor_id = 'click'),
    heat AS (SELECT *, (f - 32) / 1.8 * 0.95 AS h FROM base),
    points AS (SELECT pos, ts_us, value, f, s, h, CASE WHEN h > 60 THEN h * 1.15 ELSE h END + s * 0.2 AS p FROM heat)"""


@query(f"""WITH {_COMPOSITE} SELECT pos, ts_us, value AS primary_value, floor(p * 1000 + 0.5) / 1000 AS computed_value, round(f, 6) + 0.0 AS "TEMP_FAHRENHEIT",
           round(s, 6) + 0.0 AS "SMOOTHED_TEMP", round(h, 6) + 0.0 AS "NORMALIZED_HEAT", round(p, 6) + 0.0 AS "POWER_EFFICIENCY_INDEX", CAST(0 AS INT) AS failures FROM points""")
def evaluate_composite_formula(t: Tables) -> DataFrame:
    return evaluate_composite(_fleet(t), default_formulas(t.spark), "POWER_EFFICIENCY_INDEX", duration=None)


def _metrics(value: str, deviation: str) -> str:
    return f"""SELECT count(*) AS total_points, floor(min({value}) * 100 + 0.5) / 100 AS min, floor(max({value}) * 100 + 0.5) / 100 AS max,
               floor(avg({value}) * 100 + 0.5) / 100 AS avg, {deviation} AS std_dev, CAST(0 AS BIGINT) AS nan_count"""


@query(f"""WITH {_COMPOSITE}, kept AS (SELECT floor(p * 1000 + 0.5) / 1000 AS v FROM points WHERE pos % 10 = 0)
           {_metrics('v', 'floor(stddev_pop(v) * 100 + 0.5) / 100')} FROM kept""")
def simulation_metrics_of_composite(t: Tables) -> DataFrame:
    points = evaluate_composite(_fleet(t), default_formulas(t.spark), "POWER_EFFICIENCY_INDEX", duration=None)
    return simulation_metrics(points, 10)


@query(f"""WITH {_TYPED}, {_PLACED}, pair AS (SELECT a.pos, abs(a.value - b.value) AS v FROM placed a JOIN placed b ON a.pos = b.pos AND b.sensor_id = 'error' WHERE a.sensor_id = 'view'),
           kept AS (SELECT floor(v * 1000 + 0.5) / 1000 AS v FROM pair) {_metrics('v', '0.0::DOUBLE')} FROM kept""")
def pressure_delta_metrics(t: Tables) -> DataFrame:
    points = evaluate_composite(_fleet(t), default_formulas(t.spark), "PRESSURE_DELTA", duration=None)
    return simulation_metrics(points, with_deviation=False)


# Five formulas that use each other, over five sensors, to the end of the shortest series.
_CHAIN = [
    ("F1", "sensor_000 * 1.5 + 10"), ("F2", "F1 * 0.9 + sensor_001"), ("F3", "F2 + window_avg(10) - sensor_002"),
    ("F4", "F3 * 1.1 + sensor_003"), ("F5", "F4 - window_max(5) + sensor_004"),
]


@query(f"""WITH typed AS (SELECT l_suppkey % 5 AS s, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey, l_quantity AS value, l_extendedprice FROM lineitem),
    placed AS (SELECT s, value, row_number() OVER (PARTITION BY s ORDER BY ts, l_orderkey, l_linenumber, l_partkey, value, l_extendedprice) - 1 AS pos FROM typed),
    steps AS (SELECT pos, max(value) FILTER (s = 0) AS a, max(value) FILTER (s = 1) AS b, max(value) FILTER (s = 2) AS c, max(value) FILTER (s = 3) AS d, max(value) FILTER (s = 4) AS e
              FROM placed GROUP BY pos HAVING count(*) = 5),
    held AS (SELECT *, avg(a) OVER (ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS w, max(a) OVER (ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM steps)
    SELECT pos, a AS primary_value, floor(((((a * 1.5 + 10) * 0.9 + b + w - c) * 1.1 + d) - m + e) * 1000 + 0.5) / 1000 AS computed_value, CAST(0 AS INT) AS failures FROM held""")
def evaluate_chain_over_a_day(t: Tables) -> DataFrame:
    chain = t.spark.createDataFrame(
        [(i, None, i, e, "", "sensor_000") for i, e in _CHAIN], "id string, serial bigint, name string, expression string, category string, target_sensor string",
    )
    rows = t.lineitem.select(
        F.concat(F.lit("sensor_00"), (F.col("l_suppkey") % 5).cast("string")).alias("sensor_id"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("value"), "l_extendedprice",
    )
    order = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "value", "l_extendedprice"]
    points = evaluate_composite(rows, chain, "F5", order=order)
    return points.select("pos", "primary_value", "computed_value", "failures")


# Stand-in values: value and windows 50, sensors 45.5, formulas 72.
@query("""
    SELECT id, CASE WHEN p % 101 = 50 THEN 73.0 WHEN p % 101 = 51 THEN 144.0 WHEN p % 8 = 0 THEN 45.5 * 1.8 + p % 40
        WHEN p % 8 = 1 THEN CASE WHEN 50 > p % 100 THEN 55.0 ELSE 25.0 END WHEN p % 8 = 2 THEN 100.0 WHEN p % 8 = 3 THEN 25.0
        WHEN p % 8 = 4 THEN floor((4.5 + sqrt(50)) * 1000 + 0.5) / 1000 WHEN p % 8 = 5 THEN 81.5 WHEN p % 8 = 6 THEN NULL
        ELSE floor((18.0 / 51 + ln(51)) * 1000 + 0.5) / 1000 END::DOUBLE AS result
    FROM (SELECT id, serial - 200001 AS p FROM formulas)""")
def dry_run_of_formulas(t: Tables) -> DataFrame:
    return dry_run_table(t.formulas)
