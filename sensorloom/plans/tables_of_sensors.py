"""Registered queries over the registry, the catalog, formulas and their graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators import catalog, formulas, graph, registry
from sensorloom.operators.changes import ChangeLog
from sensorloom.plans.registered import query
from sensorloom.plans.tables import Tables
from sensorloom.plans.values import fallback_sql
from sensorloom.session import shared_folder

# -- formula graph -------------------------------------------------------------------
# Formula k uses others by shape; P_2xxxxx is the serial of a formula.
_USES = """
    known AS (SELECT id, CAST(serial AS STRING) AS digits, expression, target_sensor FROM formulas),
    tokens AS (SELECT id AS src, unnest(regexp_extract_all(expression, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM known),
    uses AS (SELECT DISTINCT src, k.id AS dst FROM tokens JOIN known k ON k.id = token OR 'P_' || k.digits = token),
    mentions AS (SELECT DISTINCT src, regexp_replace(token, '^P_', '') AS sensor FROM tokens
                 WHERE regexp_full_match(token, 'sensor_\\d+') OR (regexp_full_match(token, 'P_\\d+') AND token NOT IN (SELECT 'P_' || digits FROM known)))"""
_TREE = f"""{_USES}, tree AS (SELECT id AS target, id FROM known UNION SELECT target, dst FROM tree JOIN uses ON src = tree.id)"""
_STUCK = """below AS (SELECT src, dst FROM uses UNION SELECT below.src, uses.dst FROM below JOIN uses ON uses.src = below.dst),
    looped AS (SELECT DISTINCT src AS id FROM below WHERE src = dst),
    stuck AS (SELECT id FROM looped UNION SELECT src FROM below JOIN looped ON below.dst = looped.id)"""
_LEVELS = """levels AS (SELECT id, 0 AS level FROM known WHERE id NOT IN (SELECT id FROM stuck)
    UNION SELECT uses.src, level + 1 FROM levels JOIN uses ON uses.dst = levels.id WHERE uses.src NOT IN (SELECT id FROM stuck)),
    height AS (SELECT id, max(level) AS level FROM levels GROUP BY id)"""


@query(f"WITH {_USES} SELECT src, 'formula' AS kind, dst AS ref FROM uses UNION ALL SELECT src, 'sensor', sensor FROM mentions")
def formula_references(t: Tables) -> DataFrame:
    return graph.formula_references(t.formulas).select("src", "kind", "ref")


@query(f"WITH {_USES} SELECT dst AS id, src AS dependent FROM uses WHERE src <> dst")
def formula_dependents(t: Tables) -> DataFrame:
    return graph.dependents(t.formulas)


@query(f"WITH RECURSIVE {_USES}, {_STUCK}, {_LEVELS} SELECT known.id, CAST(level AS INT) AS level FROM known LEFT JOIN height ON height.id = known.id")
def formula_levels(t: Tables) -> DataFrame:
    return graph.formula_levels(t.formulas)


@query(f"""WITH RECURSIVE {_USES}, {_STUCK},
    spots AS (SELECT src, dst, min(i) AS place FROM (SELECT known.id AS src, generate_subscripts(regexp_extract_all(expression, '[A-Za-z_][A-Za-z0-9_]*'), 1) AS i,
                  unnest(regexp_extract_all(expression, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM known) x JOIN (SELECT id AS dst, digits FROM known) k ON dst = token OR 'P_' || digits = token GROUP BY src, dst),
    first AS (SELECT src, arg_min(dst, place) AS next FROM spots WHERE dst IN (SELECT id FROM stuck) GROUP BY src),
    walk AS (SELECT src AS id, [src, next] AS path, src = next AS done FROM first
             UNION ALL SELECT id, list_append(path, next), list_contains(path, next) FROM walk JOIN first ON src = path[-1] WHERE NOT done)
    SELECT known.id, path IS NOT NULL AS has_cycle, array_to_string(path, '>') AS cycle_path FROM known LEFT JOIN walk ON walk.id = known.id AND done""")
def formula_cycles(t: Tables) -> DataFrame:
    return graph.find_cycles(t.formulas).withColumn("cycle_path", F.array_join("cycle_path", ">"))


@query(f"""WITH RECURSIVE {_TREE}, {_STUCK}, {_LEVELS}
    SELECT target, tree.id, CAST(level AS INT) AS level FROM tree LEFT JOIN height ON height.id = tree.id""")
def evaluation_orders(t: Tables) -> DataFrame:
    return graph.evaluation_order(t.formulas, t.formulas)


@query(f"""WITH RECURSIVE {_TREE}
    SELECT id AS target, coalesce(target_sensor, 'sensor_000') AS sensor FROM known
    UNION SELECT target, target_sensor FROM tree JOIN known ON known.id = tree.id WHERE target_sensor IS NOT NULL
    UNION SELECT target, sensor FROM tree JOIN mentions ON src = tree.id""")
def required_sensors(t: Tables) -> DataFrame:
    return graph.required_sensors(t.formulas, t.formulas)


# A formula that names itself: every 20th is given its own id as a last term.
_SELFISH = "SELECT id, serial, name, CASE WHEN serial % 20 = 0 THEN expression || ' + ' || id ELSE expression END AS expression, category, target_sensor FROM formulas"


@query(f"SELECT id FROM ({_SELFISH}) WHERE serial % 20 = 0")
def self_referring_formulas(t: Tables) -> DataFrame:
    return graph.self_references(t.sql(_SELFISH))


@query(f"WITH {_USES} SELECT dst AS id, src AS dependent FROM uses WHERE src <> dst AND CAST(substr(dst, 2) AS INT) % 3 = 0")
def blocked_formula_deletes(t: Tables) -> DataFrame:
    asked = t.formulas.filter(F.col("serial") % 3 == 200001 % 3)
    return graph.blocked_deletes(t.formulas, asked)


@query(f"WITH {_USES} SELECT id FROM known WHERE NOT (CAST(substr(id, 2) AS INT) % 3 = 0 AND id NOT IN (SELECT dst FROM uses WHERE src <> dst))")
def formulas_after_deletes(t: Tables) -> DataFrame:
    asked = t.formulas.filter(F.col("serial") % 3 == 200001 % 3)
    return graph.delete_formulas(t.formulas, asked).select("id")


@query("""SELECT o_orderkey AS n, 'F' || CAST(o_orderkey % (SELECT count(*) FROM part) AS STRING) AS formula_id FROM orders WHERE o_orderkey % 5 < 4
          UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 5 = 4""")
def formulas_by_alias(t: Tables) -> DataFrame:
    spelled = t.sql("""SELECT o_orderkey AS n, CASE o_orderkey % 5 WHEN 0 THEN 'F' || CAST(k AS STRING) WHEN 1 THEN 'P_' || CAST(200001 + k AS STRING)
        WHEN 2 THEN CAST(200001 + k AS STRING) WHEN 3 THEN ' f' || CAST(k AS STRING) ELSE 'none' END AS name
        FROM (SELECT o_orderkey, o_orderkey % (SELECT count(*) FROM part) AS k FROM orders) x""")
    return graph.find_formulas(t.formulas, spelled).select("n", "formula_id")


# -- search and counts -----------------------------------------------------------------
_ROW = ["serial", "sensor_code", "sensor_name"]
_ROW_SQL = "SELECT serial, sensor_code, sensor_name FROM registry WHERE"


@query(f"""{_ROW_SQL} sensor_type = 'FORMULA' AND (lower(sensor_name) LIKE '%p_1%' OR lower(sensor_code) LIKE '%p_1%' OR lower(category) LIKE '%p_1%'
           OR lower(coalesce(formula_expression, '')) LIKE '%p_1%' OR CAST(serial AS STRING) LIKE '%P_1%')""")
def search_registry(t: Tables) -> DataFrame:
    return registry.search_registry(t.registry, "FORMULA", " ", " P_1 ").select(_ROW)


@query(f"{_ROW_SQL} device_id = 'DEVICE-003' AND (lower(sensor_name) LIKE '%sensor 1%' OR lower(sensor_code) LIKE '%sensor 1%' OR lower(category) LIKE '%sensor 1%')")
def search_registry_by_device(t: Tables) -> DataFrame:
    return registry.search_registry(t.registry, None, "DEVICE-003", "Sensor 1").select(_ROW)


@query(f"""{_ROW_SQL} contains(lower(sensor_name), 'dev') OR contains(lower(sensor_code), 'dev') OR contains(lower(category), 'dev')
           OR coalesce(contains(lower(device_id), 'dev'), FALSE) OR coalesce(contains(lower(formula_expression), 'dev'), FALSE) OR contains(CAST(serial AS STRING), 'dev')""")
def filter_registry_list(t: Tables) -> DataFrame:
    return registry.filter_registry(t.registry, text="DEV").select(_ROW)


@query(f"{_ROW_SQL} sensor_type = 'FORMULA' AND status = 'ACTIVE' AND trim(formula_expression) <> ''")
def active_formula_sensors(t: Tables) -> DataFrame:
    return registry.active_formulas(t.registry).select(_ROW)


@query("""SELECT s_suppkey, CASE WHEN r.serial IS NULL THEN 'missing' ELSE r.sensor_code END AS sensor_code FROM supplier LEFT JOIN registry r ON r.serial = 10001 + s_suppkey * 2""")
def sensors_by_serial(t: Tables) -> DataFrame:
    keys = t.supplier.select((F.col("s_suppkey") * 2 + 10001).cast("bigint").alias("serial"))
    found, missing = registry.find_sensors(t.registry, keys)
    rows = found.select("serial", "sensor_code").unionByName(missing.withColumn("sensor_code", F.lit("missing")))
    return rows.select(((F.col("serial") - 10001) / 2).cast("bigint").alias("s_suppkey"), "sensor_code")


@query("""SELECT count(*) AS total, count(*) FILTER (sensor_type = 'PHYSICAL') AS physical, count(*) FILTER (sensor_type = 'FORMULA') AS formula FROM registry""")
def registry_counts(t: Tables) -> DataFrame:
    return registry.registry_counts(t.registry)


@query("SELECT DISTINCT device_id FROM registry WHERE device_id IS NOT NULL")
def registered_devices(t: Tables) -> DataFrame:
    return registry.registered_devices(t.registry)


@query("SELECT coalesce(max(serial), 10000) + 1 AS next_serial FROM registry")
def next_serial(t: Tables) -> DataFrame:
    return registry.next_serial(t.registry)


@query("SELECT DISTINCT category FROM formulas WHERE category <> ''")
def formula_categories(t: Tables) -> DataFrame:
    return catalog.distinct_categories(t.formulas)


@query("SELECT id, name FROM catalog WHERE category = 'Flow' AND (contains(lower(id), 'r_0') OR contains(lower(name), 'r_0'))")
def search_catalog(t: Tables) -> DataFrame:
    return catalog.search_catalog(t.catalog, "Flow", "R_0").select("id", "name")


@query("SELECT id, name FROM formulas WHERE category = 'SMALL' AND (contains(lower(id), 'bolt') OR contains(lower(name), 'bolt') OR contains(lower(expression), 'bolt'))")
def search_formulas(t: Tables) -> DataFrame:
    return catalog.search_formulas(t.formulas, "SMALL", "Bolt").select("id", "name")


# Registry rows doubled and damaged by rule, so that every check finds something.
_DAMAGED = """SELECT * FROM registry UNION ALL SELECT serial + 1000000, sensor_code, sensor_name, CASE WHEN serial % 13 = 0 THEN 'OTHER' ELSE sensor_type END,
    category, unit, device_id, device_sensor_index, formula_expression, description, CASE WHEN serial % 17 = 0 THEN NULL ELSE status END FROM registry WHERE serial % 10 = 0"""


@query(f"""WITH damaged AS ({_DAMAGED})
    SELECT 'duplicate_code' AS problem, sensor_code AS detail, count(*) AS n FROM damaged GROUP BY sensor_code HAVING count(*) > 1
    UNION ALL SELECT 'duplicate_slot', device_id || '#' || CAST(device_sensor_index AS STRING), count(*) FROM damaged WHERE sensor_type = 'PHYSICAL' GROUP BY device_id, device_sensor_index HAVING count(*) > 1
    UNION ALL SELECT 'bad_type', sensor_type, count(*) FROM damaged WHERE sensor_type = 'OTHER' GROUP BY sensor_type
    UNION ALL SELECT 'bad_status', '(none)', count(*) FROM damaged WHERE status IS NULL HAVING count(*) > 0""")
def registry_problems(t: Tables) -> DataFrame:
    return registry.check_registry(t.sql(_DAMAGED))


# -- serials -----------------------------------------------------------------------------
@query("SELECT device_id, device_sensor_index AS sensor_index, serial FROM registry WHERE sensor_type = 'PHYSICAL'")
def serial_mappings(t: Tables) -> DataFrame:
    return registry.mapping_table(t.registry)


@query("SELECT upper(s_name) AS device_id, CAST(i AS INT) AS sensor_index, 10001 + s_suppkey * 100 + i AS serial FROM supplier, range(0, 20) g(i) WHERE i < s_suppkey % 20")
def serial_ranges(t: Tables) -> DataFrame:
    ranges = t.supplier.select(
        F.col("s_name").alias("device_id"), (F.col("s_suppkey") % 20).cast("int").alias("sensor_count"), (F.col("s_suppkey") * 100 + 10001).alias("start_serial"),
    )
    return registry.range_mappings(ranges)


# Half of the slots are in the registry.
@query(f"""SELECT seq, coalesce(k.serial, {fallback_sql('r.device_id', 'r.sensor_index')}) AS serial FROM readings r
    LEFT JOIN (SELECT * FROM registry WHERE sensor_type = 'PHYSICAL' AND serial % 2 = 0) k ON k.device_id = r.device_id AND k.device_sensor_index = r.sensor_index""")
def resolved_serials(t: Tables) -> DataFrame:
    mappings = registry.mapping_table(t.registry.filter("serial % 2 = 0"))
    return registry.resolve_serials(t.readings, mappings).select("seq", "serial")


@query(f"""WITH slots AS (SELECT DISTINCT upper(r_name) || '-' || n_nationkey % 5 AS d, CAST(n_nationkey % 3 AS INT) AS i FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT {fallback_sql('d', 'i')} AS serial, count(*) AS slots FROM slots GROUP BY 1 HAVING count(*) > 1""")
def colliding_fallback_serials(t: Tables) -> DataFrame:
    joined = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    slots = joined.select(
        F.concat_ws("-", "r_name", (F.col("n_nationkey") % 5).cast("string")).alias("device_id"), (F.col("n_nationkey") % 3).cast("int").alias("sensor_index"),
    )
    return registry.fallback_collisions(slots)


@query("SELECT p_partkey, (SELECT max(serial) FROM registry) + row_number() OVER (ORDER BY p_name, p_partkey) AS serial FROM part")
def assigned_serials(t: Tables) -> DataFrame:
    return registry.assign_serials(t.part.select("p_partkey", "p_name"), t.registry, ["p_name", "p_partkey"]).select("p_partkey", "serial")


# -- changes -------------------------------------------------------------------------------
# One request per customer, with gaps, taken slots and equal slots by rule.
_REQUESTS = """
    SELECT c_custkey AS request_id, CASE WHEN c_custkey % 10 = 3 THEN 'VIRTUAL' WHEN c_custkey % 2 = 0 THEN 'PHYSICAL' ELSE 'FORMULA' END AS sensor_type,
           CASE WHEN c_custkey % 12 = 0 THEN ' ' ELSE ' ' || c_name END AS sensor_name,
           CASE WHEN c_custkey % 7 = 0 THEN ' F' || CAST(c_custkey AS STRING) END AS sensor_code, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS category,
           CASE WHEN c_custkey % 14 = 2 THEN '' ELSE 'DEVICE-' || lpad(CAST(c_custkey % 4 + 9 AS STRING), 3, '0') END AS device_id,
           CASE WHEN c_custkey % 14 = 4 THEN NULL ELSE CAST(c_custkey % 100 AS INT) END AS device_sensor_index,
           CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'value * ' || CAST(c_custkey AS STRING) || ' ' END AS formula_expression,
           CAST(NULL AS STRING) AS unit, c_name AS description, CAST(NULL AS STRING) AS status FROM customer"""
_JUDGED = f"""requests AS ({_REQUESTS}),
    firsts AS (SELECT device_id AS d, device_sensor_index AS i, min(request_id) AS first FROM requests WHERE sensor_type = 'PHYSICAL' GROUP BY ALL),
    judged AS (SELECT q.*, CASE WHEN q.sensor_type = 'VIRTUAL' THEN 'no_type' WHEN trim(q.sensor_name) = '' THEN 'no_name'
        WHEN q.sensor_type = 'PHYSICAL' AND q.device_id = '' THEN 'no_device' WHEN q.sensor_type = 'PHYSICAL' AND q.device_sensor_index IS NULL THEN 'no_index'
        WHEN q.sensor_type = 'PHYSICAL' AND (r.serial IS NOT NULL OR request_id > first) THEN 'slot_taken'
        WHEN q.sensor_type = 'FORMULA' AND q.formula_expression IS NULL THEN 'no_formula' END AS reason
        FROM requests q LEFT JOIN registry r ON r.device_id = q.device_id AND r.device_sensor_index = q.device_sensor_index
        LEFT JOIN firsts ON d = q.device_id AND i = q.device_sensor_index)"""
_NEW = ["serial", "sensor_code", "sensor_name", "sensor_type", "category", "unit", "device_id", "device_sensor_index", "formula_expression", "status"]


@query(f"WITH {_JUDGED} SELECT request_id, reason FROM judged")
def judged_sensor_requests(t: Tables) -> DataFrame:
    return registry.judge_new_sensors(t.sql(_REQUESTS), t.registry).select("request_id", "reason")


@query(f"""WITH {_JUDGED},
    numbered AS (SELECT *, (SELECT max(serial) FROM registry) + row_number() OVER (ORDER BY request_id) AS serial FROM judged WHERE reason IS NULL),
    coded AS (SELECT *, coalesce(sensor_code, CASE WHEN sensor_type = 'PHYSICAL' THEN 'PHY-' || replace(device_id, '-', '') || '-S' || printf('%03d', device_sensor_index)
                                                   ELSE 'FML-' || CAST(serial AS STRING) END) AS code FROM numbered)
    SELECT serial, CASE WHEN code IN (SELECT sensor_code FROM registry) OR row_number() OVER (PARTITION BY code ORDER BY serial) > 1 THEN code || '-' || CAST(serial AS STRING) ELSE code END AS sensor_code,
           trim(sensor_name) AS sensor_name, sensor_type, coalesce(category, 'General') AS category, '' AS unit,
           CASE WHEN sensor_type = 'PHYSICAL' THEN device_id END AS device_id, CASE WHEN sensor_type = 'PHYSICAL' THEN device_sensor_index END AS device_sensor_index,
           CASE WHEN sensor_type = 'FORMULA' THEN trim(formula_expression) END AS formula_expression, 'ACTIVE' AS status FROM coded""")
def created_sensors(t: Tables) -> DataFrame:
    return registry.create_sensors(t.sql(_REQUESTS), t.registry).select(_NEW)


_CHANGES = """SELECT serial, CASE WHEN serial % 2 = 0 THEN ' ' ELSE ' new ' || sensor_name END AS sensor_name, CASE WHEN serial % 5 = 0 THEN ' Other ' END AS category,
    CAST(NULL AS STRING) AS unit, CASE WHEN serial % 7 = 0 THEN 'INACTIVE' END AS status, ' value * 2 ' AS formula_expression FROM registry WHERE serial % 3 = 0"""


@query(f"""WITH changes AS ({_CHANGES}) SELECT r.serial, CASE WHEN c.serial % 2 = 1 THEN trim(c.sensor_name) ELSE r.sensor_name END AS sensor_name, coalesce(trim(c.category), r.category) AS category,
    r.unit, coalesce(c.status, r.status) AS status, CASE WHEN r.sensor_type = 'FORMULA' THEN coalesce(trim(c.formula_expression), r.formula_expression) END AS formula_expression
    FROM registry r LEFT JOIN changes c ON c.serial = r.serial""")
def updated_registry(t: Tables) -> DataFrame:
    done = registry.update_sensors(t.registry, t.sql(_CHANGES))
    return done.select("serial", "sensor_name", "category", "unit", "status", "formula_expression")


# Three changes per serial: the last given value of each field stands.
_SEVERAL = """SELECT serial, n AS change, CASE WHEN n = 1 THEN ' first ' WHEN n = 3 THEN ' ' END AS sensor_name, CASE WHEN n <> 2 THEN 'cat' || CAST(n AS STRING) END AS category,
    CASE WHEN n = 2 THEN 'INACTIVE' END AS status, CASE WHEN serial % 2 = 0 OR n = 1 THEN 'value * ' || CAST(n AS STRING) END AS formula_expression
    FROM registry, (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) g WHERE serial % 3 = 1"""


@query("""SELECT serial, CASE WHEN serial % 3 = 1 THEN 'first' ELSE sensor_name END AS sensor_name, CASE WHEN serial % 3 = 1 THEN 'cat3' ELSE category END AS category,
    CASE WHEN serial % 3 = 1 THEN 'INACTIVE' ELSE status END AS status,
    CASE WHEN sensor_type = 'FORMULA' AND serial % 3 = 1 THEN 'value * ' || CASE WHEN serial % 2 = 0 THEN '3' ELSE '1' END ELSE formula_expression END AS formula_expression FROM registry""")
def registry_after_several_changes(t: Tables) -> DataFrame:
    done = registry.update_sensors(t.registry, t.sql(_SEVERAL), order="change")
    return done.select("serial", "sensor_name", "category", "status", "formula_expression")


@query("""SELECT CAST(serial AS STRING) AS serial_text, 'value * 2' AS expression FROM registry WHERE sensor_type = 'FORMULA' AND serial % 3 = 0 AND serial % 7 <> 0
          AND coalesce(status, '') = 'ACTIVE' AND formula_expression <> 'value * 2'""")
def rules_of_changed_sensors(t: Tables) -> DataFrame:
    after = registry.update_sensors(t.registry, t.sql(_CHANGES))
    return registry.rules_of_changes(t.registry, after).select(F.col("derived_sensor_id").alias("serial_text"), "expression")


# The same changes and deletes through a change log: what the last version of the table holds.
@query("""SELECT serial, CASE WHEN serial % 3 = 1 THEN 'first' ELSE sensor_name END AS sensor_name, CASE WHEN serial % 3 = 1 THEN 'INACTIVE' ELSE status END AS status
          FROM registry WHERE serial % 4 <> 1""")
def registry_from_change_log(t: Tables) -> DataFrame:
    log = ChangeLog(t.spark, f"{shared_folder(t.spark)}/registry-{uuid.uuid4().hex}", ["serial"])
    log.create(t.registry)
    log.change(lambda held: registry.update_sensors(held, t.sql(_SEVERAL), order="change"))
    log.change(lambda held: registry.delete_sensors(held, held.filter("serial % 4 = 1").select("serial")))
    return log.snapshot().select("serial", "sensor_name", "status")


# Devices listed twice, with blanks around, and in spellings that share a code.
_DOUBLES = """SELECT s_name AS device_id, CAST(s_suppkey % 3 + 1 AS INT) AS sensor_count FROM supplier UNION ALL SELECT ' ' || s_name || ' ', 2 FROM supplier
    UNION ALL SELECT replace(s_name, '#', '-'), 1 FROM supplier"""


@query("""WITH asked AS (SELECT s_name AS device_id, greatest(s_suppkey % 3 + 1, 2) AS n, 1 AS plain FROM supplier UNION ALL SELECT replace(s_name, '#', '-'), 1, 0 FROM supplier),
    slots AS (SELECT device_id, i, plain FROM asked, range(0, 3) g(i) WHERE i < n), top AS (SELECT max(serial) AS m FROM registry),
    numbered AS (SELECT *, m + row_number() OVER (ORDER BY device_id, i) AS serial, 'PHY-' || upper(regexp_replace(device_id, '[^A-Za-z0-9]', '', 'g')) || '-S' || printf('%03d', i) AS code FROM slots, top)
    SELECT serial, device_id, CAST(i AS INT) AS device_sensor_index, CASE WHEN row_number() OVER (PARTITION BY code ORDER BY serial) > 1 THEN code || '-' || serial ELSE code END AS sensor_code FROM numbered""")
def synced_devices_listed_twice(t: Tables) -> DataFrame:
    return registry.sync_devices(t.sql(_DOUBLES), t.registry).select("serial", "device_id", "device_sensor_index", "sensor_code")


@query("SELECT serial FROM registry WHERE serial % 4 <> 1")
def registry_after_deletes(t: Tables) -> DataFrame:
    return registry.delete_sensors(t.registry, t.registry.filter("serial % 4 = 1").select("serial")).select("serial")


_SYNC = "SELECT DISTINCT device_id, CAST(length(device_id) * 2 + serial % 1 AS INT) AS sensor_count FROM registry WHERE device_id IS NOT NULL UNION ALL SELECT s_name, CAST(s_suppkey % 5 - 1 AS INT) FROM supplier"


@query(f"""WITH asked AS ({_SYNC}), slots AS (SELECT a.device_id, CAST(i AS INT) AS i FROM asked a, range(0, 1000) g(i) WHERE i < greatest(1, sensor_count)),
    fresh AS (SELECT * FROM slots WHERE NOT EXISTS (SELECT 1 FROM registry r WHERE r.device_id = slots.device_id AND r.device_sensor_index = i)),
    coded AS (SELECT *, 'PHY-' || upper(regexp_replace(device_id, '[^A-Za-z0-9]', '', 'g')) || '-S' || printf('%03d', i) AS code,
              ['Temperature', 'Pressure', 'Vibration', 'Electrical', 'Flow', 'Mechanical', 'Environmental'][i % 7 + 1] AS category FROM fresh)
    SELECT (SELECT max(serial) FROM registry) + row_number() OVER (ORDER BY device_id, i) AS serial, code AS sensor_code, '[' || device_id || '] ' || category || ' Sensor #' || i AS sensor_name,
           'PHYSICAL' AS sensor_type, category, CASE category WHEN 'Temperature' THEN '°C' WHEN 'Pressure' THEN 'bar' WHEN 'Vibration' THEN 'mm/s' WHEN 'Electrical' THEN 'kW' WHEN 'Flow' THEN 'm³/h' WHEN 'Mechanical' THEN 'RPM' ELSE '%' END AS unit,
           device_id, i AS device_sensor_index, CAST(NULL AS STRING) AS formula_expression, 'ACTIVE' AS status FROM coded""")
def synced_device_sensors(t: Tables) -> DataFrame:
    return registry.sync_devices(t.sql(_SYNC), t.registry).select(_NEW)


# Codes that end in _COPY already make their base skip to the next number.
_COPIED = "SELECT serial, sensor_code, sensor_name, sensor_type, category, unit, device_id, device_sensor_index, formula_expression, description, status FROM registry UNION ALL SELECT serial + 1000000, 'F' || CAST(serial - 200001 AS STRING) || CASE WHEN serial % 2 = 0 THEN '_COPY' ELSE '_copy_2' END, 'x', 'FORMULA', 'x', '%', NULL, NULL, 'value', NULL, 'ACTIVE' FROM registry WHERE serial > 200000 AND serial % 6 < 2"


@query(f"""WITH copied AS ({_COPIED}), asked AS (SELECT serial, sensor_code AS base, formula_expression FROM copied WHERE sensor_type = 'FORMULA' AND serial < 1000000 AND serial % 4 < 2),
    tries AS (SELECT serial, base, n, base || '_COPY' || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS code FROM asked, range(1, 6) g(n)),
    free AS (SELECT serial, min(n) AS n FROM tries WHERE upper(code) NOT IN (SELECT upper(sensor_code) FROM copied) GROUP BY serial)
    SELECT (SELECT max(serial) FROM copied) + row_number() OVER (ORDER BY serial) AS serial, code AS sensor_code, formula_expression
    FROM asked JOIN free USING (serial) JOIN tries USING (serial, n, base)""")
def duplicated_formula_sensors(t: Tables) -> DataFrame:
    copied = t.sql(_COPIED)
    asked = copied.filter("serial < 1000000 AND serial % 4 < 2").select("serial")
    return registry.duplicate_formulas(copied, asked).select("serial", "sensor_code", "formula_expression")


@query("""SELECT sensor_type, count(*) AS n, min(serial) AS lowest, max(serial) AS highest FROM (
    SELECT sensor_type, serial FROM registry WHERE sensor_type = 'PHYSICAL'
    UNION ALL SELECT 'FORMULA', (SELECT max(serial) FROM registry WHERE sensor_type = 'PHYSICAL') + i FROM range(1, 6) g(i)) GROUP BY sensor_type""")
def seeded_registry(t: Tables) -> DataFrame:
    physical = t.registry.filter("sensor_type = 'PHYSICAL'").withColumns({n: F.current_timestamp() for n in ("created_at", "updated_at")})
    seeded = registry.seed_registry(physical)
    return seeded.groupBy("sensor_type").agg(F.count("*").alias("n"), F.min("serial").alias("lowest"), F.max("serial").alias("highest"))


# -- catalog and formulas ------------------------------------------------------------------
_META = """meta AS (SELECT CAST(serial AS STRING) AS id, sensor_name AS name, category, unit,
    CASE category WHEN 'Temperature' THEN 65.0 WHEN 'Pressure' THEN 100.0 WHEN 'Flow' THEN 45.0 ELSE 50.0 END::DOUBLE AS mean,
    CASE category WHEN 'Temperature' THEN 3.0 WHEN 'Pressure' THEN 4.0 WHEN 'Flow' THEN 2.0 ELSE 2.5 END::DOUBLE AS std_dev, serial, sensor_code FROM registry)"""


@query(f"""WITH {_META} SELECT id, name, category, unit, mean, greatest(0.0, mean - std_dev * 4) AS min_clamp, mean + std_dev * 4 AS max_clamp FROM meta
    UNION ALL SELECT id, name, category, unit, mean, min_clamp, max_clamp FROM catalog WHERE id NOT IN (SELECT id FROM meta)""")
def merged_catalog(t: Tables) -> DataFrame:
    return catalog.merge_catalogs(t.registry, t.catalog).select("id", "name", "category", "unit", "mean", "min_clamp", "max_clamp")


_ASKED = """SELECT o_orderkey AS n, CASE o_orderkey % 5 WHEN 0 THEN 'P_' || CAST(10001 + o_orderkey % 200 AS STRING) WHEN 1 THEN 'F' || CAST(o_orderkey AS STRING)
    WHEN 2 THEN 'sensor_' || lpad(CAST(o_orderkey % 120 AS STRING), 3, '0') WHEN 3 THEN CAST(200001 + o_orderkey % 3000 AS STRING) ELSE o_orderpriority END AS sensor_id FROM orders"""


@query(f"""WITH {_META}, asked AS ({_ASKED}), joined AS (SELECT n, asked.sensor_id, s.name AS by_serial, c.name AS by_code, k.name AS by_id FROM asked
    LEFT JOIN meta s ON CAST(s.serial AS STRING) = regexp_replace(asked.sensor_id, '^P_', '') LEFT JOIN meta c ON c.sensor_code = asked.sensor_id LEFT JOIN catalog k ON k.id = asked.sensor_id)
    SELECT n, coalesce(by_serial, by_code, by_id, 'Generic Sensor ' || sensor_id) AS name,
           CASE WHEN by_serial IS NOT NULL THEN 'serial' WHEN by_code IS NOT NULL THEN 'code' WHEN by_id IS NOT NULL THEN 'catalog' ELSE 'generic' END AS found_by FROM joined""")
def sensor_meta_lookups(t: Tables) -> DataFrame:
    return catalog.lookup_sensor_meta(t.sql(_ASKED), t.registry, t.catalog).select("n", "meta.name", "found_by")


_SESSION = "SELECT CASE WHEN serial % 2 = 0 THEN id ELSE 'X' || id END AS id, serial, 'session ' || name AS name, expression, category, target_sensor FROM formulas WHERE serial % 5 = 0"


@query(f"""WITH mapped AS (SELECT upper(sensor_code) AS id, sensor_name AS name FROM registry WHERE sensor_type = 'FORMULA')
    SELECT id, name FROM mapped UNION ALL SELECT id, name FROM ({_SESSION}) WHERE id NOT IN (SELECT id FROM mapped)""")
def merged_formulas(t: Tables) -> DataFrame:
    return catalog.merge_formulas(t.registry, t.sql(_SESSION)).select("id", "name")


_FRESH = "SELECT CASE WHEN serial % 3 = 0 THEN lower(id) ELSE 'new ' || id END AS id, serial, 'fresh ' || name AS name, expression, category, target_sensor FROM formulas WHERE serial % 4 = 0"


@query(f"SELECT replace(upper(id), ' ', '_') AS id, name, NOT starts_with(id, 'f') AS accepted FROM ({_FRESH})")
def judged_new_formulas(t: Tables) -> DataFrame:
    return formulas.judge_new_formulas(t.sql(_FRESH), t.formulas).select("id", "name", "accepted")


@query(f"SELECT id, name FROM formulas UNION ALL SELECT replace(upper(id), ' ', '_'), name FROM ({_FRESH}) WHERE NOT starts_with(id, 'f')")
def formulas_after_adding(t: Tables) -> DataFrame:
    return formulas.add_formulas(t.formulas, t.sql(_FRESH)).select("id", "name")


@query("SELECT id, CASE WHEN serial % 6 = 0 THEN 'value * 9' ELSE expression END AS expression, CASE WHEN serial % 6 = 3 THEN 'Changed' ELSE category END AS category FROM formulas")
def updated_formulas(t: Tables) -> DataFrame:
    changes = t.sql("SELECT id, CASE WHEN serial % 6 = 0 THEN 'value * 9' END AS expression, CASE WHEN serial % 6 = 3 THEN 'Changed' END AS category FROM formulas WHERE serial % 3 = 0")
    return formulas.update_formulas(t.formulas, changes).select("id", "expression", "category")


_ITEMS = """SELECT CASE WHEN serial % 10 = 0 THEN '' WHEN serial % 10 = 5 THEN 'NEW' || id ELSE id END AS id, serial, CASE WHEN serial % 15 = 1 THEN NULL ELSE 'imported' END AS name,
    'value + ' || CAST(serial AS STRING) AS expression, category, target_sensor FROM formulas WHERE serial % 2 = 0 OR serial % 5 = 0"""


@query(f"""WITH items AS ({_ITEMS}), usable AS (SELECT id, name, expression FROM items WHERE id <> '' AND name IS NOT NULL)
    SELECT id, name, expression, (SELECT count(*) FROM usable) AS imported FROM (SELECT * FROM usable UNION ALL SELECT id, name, expression FROM formulas WHERE id NOT IN (SELECT id FROM usable))""")
def formulas_after_import(t: Tables) -> DataFrame:
    def tagged(df: DataFrame) -> DataFrame:
        return df.withColumn("tags", F.array().cast("array<string>"))

    merged, count = formulas.import_formulas(tagged(t.formulas), tagged(t.sql(_ITEMS)))
    return merged.select("id", "name", "expression").withColumn("imported", F.lit(count.first()["imported"]).cast("bigint"))


_CHANGED_REGISTRY = "SELECT serial, sensor_code, sensor_name, sensor_type, category, formula_expression || ' + 1' AS formula_expression, description FROM registry WHERE sensor_type = 'FORMULA' AND serial % 3 = 0 AND trim(formula_expression) <> ''"


@query(f"""WITH changed AS ({_CHANGED_REGISTRY}), known AS (SELECT * FROM formulas WHERE serial % 12 <> 0)
    SELECT k.id, coalesce(c.formula_expression, k.expression) AS expression,
           CASE WHEN c.serial IS NULL THEN k.target_sensor ELSE coalesce(nullif(regexp_extract(c.formula_expression, '\\b(?:P_|SN_)?(\\d{{4,6}})\\b', 1), ''),
                nullif(regexp_extract(c.formula_expression, '\\b(sensor_\\d+)\\b', 1), ''), '10001') END AS target_sensor
    FROM known k LEFT JOIN changed c ON c.serial = k.serial
    UNION ALL SELECT sensor_code, formula_expression, coalesce(nullif(regexp_extract(formula_expression, '\\b(?:P_|SN_)?(\\d{{4,6}})\\b', 1), ''),
                nullif(regexp_extract(formula_expression, '\\b(sensor_\\d+)\\b', 1), ''), '10001') FROM changed WHERE serial % 12 = 0""")
def formulas_after_registry_sync(t: Tables) -> DataFrame:
    known = t.formulas.filter("serial % 12 <> 0")
    return formulas.apply_formula_sync(known, t.sql(_CHANGED_REGISTRY)).select("id", "expression", "target_sensor")


@query("SELECT id || '_COPY' AS id, name || ' (Copy)' AS name, expression FROM formulas WHERE serial % 5 = 0")
def copied_formulas(t: Tables) -> DataFrame:
    return formulas.copy_formulas(t.formulas, t.formulas.filter("serial % 5 = 0")).select("id", "name", "expression")
