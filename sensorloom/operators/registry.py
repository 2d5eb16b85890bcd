"""The sensor registry: search, checks and changes as table jobs.

A change takes the registry and a table of requests and gives the new snapshot, or the
requests with their verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.functions.audit import uses_window
from sensorloom.functions.categories import default_category, default_unit, formula_code, sensor_code
from sensorloom.functions.ids import (
    SERIAL_FLOOR, fallback_serial, is_blank, normalize_device_id, parse_composite_id, target_sensor_of,
)
from sensorloom.operators.skew import explode_range, positions
from sensorloom.session import cut, small_side

# The sensors and formulas of an empty registry.
DEFAULT_PHYSICAL = [
    ("PHY-DEVICE001-S000", "[DEVICE-001] Main Bearing Temperature", "Temperature", "°C", "DEVICE-001", 0,
     "IoT Emulator Device-001 Primary Bearing Thermocouple"),
    ("PHY-DEVICE001-S001", "[DEVICE-001] Discharge Pressure", "Pressure", "bar", "DEVICE-001", 1,
     "IoT Emulator Device-001 Outlet Gas Pressure"),
    ("PHY-DEVICE002-S000", "[DEVICE-002] Auxiliary Bearing Temperature", "Temperature", "°C", "DEVICE-002", 0,
     "IoT Emulator Device-002 Secondary Bearing (Avoids index collision with Device-001)"),
    ("PHY-DEVICE002-S001", "[DEVICE-002] Intake Pressure", "Pressure", "bar", "DEVICE-002", 1,
     "IoT Emulator Device-002 Suction Line Pressure"),
]
DEFAULT_FORMULA = [
    ("FML-PUMP-EFF-01", "Pump Differential Compression Ratio", "Efficiency", "ratio", "P_10002 / (P_10004 + 0.001)",
     "Calculated formula sensor comparing discharge vs intake pressure using unified serial numbers"),
    ("FML-THERMAL-DELTA", "Dual-Device Thermal Delta", "Temperature", "°C", "abs(P_10001 - P_10003)",
     "Calculated delta between Device-001 and Device-002 bearing temperatures"),
    ("TEMP_FAHRENHEIT", "Exhaust Temp (°F)", "Temperature", "°F", "P_10001 * 1.8 + 32.0",
     "Converts primary temperature sensor (#10001) from Celsius to Fahrenheit"),
    ("SMOOTHED_TEMP", "10s Sliding Average Temp", "Temperature", "°C", "window_avg(10)",
     "Noise-reduced temperature using 10-second sliding window average"),
    ("POWER_EFFICIENCY_INDEX", "Overall Plant Efficiency Index", "Efficiency", "%",
     "(TEMP_FAHRENHEIT > 140 ? TEMP_FAHRENHEIT * 1.05 : TEMP_FAHRENHEIT) * 0.5 + (SMOOTHED_TEMP * 0.2)",
     "Composite formula sensor referencing sub-formulas [TEMP_FAHRENHEIT, SMOOTHED_TEMP] and conditional logic"),
]
TYPES = ["PHYSICAL", "FORMULA"]
STATUSES = ["ACTIVE", "INACTIVE", "MAINTENANCE"]

# Mappings are broadcast up to this count: rows of a device name and two numbers.
MAPPING_ROWS = 1_000_000

COLUMNS = schemas.REGISTRY.fieldNames()


# -- search and counts ---------------------------------------------------------
def _given(text: str | None) -> str | None:
    return text.strip() if text and text.strip() else None


def search_registry(registry: DataFrame, sensor_type: str | None = None, device: str | None = None, keyword: str | None = None) -> DataFrame:
    """Rows of a type and device with a keyword in name, code, category, formula or serial, by serial.

    `%` and `_` in the keyword stand for any text and any character.
    """
    device, keyword = _given(device), _given(keyword)
    if sensor_type:
        registry = registry.filter(F.col("sensor_type") == sensor_type)
    if device:
        registry = registry.filter(F.col("device_id") == device)
    if keyword:
        pattern = F.lower(F.lit(f"%{keyword}%"))
        hit = F.col("serial").cast("string").like(f"%{keyword}%")
        for column in ("sensor_name", "sensor_code", "category", "formula_expression"):
            hit = hit | F.like(F.lower(F.coalesce(column, F.lit(""))), pattern)
        registry = registry.filter(hit)
    return registry.orderBy("serial")


def filter_registry(registry: DataFrame, sensor_type: str = "ALL", device: str = "ALL", text: str | None = None) -> DataFrame:
    """The same for a list view: also matches the device, plain text, `ALL` for no filter."""
    if sensor_type != "ALL":
        registry = registry.filter(F.col("sensor_type") == sensor_type)
    if device != "ALL":
        registry = registry.filter(F.col("device_id") == device)
    wanted = (_given(text) or "").lower()
    if wanted:
        hit = F.col("serial").cast("string").contains(wanted)
        for column in ("sensor_code", "sensor_name", "category", "device_id", "formula_expression"):
            hit = hit | F.coalesce(F.lower(column).contains(wanted), F.lit(False))
        registry = registry.filter(hit)
    return registry


def active_formulas(registry: DataFrame) -> DataFrame:
    chosen = (F.col("sensor_type") == "FORMULA") & (F.col("status") == "ACTIVE")
    return registry.filter(chosen & ~is_blank(F.col("formula_expression")))


def find_sensors(registry: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry rows for a table of keys (serial, sensor_code or device columns), and the keys without a row."""
    on = keys.columns
    return registry.join(keys.distinct(), on, "left_semi"), keys.distinct().join(registry, on, "left_anti")


def registry_counts(registry: DataFrame) -> DataFrame:
    return registry.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("sensor_type") == "PHYSICAL").alias("physical"),
        F.count_if(F.col("sensor_type") == "FORMULA").alias("formula"),
    )


def registered_devices(registry: DataFrame) -> DataFrame:
    return registry.select("device_id").filter(F.col("device_id").isNotNull()).distinct().orderBy("device_id")


def next_serial(registry: DataFrame) -> DataFrame:
    return registry.agg((F.coalesce(F.max("serial"), F.lit(SERIAL_FLOOR)) + 1).alias("next_serial"))


def check_registry(registry: DataFrame) -> DataFrame:
    """(problem, detail, n): double codes, device slots used twice, unknown types and states."""
    def doubled(df: DataFrame, problem: str, detail: Column) -> DataFrame:
        return df.groupBy(detail.alias("detail")).agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(
            F.lit(problem).alias("problem"), "detail", "n")

    def unknown(problem: str, column: str, allowed: list[str]) -> DataFrame:
        bad = registry.filter(F.col(column).isNull() | ~F.col(column).isin(allowed))
        return bad.groupBy(F.coalesce(column, F.lit("(none)")).alias("detail")).agg(F.count("*").alias("n")).select(
            F.lit(problem).alias("problem"), "detail", "n")

    slots = registry.filter((F.col("sensor_type") == "PHYSICAL") & F.col("device_id").isNotNull())
    slot = F.concat_ws("#", "device_id", F.col("device_sensor_index").cast("string"))
    coded = registry.filter(F.col("sensor_code").isNotNull())
    return (
        doubled(coded, "duplicate_code", F.col("sensor_code"))
        .unionByName(doubled(slots, "duplicate_slot", slot))
        .unionByName(unknown("bad_type", "sensor_type", TYPES))
        .unionByName(unknown("bad_status", "status", STATUSES))
    )


# -- serials ---------------------------------------------------------------------
def mapping_table(registry: DataFrame) -> DataFrame:
    """(device_id, sensor_index, serial) of the physical sensors, devices normalised."""
    physical = registry.filter(
        (F.col("sensor_type") == "PHYSICAL") & F.col("device_id").isNotNull()
        & F.col("device_sensor_index").isNotNull() & F.col("serial").isNotNull()
    )
    slot = [normalize_device_id(F.col("device_id")).alias("device_id"), F.col("device_sensor_index").alias("sensor_index")]
    return physical.groupBy(*slot).agg(F.max("serial").alias("serial"))


def range_mappings(ranges: DataFrame) -> DataFrame:
    """Mappings from rows (device_id, sensor_count, start_serial): consecutive slots and serials."""
    listed = explode_range(ranges.filter(F.col("sensor_count") > 0), F.lit(0), F.col("sensor_count") - 1, "sensor_index")
    listed = listed.withColumn("sensor_index", F.col("sensor_index").cast("int"))
    return listed.select(
        normalize_device_id(F.col("device_id")).alias("device_id"), "sensor_index",
        (F.col("start_serial") + F.col("sensor_index")).alias("serial"),
    )


def resolve_serials(df: DataFrame, mappings: DataFrame, device: str = "device_id", index: str = "sensor_index", out: str = "serial") -> DataFrame:
    """Add the serial of each row's device slot: the registered one, else the computed fallback."""
    known = mappings.select(
        F.col("device_id").alias("_device"), F.col("sensor_index").alias("_index"), F.col("serial").alias("_serial"),
    )
    named = df.withColumn("_name", normalize_device_id(F.col(device)))
    joined = named.join(small_side(known, MAPPING_ROWS), (F.col("_name") == F.col("_device")) & (F.col(index) == F.col("_index")), "left")
    serial = F.coalesce(F.col("_serial"), fallback_serial(F.col("_name"), F.col(index)))
    return joined.withColumn(out, serial).drop("_name", "_device", "_index", "_serial")


def fallback_collisions(slots: DataFrame) -> DataFrame:
    """(serial, slots): computed serials that more than one device slot would get."""
    named = slots.select(normalize_device_id(F.col("device_id")).alias("device_id"), "sensor_index").distinct()
    named = named.withColumn("serial", fallback_serial(F.col("device_id"), F.col("sensor_index")))
    return named.groupBy("serial").agg(F.count("*").alias("slots")).filter(F.col("slots") > 1)


def assign_serials(new: DataFrame, registry: DataFrame, order: list[str]) -> DataFrame:
    """Give consecutive serials after the highest one, in a stable order of the new rows.

    Rows are sorted in ranges and numbered per partition; the partitions' row counts give
    the offsets, so no task sees all rows.
    """
    local = F.monotonically_increasing_id()  # partition number above the 33rd bit, row number below
    placed = cut(new.orderBy(*order).withColumn("_local", local))
    part = F.shiftright("_local", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
    )
    first = next_serial(registry).first()["next_serial"]
    inside = F.col("_local").bitwiseAND(F.lit(2 ** 33 - 1))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn("serial", F.lit(first) + F.col("_offset") + inside).drop("_local", "_part", "_offset")


# -- changes ---------------------------------------------------------------------
def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _rows(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Registry rows in the registry's own columns, with nulls for those that are missing."""
    kinds = {field.name: field.dataType for field in schemas.REGISTRY.fields}
    stamps = {name: F.current_timestamp() if now is None else now for name in ("created_at", "updated_at")}
    missing = {n: stamps.get(n, F.lit(None).cast(k)) for n, k in kinds.items() if n not in df.columns}
    return df.withColumns(missing).select(*[F.col(n).cast(kinds[n]) for n in COLUMNS])


def seed_registry(registry: DataFrame) -> DataFrame:
    """The registry with the default rows of each type that has no rows yet."""
    spark = registry.sparkSession
    counts = registry_counts(registry).first()
    physical = spark.createDataFrame(
        DEFAULT_PHYSICAL, "sensor_code string, sensor_name string, category string, unit string, device_id string, "
        "device_sensor_index int, description string",
    ).withColumns({"sensor_type": F.lit("PHYSICAL"), "formula_expression": _null("string")})
    formula = spark.createDataFrame(
        DEFAULT_FORMULA, "sensor_code string, sensor_name string, category string, unit string, formula_expression string, "
        "description string",
    ).withColumns({"sensor_type": F.lit("FORMULA"), "device_id": _null("string"), "device_sensor_index": _null("int")})
    wanted = physical.filter(F.lit(counts["physical"] == 0)).unionByName(formula.filter(F.lit(counts["formula"] == 0)))
    wanted = wanted.join(registry.select("sensor_code"), "sensor_code", "left_anti")
    slots = registry.select("device_id", "device_sensor_index").filter(F.col("device_id").isNotNull())
    wanted = wanted.join(slots, ["device_id", "device_sensor_index"], "left_anti").withColumn("status", F.lit("ACTIVE"))
    wanted = wanted.withColumn("_type_rank", F.when(F.col("sensor_type") == "PHYSICAL", 0).otherwise(1))
    codes = F.array(*[F.lit(row[0]) for row in [*DEFAULT_PHYSICAL, *DEFAULT_FORMULA]])
    wanted = wanted.withColumn("_rank", F.array_position(codes, F.col("sensor_code")))
    return registry.select(*COLUMNS).unionByName(_rows(assign_serials(wanted, registry, ["_rank"])))


def judge_new_sensors(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests with `reason`: why a sensor cannot be created, null if it can.

    Of several requests for one device slot, the first by `request_id` gets it.
    """
    physical = F.col("sensor_type") == "PHYSICAL"
    requests = requests.withColumn("device_id", F.trim("device_id"))  # as it is stored
    taken = registry.filter(F.col("device_id").isNotNull()).select("device_id", "device_sensor_index").distinct()
    joined = requests.join(taken.withColumn("_taken", F.lit(True)), ["device_id", "device_sensor_index"], "left")
    firsts = requests.filter(physical).groupBy("device_id", "device_sensor_index").agg(F.min("request_id").alias("_first"))
    joined = joined.join(firsts, ["device_id", "device_sensor_index"], "left")
    reason = (
        F.when(F.col("sensor_type").isNull() | ~F.col("sensor_type").isin(TYPES), "no_type")
        .when(is_blank(F.col("sensor_name")), "no_name")
        .when(physical & is_blank(F.col("device_id")), "no_device")
        .when(physical & F.col("device_sensor_index").isNull(), "no_index")
        .when(physical & (F.col("_taken") | (F.col("request_id") > F.col("_first"))), "slot_taken")
        .when(~physical & is_blank(F.col("formula_expression")), "no_formula")
    )
    return joined.withColumn("reason", reason).select(*requests.columns, "reason")


def create_sensors(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows for the accepted requests, with serials, codes and defaults.

    A code that is taken, in the registry or by an earlier request, gets the serial as suffix.
    """
    accepted = judge_new_sensors(requests, registry).filter(F.col("reason").isNull())
    numbered = cut(assign_serials(accepted, registry, ["request_id"]))
    physical = F.col("sensor_type") == "PHYSICAL"
    made = F.when(physical, sensor_code(F.col("device_id"), F.col("device_sensor_index"))).otherwise(formula_code(F.col("serial")))
    coded = numbered.withColumn("_code", F.when(is_blank(F.col("sensor_code")), made).otherwise(F.col("sensor_code")))
    used = registry.select(F.col("sensor_code").alias("_code")).filter("_code is not null").distinct()
    coded = coded.join(used.withColumn("_used", F.lit(True)), "_code", "left")
    firsts = coded.groupBy("_code").agg(F.min("serial").alias("_first"))
    coded = coded.join(firsts, "_code")
    again = F.col("_used").isNotNull() | (F.col("serial") > F.col("_first"))
    code = F.when(again, F.concat_ws("-", "_code", F.col("serial").cast("string"))).otherwise(F.col("_code"))
    return _rows(coded.select(
        "serial", code.alias("sensor_code"), F.trim("sensor_name").alias("sensor_name"), "sensor_type",
        F.coalesce(F.trim("category"), F.lit("General")).alias("category"), F.coalesce(F.trim("unit"), F.lit("")).alias("unit"),
        F.when(physical, F.trim("device_id")).alias("device_id"),
        F.when(physical, F.col("device_sensor_index")).alias("device_sensor_index"),
        F.when(~physical, F.trim("formula_expression")).alias("formula_expression"),
        "description", F.coalesce("status", F.lit("ACTIVE")).alias("status"),
    ))


def _unknown_serials(requests: DataFrame, registry: DataFrame) -> DataFrame:
    return requests.select("serial").distinct().join(registry.select("serial"), "serial", "left_anti")


def fold_changes(changes: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row of changes per key: of each field the last given value by `order`.

    Without an order, several changes of one key are an error, as nothing says which stands.
    """
    fields = [name for name in changes.columns if name not in (key, order)]
    if order is None:
        double = changes.groupBy(key).count().filter("count > 1").limit(5).collect()
        if double:
            raise ValueError(f"several changes for one {key}, and no order: {[row[0] for row in double]}")
        return changes.select(key, *fields)
    last = [F.max_by(name, F.when(F.col(name).isNotNull(), F.struct(order, name))).alias(name) for name in fields]
    return changes.groupBy(key).agg(*last)


def update_sensors(registry: DataFrame, changes: DataFrame, strict: bool = True, order: str | None = None) -> DataFrame:
    """The registry after a table of changes: null keeps a field.

    Several changes of one serial are taken in the order of the column `order`, see
    `fold_changes`. A blank name is ignored, and only formula sensors take a formula. An
    unknown serial is an error, or is left out when not `strict`.
    """
    if "sensor_name" in changes.columns:
        changes = changes.withColumn("sensor_name", F.when(~is_blank(F.col("sensor_name")), F.col("sensor_name")))
    changes = fold_changes(changes, "serial", order)
    if strict:
        unknown = _unknown_serials(changes, registry).limit(5).collect()
        if unknown:
            raise ValueError(f"unknown serials: {[row[0] for row in unknown]}")
    fields = ["sensor_name", "category", "unit", "description", "status", "formula_expression"]
    fields = [name for name in fields if name in changes.columns]
    given = changes.select("serial", *[F.col(name).alias(f"_{name}") for name in fields], F.lit(True).alias("_changed"))
    joined = registry.join(given, "serial", "left")
    new: dict[str, Column] = {}
    for name in fields:
        asked = F.col(f"_{name}") if name in ("description", "status") else F.trim(f"_{name}")
        if name == "sensor_name":
            asked = F.when(~is_blank(F.col("_sensor_name")), asked)
        if name == "formula_expression":
            asked = F.when(F.col("sensor_type") == "FORMULA", asked)
        new[name] = F.coalesce(asked, F.col(name))
    if "updated_at" in registry.columns:
        new["updated_at"] = F.when(F.col("_changed"), F.current_timestamp()).otherwise(F.col("updated_at"))
    return joined.withColumns(new).select(*registry.columns)


def delete_sensors(registry: DataFrame, deletes: DataFrame, strict: bool = True) -> DataFrame:
    """The registry without some serials; an unknown one is an error, or ignored when not `strict`."""
    if strict:
        unknown = _unknown_serials(deletes, registry).limit(5).collect()
        if unknown:
            raise ValueError(f"unknown serials: {[row[0] for row in unknown]}")
    return registry.join(deletes.select("serial").distinct(), "serial", "left_anti")


def sync_devices(devices: DataFrame, registry: DataFrame, skip_existing: bool = True) -> DataFrame:
    """New rows for all slots of rows (device_id, sensor_count), at least one per device.

    A device that is listed twice gets its highest count. A code that the registry has gets
    the slot as suffix; one that is still not alone gets the serial as well.
    """
    named = devices.filter(~is_blank(F.col("device_id"))).groupBy(F.trim("device_id").alias("device_id")).agg(
        F.greatest(F.lit(1), F.max("sensor_count")).alias("_count"),
    )
    slots = explode_range(named, F.lit(0), F.col("_count") - 1, "device_sensor_index").drop("_count")
    slots = slots.withColumn("device_sensor_index", F.col("device_sensor_index").cast("int"))
    if skip_existing:
        slots = slots.join(registry.select("device_id", "device_sensor_index"), ["device_id", "device_sensor_index"], "left_anti")
    code = sensor_code(F.col("device_id"), F.col("device_sensor_index"))
    used = registry.select(F.col("sensor_code").alias("_code")).distinct().withColumn("_used", F.lit(True))
    coded = slots.withColumn("_code", code).join(used, "_code", "left")
    category = default_category(F.col("device_sensor_index"))
    made = coded.select(
        F.when(F.col("_used"), F.concat_ws("_", "_code", F.col("device_sensor_index").cast("string")))
        .otherwise(F.col("_code")).alias("sensor_code"),
        F.format_string("[%s] %s Sensor #%d", "device_id", category, "device_sensor_index").alias("sensor_name"),
        F.lit("PHYSICAL").alias("sensor_type"), category.alias("category"), default_unit(category).alias("unit"),
        "device_id", "device_sensor_index",
        F.format_string("Auto-synced from IoT Emulator device '%s' with unique serial number.", "device_id").alias("description"),
        F.lit("ACTIVE").alias("status"),
    )
    numbered = cut(assign_serials(made, registry, ["device_id", "device_sensor_index"]))
    taken = registry.select("sensor_code").filter("sensor_code is not null").distinct().withColumn("_taken", F.lit(True))
    firsts = numbered.groupBy("sensor_code").agg(F.min("serial").alias("_first"))
    settled = numbered.join(firsts, "sensor_code").join(taken, "sensor_code", "left")
    again = F.col("_taken").isNotNull() | (F.col("serial") > F.col("_first"))
    code = F.when(again, F.concat_ws("-", "sensor_code", F.col("serial").cast("string"))).otherwise(F.col("sensor_code"))
    return _rows(settled.withColumn("sensor_code", code).drop("_first", "_taken"))


def duplicate_formulas(registry: DataFrame, serials: DataFrame) -> DataFrame:
    """Copies of formula sensors under the first free code X_COPY, X_COPY_2, ... (case ignored).

    Copies of one base take the free codes in the order of their serials.
    """
    wanted = registry.join(serials.select("serial").distinct(), "serial", "left_semi").filter(F.col("sensor_type") == "FORMULA")
    base = F.regexp_replace("sensor_code", "[^A-Za-z0-9_-]", "_")
    wanted = wanted.withColumns({"_base": base, "_fold": F.upper(base)})
    wanted = positions(wanted, ["_fold"], ["serial"], "_nth")
    # A base with k taken copy codes and m copies to make finds room among its first k + m codes.
    taken = registry.select(F.upper("sensor_code").alias("_taken"))
    copy = F.regexp_extract("_taken", r"^(.*)_COPY(?:_([1-9]\d*))?$", 1).alias("_fold")
    number = F.regexp_extract("_taken", r"^(.*)_COPY(?:_([1-9]\d*))?$", 2)
    number = F.when(number == "", 1).otherwise(number.try_cast("bigint")).alias("_number")
    used = taken.filter(F.col("_taken").rlike(r"_COPY(_[1-9]\d*)?$") & ~F.col("_taken").rlike("_COPY_1$")).select(copy, number).distinct()
    load = used.groupBy("_fold").agg(F.count("*").alias("_k"))
    asked = wanted.groupBy("_fold").agg(F.count("*").alias("_m"))
    tries = explode_range(asked.join(load, "_fold", "left"), F.lit(1), F.coalesce("_k", F.lit(0)) + F.col("_m"), "_number")
    free = tries.select("_fold", "_number").join(used, ["_fold", "_number"], "left_anti")
    free = positions(free, ["_fold"], ["_number"], "_nth")
    placed = wanted.join(free, ["_fold", "_nth"])
    suffix = F.when(F.col("_number") == 1, "_COPY").otherwise(F.concat(F.lit("_COPY_"), F.col("_number").cast("string")))
    made = placed.select(
        F.col("serial").alias("source_serial"), F.concat("_base", suffix).alias("sensor_code"),
        F.concat("sensor_name", F.lit(" (Copy)")).alias("sensor_name"), "sensor_type", "category", "unit",
        F.coalesce(F.when(F.col("formula_expression") != "", F.col("formula_expression")), F.lit("value * 1.0")).alias("formula_expression"),
        "description", "status",
    )
    return _rows(assign_serials(made, registry, ["source_serial"]))


# -- rules -------------------------------------------------------------------------
def rules_of_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rules to publish after a change of the registry: those of active formula rows that are new or differ from before."""
    def usable(registry: DataFrame) -> DataFrame:
        return rules_from_registry(registry).filter(~is_blank(F.col("expression")))

    fields = schemas.RULE.fieldNames()
    old = usable(before).select(*fields).withColumnsRenamed({name: f"_{name}" for name in fields})
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in fields]
    return usable(after).join(old, same, "left_anti")


def rules_from_registry(registry: DataFrame, strict: bool = False) -> DataFrame:
    """The rules of all active formula sensors; `seq` is the serial, so later sensors win."""
    text = F.trim("formula_expression")
    name = F.when(~is_blank(F.col("sensor_code")), F.col("sensor_code")).otherwise(F.col("serial").cast("string"))
    return active_formulas(registry).select(
        F.col("serial").alias("seq"), F.concat(F.lit("rule_"), name).alias("rule_id"),
        target_sensor_of(F.col("formula_expression"), F.col("device_id"), strict).alias("target_sensor_id"),
        text.alias("expression"), uses_window(text).alias("uses_window"),
        F.col("serial").cast("string").alias("derived_sensor_id"),
    )


def rule_count(registry: DataFrame) -> DataFrame:
    return rules_from_registry(registry).agg(F.count("*").alias("published"))


def resolve_or_keep(df: DataFrame, mappings: DataFrame, column: str, out: str) -> DataFrame:
    """Ids with device slots (`DEVICE#5`) replaced by serials; serials are trimmed, others kept as they are."""
    text = F.trim(column)
    is_serial = text.rlike(r"^\d+$") | text.startswith("P_") | text.startswith("SN_")
    slots = df.withColumn("_slot", F.when(~is_serial, parse_composite_id(text)))
    slots = slots.withColumns({"_slot_device": F.col("_slot.device_id"), "_slot_index": F.col("_slot.sensor_index")})
    numbered = resolve_serials(slots, mappings, "_slot_device", "_slot_index", "_slot_serial")
    kept = F.when(is_serial, text).otherwise(F.col(column))
    resolved = F.when(F.col("_slot").isNotNull(), F.col("_slot_serial").cast("string")).otherwise(kept)
    return numbered.withColumn(out, resolved).drop("_slot", "_slot_device", "_slot_index", "_slot_serial")
