"""Rules that watch readings: matching, evaluation, output rows and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.audit import usable_rules
from sensorloom.functions.ids import canonical_serial_id, output_sensor_id
from sensorloom.operators.skew import SPLIT_ROWS
from sensorloom.operators.templates import evaluate_shapes, shape_windows, shapes_of, with_shape
from sensorloom.operators.windows import known_windows, rolling
from sensorloom.session import cut, small_side

# Fixed value: history of a stream is held for this long.
RETENTION_SECONDS = 1800

# Rule versions, or groups of them, that one reading is compared with per level.
FAN_OUT = 32

_RULE_COLUMNS = ["rule_id", "expression", "derived_sensor_id", "uses_window", "shape", "numbers", "rule_from"]


def current_rules(rules: DataFrame, multi: bool = False) -> DataFrame:
    """The usable rule in force per target: the last one by `seq`.

    `multi` keeps the last version of every rule instead of one rule per target.
    """
    usable = usable_rules(rules)
    keys = ["rule_key", "rule_id"] if multi else ["rule_key"]
    rest = [c for c in usable.columns if c not in keys]
    last = usable.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("last"))
    return last.select(*keys, "last.*")


def rule_versions(rules: DataFrame) -> DataFrame:
    """Usable rules with the arrival numbers between which they hold: [rule_from, rule_until)."""
    usable = usable_rules(rules)
    later = F.lead("seq").over(Window.partitionBy("rule_key").orderBy("seq"))
    return usable.withColumns({"rule_from": F.col("seq"), "rule_until": later})


def _prepared(rules: DataFrame, as_of: bool, multi: bool) -> DataFrame:
    if as_of:
        chosen = rule_versions(rules)
    else:
        chosen = current_rules(rules, multi).withColumns({
            "rule_from": F.lit(None).cast("bigint"), "rule_until": F.lit(None).cast("bigint"),
        })
    return with_shape(chosen).select("rule_key", "rule_until", *_RULE_COLUMNS)


def _keyed(readings: DataFrame) -> DataFrame:
    return readings.withColumn("reading_key", canonical_serial_id(F.col("sensor_id")))


def _joined(readings: DataFrame, prepared: DataFrame, as_of: bool) -> DataFrame:
    """Readings with the columns of their rule; `prepared` is small and made once."""
    keyed = _keyed(readings)
    if as_of:
        keyed, prepared = _narrowed(keyed, prepared)
    matches = F.col("reading_key") == F.col("rule_key")
    if as_of:
        matches = matches & F.col("_node").eqNullSafe(F.col("_parent")) & _held("rule_from", "rule_until")
    joined = keyed.join(small_side(prepared), matches, "left")
    return joined.drop("rule_until", "rule_key", "_node", "_parent")


def _held(low: str, high: str) -> Column:
    return (F.col("seq") >= F.col(low)) & (F.col(high).isNull() | (F.col("seq") < F.col(high)))


def _narrowed(keyed: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lead each reading to a group of at most FAN_OUT rule versions of its key.

    The versions of a key are numbered and grouped, and the groups grouped again, like the
    pages of an index, so that a reading is compared with a few ranges per level however
    often the rule of its sensor has changed. Adds `_node` to the readings and `_parent`
    to the versions.
    """
    number = F.row_number().over(Window.partitionBy("rule_key").orderBy("rule_from")) - 1
    versions = versions.withColumn("_number", number)
    most = versions.agg(F.max("_number")).first()[0] or 0
    levels = 0
    while most >= FAN_OUT ** (levels + 1):
        levels += 1

    def group(level: int) -> Column:
        return F.floor(F.col("_number") / FAN_OUT ** level)

    keyed = keyed.withColumn("_node", F.lit(0).cast("bigint"))
    for level in range(levels, 0, -1):
        pages = versions.groupBy(F.col("rule_key").alias("_key"), group(level).alias("_page"), group(level + 1).alias("_above")).agg(
            F.min("rule_from").alias("_low"),
        )
        until = F.lead("_low").over(Window.partitionBy("_key").orderBy("_page"))
        pages = pages.withColumn("_high", until)
        matches = (F.col("reading_key") == F.col("_key")) & (F.col("_node") == F.col("_above")) & _held("_low", "_high")
        keyed = keyed.join(small_side(pages), matches, "left").drop("_node", "_key", "_above", "_low", "_high")
        keyed = keyed.withColumnRenamed("_page", "_node")
    return keyed, versions.withColumn("_parent", group(1)).drop("_number")


def match_rules(readings: DataFrame, rules: DataFrame, multi: bool = False) -> DataFrame:
    """Each reading with its current rule, or with nulls."""
    return _joined(readings, cut(_prepared(rules, False, multi)), False)


def rules_as_of(readings: DataFrame, rules: DataFrame) -> DataFrame:
    """Each reading with the latest rule that had arrived before it.

    Rule versions hold over ranges of arrival numbers, so this is a lookup by key and
    range, see `_narrowed`, and needs no sort of the readings.
    """
    return _joined(readings, cut(_prepared(rules, True, False)), True)


def _runs(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of windowed evaluation per sensor: number, first time, and rows of each rule version.

    A reading without a windowed rule ends a run. Whether a version of a rule met any
    reading is known after one small aggregate per version.
    """
    origin = F.coalesce(F.col("rule_from"), F.lit(-1))
    met = (
        matched.groupBy(*keys, origin.alias("_from"), F.coalesce(F.col("uses_window"), F.lit(False)).alias("_windowed"))
        .agg(F.min("ts").alias("_start"), F.count("*").alias("_rows"), F.min("seq").alias("_low"), F.max("seq").alias("_high"))
    )
    so_far = Window.partitionBy(*keys).orderBy("_from").rowsBetween(Window.unboundedPreceding, 0)
    numbered = met.withColumn("run", F.sum(F.when(F.col("_windowed"), 0).otherwise(1)).over(so_far))
    windowed = numbered.filter("_windowed")
    start = F.min("_start").over(Window.partitionBy(*keys, "run"))
    return windowed.withColumn("run_start", start).select(*keys, "_from", "run", "run_start", "_rows", "_low", "_high")


def evaluate_rules(
    readings: DataFrame,
    rules: DataFrame,
    as_of: bool = False,
    multi: bool = False,
    retention_seconds: int = RETENTION_SECONDS,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Every reading with its rule and `result`, null where there is no rule or it fails.

    `inaccurate_result` is true while the history of a windowed rule is younger than the
    retention time. Readings with plain rules are not shuffled at all.
    """
    if as_of and multi:
        raise ValueError("rule versions are kept for one rule per target")
    prepared = cut(_prepared(rules, as_of, multi))  # used several times, and small next to the readings
    # Whether history is kept depends on the text, so one shape may stand on both sides.
    windowed_shapes = shapes_of(prepared.filter("uses_window"))
    plain_shapes = shapes_of(prepared.filter("NOT uses_window"))
    matched = _joined(readings, prepared, as_of)

    if not windowed_shapes:
        plain = evaluate_shapes(matched, plain_shapes, lambda call: None)
        return plain.withColumn("inaccurate_result", F.lit(False))

    windowed_flag = F.coalesce(F.col("uses_window"), F.lit(False))
    plain = evaluate_shapes(matched.filter(~windowed_flag), plain_shapes, lambda call: None)
    plain = plain.withColumn("inaccurate_result", F.lit(False))

    keys = ["reading_key", "rule_id"] if multi else ["reading_key"]
    watched = prepared.filter("uses_window").select(F.col("rule_key").alias("reading_key")).distinct()
    concerned = matched.join(small_side(watched), "reading_key", "left_semi")
    runs = cut(_runs(concerned, keys))  # at most one row per windowed rule version
    profile = runs.groupBy(*keys, "run").agg(F.sum("_rows").alias("_rows"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    windowed = matched.filter(windowed_flag).withColumn("_from", F.coalesce(F.col("rule_from"), F.lit(-1)))
    windowed = windowed.join(small_side(runs.drop("_rows", "_low", "_high")), [*keys, "_from"]).drop("_from")
    wanted = set().union(*map(shape_windows, windowed_shapes))
    windowed = rolling(
        windowed, wanted, keys=[*keys, "run"], order=["seq"], cap=None, within=("ts", retention_seconds),
        split_rows=split_rows, profile=profile,
    )
    windowed = evaluate_shapes(
        windowed, windowed_shapes, lambda call: F.col(call.column) if call.name in known_windows() else None,
    )
    young = F.unix_micros("ts") - F.unix_micros("run_start") < int(retention_seconds * 1_000_000)
    windowed = windowed.withColumn("inaccurate_result", young)
    return plain.unionByName(windowed.select(*plain.columns))


_OUTPUT = ["sensor_id", "device_id", "sensor_index", "ts", "value", "state", "has_inaccurate_data"]


def emit_raw_and_derived(evaluated: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Derived rows (`ord` 0) next to the readings they come from (`ord` 1).

    Both come out of one pass; `raw` gives the readings apart, for when a reading may
    stand in `evaluated` more than once.
    """
    lead = ["seq"] if "seq" in evaluated.columns else []
    derived = {
        "ord": F.lit(0), "sensor_id": output_sensor_id(F.col("derived_sensor_id"), F.col("sensor_id")),
        "value": F.col("result"), "has_inaccurate_data": F.col("inaccurate_result"),
    }
    source = {"ord": F.lit(1)}

    def row(given: dict[str, Column]) -> list[Column]:
        return [given.get(name, F.col(name)).alias(name) for name in [*lead, "ord", *_OUTPUT]]

    if raw is not None:
        return evaluated.filter(F.col("result").isNotNull()).select(*row(derived)).unionByName(raw.select(*row(source)))
    both = F.array(F.when(F.col("result").isNotNull(), F.struct(*row(derived))), F.struct(*row(source)))
    rows = evaluated.select(F.explode(both).alias("row")).filter(F.col("row").isNotNull())
    return rows.select("row.*")


def apply_rules(readings: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """Raw and derived rows of all readings under all rules; options as in `evaluate_rules`."""
    return emit_raw_and_derived(evaluate_rules(readings, rules, **options), readings if options.get("multi") else None)


def counter_columns() -> list[Column]:
    """Aggregates of evaluated readings: results, readings without a rule, and failures."""
    ruled = F.col("expression").isNotNull()
    return [
        F.count_if(ruled & F.col("result").isNotNull()).alias("hits"),
        F.count_if(~ruled).alias("misses"),
        F.count_if(ruled & F.col("result").isNull()).alias("errors"),
    ]


def rule_counters(evaluated: DataFrame) -> DataFrame:
    """Evaluations that gave a result, readings without a rule, and failures."""
    return evaluated.agg(*counter_columns())
