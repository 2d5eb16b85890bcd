"""A formula with the formulas it uses, over several sensors."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.formula import formula_column, window_calls
from sensorloom.functions.numbers import round_half_up
from sensorloom.operators.align import align_series, decimate
from sensorloom.operators.graph import DEFAULT_PRIMARY, formula_references, formula_tree
from sensorloom.operators.templates import evaluate_shapes, shapes_of, with_shape
from sensorloom.operators.windows import rolling_by_position

# Usual length of a run, for callers who want one; decimation of a preview; the values of a dry run.
DURATION = 3600
PREVIEW_STEP = 10
DRY_VALUE, DRY_SENSOR, DRY_FORMULA = 50.0, 45.5, 72.0

_PREFIXED = re.compile(r"(?:P_|SN_)(\d+)", re.IGNORECASE)


def _canonical(name: str) -> str:
    match = _PREFIXED.fullmatch(name.strip())
    return match.group(1) if match else name.strip()


def composite_plan(formulas: DataFrame, target: str, primary: str | None = None) -> tuple[list, list[str], str]:
    """Formula rows in evaluation order, needed sensors, and the primary sensor of a target.

    This is the part of a formula table that the plan is made from: the tree of one formula.
    """
    steps, named = formula_tree(formulas, target)
    if not steps:
        raise ValueError(f"no formula {target}")
    own = next(row for row in steps if row["id"] == target)
    first = primary or own["target_sensor"] or DEFAULT_PRIMARY
    aimed = [row["target_sensor"] for row in steps if row["target_sensor"]]
    return steps, list(dict.fromkeys(_canonical(sensor) for sensor in [first, *aimed, *named])), _canonical(first)


def _scope(sensors: Sequence[str], steps: Sequence, primary: str):
    bound = {"value": F.col(f"`{primary}`")}
    for sensor in sensors:
        for name in {sensor, f"P_{sensor}", f"SN_{sensor}"} if sensor.isdigit() else {sensor}:
            bound[name] = F.col(f"`{sensor}`")

    def with_formulas(done: Sequence) -> dict[str, Column]:
        names = dict(bound)
        for row in done:
            column = F.col(f"`{row['id']}`")
            names[row["id"]] = column
            if row["serial"]:
                names[f"P_{row['serial']}"] = names[f"SN_{row['serial']}"] = column
        return names

    return with_formulas


def evaluate_steps(aligned: DataFrame, steps: Sequence, sensors: Sequence[str], primary: str) -> DataFrame:
    """Add one column per formula, in order, and `failures`, the formulas that failed in this row."""
    calls = set().union(*(window_calls(row["expression"]) for row in steps))
    df = rolling_by_position(aligned, calls, value=f"`{primary}`")
    windows = {call: F.col(call.column) for call in calls if call.column in df.columns}
    scope, failures = _scope(sensors, steps, primary), F.lit(0)
    for at, row in enumerate(steps):
        raw = f"_raw_{at}"
        df = df.withColumn(raw, formula_column(row["expression"], scope(steps[:at]), windows, "ui"))
        result = F.col(raw)
        df = df.withColumn(row["id"], F.when(result.isNull() | F.isnan(result), 0.0).otherwise(result))
        failures = failures + result.isNull().cast("int")
    df = df.withColumn("failures", failures)
    return df.drop(*[f"_raw_{at}" for at in range(len(steps))], *[call.column for call in calls])


def evaluate_composite(
    readings: DataFrame,
    formulas: DataFrame,
    target: str,
    primary: str | None = None,
    duration: int | None = None,
    step: int = 1,
    by: str = "position",
    missing: str = "truncate",
    order: Sequence[str] | None = None,
    plan: tuple | None = None,
) -> DataFrame:
    """Points of a target formula: pos, ts, primary value, computed value, and each formula's own column.

    Formulas run in dependency order, so that each can use the results of those before it;
    windows run over the primary sensor. A run ends with the shortest series, or after
    `duration` steps if given. `step` keeps every step-th point. `order` names
    the columns that order the readings of a sensor; `plan` saves looking up the formula
    tree again, see `composite_plan`.
    """
    steps, sensors, first = plan or composite_plan(formulas, target, primary)
    keyed = readings.withColumn("sensor_id", F.regexp_replace("sensor_id", r"(?i)^(?:P_|SN_)(\d+)$", "$1"))
    aligned = align_series(keyed, sensors, duration, by, missing, first, order)
    done = evaluate_steps(aligned, steps, sensors, first)
    points = done.select(
        "pos", "ts", F.col(f"`{first}`").alias("primary_value"),
        round_half_up(F.col(f"`{target}`"), 3).alias("computed_value"),
        *[F.col(f"`{row['id']}`") for row in steps], "failures",
    )
    return decimate(points, step) if step > 1 else points


def simulation_metrics(points: DataFrame, step: int = 1, with_deviation: bool = True) -> DataFrame:
    """Count, lowest, highest, average, deviation of the kept points, and failures of all points.

    `points` are undecimated; `step` says which of them are kept.
    """
    kept = F.when(F.col("pos") % max(1, step) == 0, F.col("computed_value"))

    def rounded(column: Column) -> Column:
        return round_half_up(F.coalesce(column, F.lit(0.0)), 2)

    return points.agg(
        F.count(kept).alias("total_points"),
        rounded(F.min(kept)).alias("min"),
        rounded(F.max(kept)).alias("max"),
        rounded(F.avg(kept)).alias("avg"),
        (rounded(F.stddev_pop(kept)) if with_deviation else F.lit(0.0)).alias("std_dev"),
        F.coalesce(F.sum("failures"), F.lit(0)).cast("bigint").alias("nan_count"),
    )


def dry_run(formulas: DataFrame, expression: str, known: DataFrame | None = None) -> DataFrame:
    """One row with `result`: the formula on fixed stand-in values, rounded to three places."""
    spark = formulas.sparkSession
    one = spark.range(1).select(F.lit("").alias("id"), F.lit(None).cast("bigint").alias("serial"), F.lit(expression).alias("expression"))
    named = formula_references(one, formulas if known is None else known).select("kind", "ref").collect()
    scope: dict[str, Column] = {"value": F.lit(DRY_VALUE)}
    for row in named:
        if row["kind"] == "sensor":
            for name in (row["ref"], f"P_{row['ref']}", f"SN_{row['ref']}"):
                scope[name] = F.lit(DRY_SENSOR)
        else:
            scope[row["ref"]] = F.lit(DRY_FORMULA)
    windows = {call: F.lit(DRY_VALUE) for call in window_calls(expression)}
    return spark.range(1).select(round_half_up(formula_column(expression, scope, windows, "ui"), 3).alias("result"))


def dry_run_table(formulas: DataFrame) -> DataFrame:
    """(id, result) of a dry run of every formula of a table, by formula shape.

    Sensors and formulas are put in by their stand-in values first, so that formulas that
    differ in names and numbers only share one Column.
    """
    references = formula_references(formulas)
    stand_in = F.when(F.col("kind") == "sensor", DRY_SENSOR).otherwise(DRY_FORMULA)
    named = references.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("ref", stand_in))).alias("_names"))
    tokens = F.regexp_extract_all("expression", F.lit(r"[A-Za-z_]\w*|[^A-Za-z_]+"), F.lit(0))
    joined = formulas.join(named, formulas["id"] == named["src"], "left").drop("src")
    key = F.transform(tokens, lambda t: F.coalesce(
        F.try_element_at(F.col("_names"), t),
        F.try_element_at(F.col("_names"), F.regexp_replace(t, r"^(?:P_|SN_)(\d+)$", "$1")),
    ))
    texts = F.zip_with(tokens, key, lambda t, v: F.when(
        t.rlike(r"^[A-Za-z_]\w*$") & v.isNotNull(), v.cast("string"),
    ).otherwise(t))
    filled = joined.withColumn("_filled", F.array_join(texts, ""))
    shaped = with_shape(
        filled.withColumns({"value": F.lit(DRY_VALUE), "state": F.lit(None).cast("int"), "_key": F.lit("")}), "_filled", "_key",
    )
    shaped = shaped.drop("_names")
    done = evaluate_shapes(shaped, shapes_of(shaped), lambda call: F.col("value"), dialect="ui")
    return done.select("id", round_half_up(F.col("result"), 3).alias("result"))
