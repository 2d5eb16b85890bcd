"""Changes to the table of formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.functions.categories import clean_formula_id
from sensorloom.functions.ids import primary_sensor_of
from sensorloom.operators.catalog import registry_to_formulas
from sensorloom.operators.graph import find_formulas
from sensorloom.operators.registry import fold_changes
from sensorloom.operators.skew import explode_range
from sensorloom.session import shuffled

# The formulas of a fresh or reset table (id, name, category, target, expression, tags).
DEFAULTS = [
    ("TEMP_FAHRENHEIT", "Exhaust Temp (°F)", "Thermal", "10001", "P_10001 * 1.8 + 32", ["Conversion", "Thermal"]),
    ("SMOOTHED_TEMP", "10s Sliding Average Temp", "Thermal", "10001", "window_avg(10)", ["Window", "Smoothing"]),
    ("PRESSURE_DELTA", "Hydraulic Differential Pressure", "Pressure", "10002", "abs(P_10002 - P_10004)", ["Delta", "Hydraulics"]),
    ("NORMALIZED_HEAT", "Normalized Heat Quotient (Calls TEMP_FAHRENHEIT)", "Composite", "10001",
     "(TEMP_FAHRENHEIT - 32) / 1.8 * 0.95", ["Composite", "Thermal"]),
    ("POWER_EFFICIENCY_INDEX", "Overall Plant Efficiency Index (Calls NORMALIZED_HEAT & SMOOTHED_TEMP)", "Composite", "10001",
     "(NORMALIZED_HEAT > 60 ? NORMALIZED_HEAT * 1.15 : NORMALIZED_HEAT) + (SMOOTHED_TEMP * 0.2)", ["Composite", "KPI", "Plant"]),
]

_FIELDS = [name for name in schemas.FORMULA.fieldNames() if name != "id"]


def default_formulas(spark: SparkSession) -> DataFrame:
    rows = [(i, None, n, e, c, t, tags, None, None, None, None) for i, n, c, t, e, tags in DEFAULTS]
    return spark.createDataFrame(rows, schemas.FORMULA)


def judge_new_formulas(new: DataFrame, formulas: DataFrame) -> DataFrame:
    """New formulas under their cleaned id, with `accepted`: false where the id is in use.

    Of equal ids among the new ones the first by name and expression is taken.
    """
    cleaned = new.withColumn("id", clean_formula_id(F.col("id")))
    firsts = cleaned.groupBy("id").agg(F.min(F.struct("name", "expression")).alias("_first"))
    used = formulas.select("id").distinct().withColumn("_used", F.lit(True))
    judged = cleaned.join(firsts, "id").join(used, "id", "left")
    first = F.col("_first").eqNullSafe(F.struct("name", "expression"))
    return judged.withColumn("accepted", F.col("_used").isNull() & first).drop("_first", "_used")


def add_formulas(formulas: DataFrame, new: DataFrame) -> DataFrame:
    """The table with the accepted new formulas, whose times are now unless given."""
    accepted = judge_new_formulas(new, formulas).filter("accepted").drop("accepted")
    return formulas.unionByName(_shaped(accepted.dropDuplicates(["id"]), formulas, F.current_timestamp()))


def _shaped(df: DataFrame, formulas: DataFrame, time: Column | None = None) -> DataFrame:
    """Rows in the columns of the formula table: nulls for those they lack, `time` for times not given."""
    def field(name: str) -> Column:
        given = F.col(name) if name in df.columns else F.lit(None)
        if time is not None and name in ("created_at", "updated_at"):
            given = F.coalesce(given, time)
        return given.cast(formulas.schema[name].dataType).alias(name)

    return df.select(*[field(name) for name in formulas.columns])


def update_formulas(formulas: DataFrame, changes: DataFrame, strict: bool = True, order: str | None = None) -> DataFrame:
    """The table after changes: fields that are given replace; an unknown id is an error.

    Several changes of one id are taken in the order of the column `order`; without it they are an error.
    """
    changes = fold_changes(changes, "id", order)
    if strict:
        unknown = changes.join(shuffled(formulas.select("id")), "id", "left_anti").limit(5).collect()
        if unknown:
            raise ValueError(f"unknown formulas: {[row['id'] for row in unknown]}")
    fields = [name for name in _FIELDS if name in changes.columns and name in formulas.columns]
    given = changes.select("id", *[F.col(name).alias(f"_{name}") for name in fields], F.lit(True).alias("_changed"))
    joined = formulas.join(shuffled(given), "id", "left")
    new = {n: F.coalesce(f"_{n}", n) for n in fields}
    if "updated_at" in formulas.columns and "updated_at" not in fields:
        new["updated_at"] = F.when(F.col("_changed"), F.current_timestamp()).otherwise(F.col("updated_at"))
    return joined.withColumns(new).select(*formulas.columns)


def import_formulas(formulas: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table after an import by id, and one row with `imported`, the number of usable items.

    Items without id, expression or name are skipped. Of equal ids the last by `position`
    stands, where items have one.
    """
    def full(name: str):
        return F.col(name).isNotNull() & (F.col(name) != "")

    fields = [name for name in _FIELDS if name in formulas.columns]
    lacking = [name for name in fields if name not in items.columns]
    items = items.withColumns({name: F.lit(None).cast(formulas.schema[name].dataType) for name in lacking})
    usable = items.filter(full("id") & full("expression") & full("name"))
    rank = F.col("position") if "position" in items.columns else F.struct("name", "expression")
    kept = usable.groupBy("id").agg(F.max_by(F.struct(*fields), rank).alias("_last")).select("id", "_last.*")
    rest = formulas.join(kept.select("id"), "id", "left_anti").select("id", *fields)
    return rest.unionByName(kept), usable.agg(F.count("*").alias("imported"))


def apply_formula_sync(formulas: DataFrame, registry: DataFrame) -> DataFrame:
    """Formulas brought in line with the registry's texts.

    A registry formula is found by its serial in any spelling, then by its code; where its
    text differs, expression and target are replaced. One that is not found is added.
    """
    mapped = registry_to_formulas(registry)
    spelled = mapped.withColumns({"by_serial": F.concat(F.lit("P_"), F.col("serial").cast("string")), "by_code": F.col("sensor_code")})
    spelled = find_formulas(formulas, spelled, "by_serial").withColumnRenamed("formula_id", "_first")
    found = find_formulas(formulas, spelled, "by_code").withColumn("_id", F.coalesce("_first", "formula_id"))
    texts = registry.select("serial", F.when(F.col("formula_expression") != "", F.col("formula_expression")).alias("_text"))
    changed = (
        found.filter(F.col("_id").isNotNull()).join(shuffled(texts), "serial").filter(F.col("_text").isNotNull())
        .groupBy(F.col("_id").alias("id")).agg(F.max_by("_text", "serial").alias("expression"))
    )
    changed = changed.join(shuffled(formulas.select("id", F.col("expression").alias("_old"))), "id").filter(F.col("expression") != F.col("_old"))
    changed = changed.select("id", "expression", primary_sensor_of(F.col("expression")).alias("target_sensor"))
    updated = update_formulas(formulas, changed, strict=False)
    missing = found.filter(F.col("_id").isNull())
    return updated.unionByName(_shaped(missing, formulas))


def copy_formulas(formulas: DataFrame, ids: DataFrame) -> DataFrame:
    """Copies of formulas under the first free id X_COPY, X_COPY_2, ..."""
    wanted = formulas.join(ids.select("id").distinct(), "id", "left_semi")
    taken = formulas.select("id").distinct()
    number = F.regexp_extract("id", r"^(.*)_COPY(?:_(\d+))?$", 2)
    used = taken.filter(F.col("id").rlike(r"_COPY(_([2-9]|[1-9]\d+))?$")).select(
        F.regexp_extract("id", r"^(.*)_COPY(?:_(\d+))?$", 1).alias("_base"),
        F.when(number == "", 1).otherwise(number.try_cast("bigint")).alias("_number"),
    ).distinct()
    # With k copy ids in use, one of the first k + 1 is free.
    load = used.groupBy(F.col("_base").alias("id")).agg(F.count("*").alias("_k"))
    tries = wanted.select(F.col("id").alias("_base")).join(load.withColumnRenamed("id", "_base"), "_base", "left")
    tries = explode_range(tries, F.lit(1), F.coalesce("_k", F.lit(0)) + 1, "_number").drop("_k")
    free = tries.join(used, ["_base", "_number"], "left_anti").groupBy("_base").agg(F.min("_number").alias("_number"))
    suffix = F.when(F.col("_number") == 1, "_COPY").otherwise(F.concat(F.lit("_COPY_"), F.col("_number").cast("string")))
    copied = wanted.join(free, F.col("id") == F.col("_base"))
    return copied.withColumns({
        "name": F.concat("name", F.lit(" (Copy)")), "id": F.concat("id", suffix),
    }).select(*formulas.columns)
