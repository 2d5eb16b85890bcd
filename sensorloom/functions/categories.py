"""Categories, units and codes of sensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Category by slot number, modulo the length of the list.
CATEGORIES = ["Temperature", "Pressure", "Vibration", "Electrical", "Flow", "Mechanical", "Environmental"]

# Unit by category.
UNITS = {
    "temperature": "°C",
    "pressure": "bar",
    "vibration": "mm/s",
    "electrical": "kW",
    "flow": "m³/h",
    "mechanical": "RPM",
    "environmental": "%",
}
DEFAULT_UNIT = "%"

# Category, unit, mean and deviation of a registered sensor.
PROFILES = [
    ("temperature", "°C", 65.0, 3.0),
    ("pressure", "bar", 100.0, 4.0),
    ("vibration", "mm/s", 12.0, 1.2),
    ("electrical", "V", 220.0, 5.0),
    ("flow", "L/min", 45.0, 2.0),
    ("mechanical", "RPM", 50.0, 2.5),
    ("efficiency", "%", 88.0, 2.0),
]
DEFAULT_PROFILE = ("%", 50.0, 2.5)


def _folded(category: Column) -> Column:
    return F.lower(F.trim(category))


def default_category(index: Column) -> Column:
    labels = F.array(*[F.lit(c) for c in CATEGORIES])
    return F.element_at(labels, (F.pmod(index, F.lit(len(CATEGORIES))) + 1).cast("int"))


def default_unit(category: Column) -> Column:
    units = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.coalesce(F.try_element_at(units, _folded(category)), F.lit(DEFAULT_UNIT))


def category_profile(category: Column) -> Column:
    """struct(unit, mean, deviation) of a category."""
    def profile(unit: str, mean: float, deviation: float) -> Column:
        return F.struct(F.lit(unit).alias("unit"), F.lit(mean).alias("mean"), F.lit(deviation).alias("deviation"))

    chosen = F
    for name, unit, mean, deviation in PROFILES:
        chosen = chosen.when(_folded(category) == name, profile(unit, mean, deviation))
    return chosen.otherwise(profile(*DEFAULT_PROFILE))


def profile_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "category string, unit string, mean double, deviation double")


def sensor_code(device: Column, index: Column) -> Column:
    """`PHY-<DEVICE>-S<nnn>` with only letters and digits of the device name."""
    name = F.upper(F.regexp_replace(device, "[^A-Za-z0-9]", ""))
    return F.format_string("PHY-%s-S%03d", name, index)


def formula_code(serial: Column) -> Column:
    return F.concat(F.lit("FML-"), serial.cast("string"))


def clean_formula_id(code: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(code)), "[^A-Z0-9_]", "_")
