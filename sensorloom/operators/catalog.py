"""The catalog of sensors and formulas that a user sees: registry first, then the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.categories import category_profile, clean_formula_id
from sensorloom.functions.ids import parse_serial, primary_sensor_of
from sensorloom.functions.numbers import clamp_bounds

CATALOG_COLUMNS = [
    "id", "name", "category", "unit", "mean", "std_dev", "min_clamp", "max_clamp", "description",
    "serial", "device_id", "device_sensor_index", "sensor_type",
]

# Description of registry rows that have none.
DESCRIPTION = "Registered sensor"


def registry_to_catalog(registry: DataFrame, description: str = DESCRIPTION) -> DataFrame:
    """Registry rows as catalog rows, with mean, deviation and bounds of their category; `description` where they have none."""
    category = F.coalesce(F.col("category"), F.lit("General"))
    profile = category_profile(category)
    low, high = clamp_bounds(profile["mean"], profile["deviation"])
    return registry.select(
        F.coalesce(F.col("serial").cast("string"), F.col("sensor_code")).alias("id"),
        F.col("sensor_name").alias("name"), category.alias("category"), F.coalesce("unit", F.lit("")).alias("unit"),
        profile["mean"].alias("mean"), profile["deviation"].alias("std_dev"),
        low.alias("min_clamp"), high.alias("max_clamp"),
        F.coalesce("description", F.lit(description)).alias("description"),
        "serial", "device_id", "device_sensor_index", F.coalesce("sensor_type", F.lit("PHYSICAL")).alias("sensor_type"),
    )


def merge_catalogs(registry: DataFrame, catalog: DataFrame) -> DataFrame:
    """All registry rows, and the catalog rows whose id is not among them."""
    first = registry_to_catalog(registry)
    rest = catalog.join(first.select("id"), "id", "left_anti")
    return first.unionByName(rest.select(*CATALOG_COLUMNS))


def lookup_sensor_meta(requests: DataFrame, registry: DataFrame, catalog: DataFrame, column: str = "sensor_id") -> DataFrame:
    """Requests with the catalog row of their sensor as `meta`, and `found_by`.

    Looked up by serial in any spelling, then by code, then by catalog id; else a
    generic row. Where a key is in use several times, the row with the lowest serial counts.
    """
    def packed(df: DataFrame, name: str, key: Column) -> DataFrame:
        first = F.min_by(F.struct(*CATALOG_COLUMNS), F.struct(F.col("serial").isNull(), "serial", "id", "name"))
        return df.groupBy(key.alias(f"_{name}_key")).agg(first.alias(f"_{name}"))

    converted = registry_to_catalog(registry)
    coded = registry_to_catalog(registry.filter(F.col("sensor_code").isNotNull()))
    by_serial = packed(converted, "serial", F.col("serial"))
    by_code = registry.select("serial", "sensor_code").join(coded, "serial")
    by_code = packed(by_code, "code", F.col("sensor_code"))
    by_id = packed(catalog, "catalog", F.col("id"))
    asked = F.col(column)
    generic = F.struct(
        asked.alias("id"), F.concat(F.lit("Generic Sensor "), asked).alias("name"), F.lit("Mechanical").alias("category"),
        F.lit("units").alias("unit"), F.lit(100.0).alias("mean"), F.lit(5.0).alias("std_dev"),
        F.lit(0.0).alias("min_clamp"), F.lit(200.0).alias("max_clamp"), F.lit("Fallback mock sensor").alias("description"),
        F.lit(None).cast("bigint").alias("serial"), F.lit(None).cast("string").alias("device_id"),
        F.lit(None).cast("int").alias("device_sensor_index"), F.lit(None).cast("string").alias("sensor_type"),
    )
    joined = (
        requests.withColumn("_asked_serial", parse_serial(asked))
        .join(by_serial, F.col("_asked_serial") == F.col("_serial_key"), "left")
        .join(by_code, asked == F.col("_code_key"), "left")
        .join(by_id, asked == F.col("_catalog_key"), "left")
    )
    found_by = (
        F.when(F.col("_serial").isNotNull(), "serial").when(F.col("_code").isNotNull(), "code")
        .when(F.col("_catalog").isNotNull(), "catalog").otherwise("generic")
    )
    return joined.select(
        *requests.columns, F.coalesce("_serial", "_code", "_catalog", generic).alias("meta"), found_by.alias("found_by"),
    )


def search_catalog(catalog: DataFrame, category: str | None = None, text: str | None = None) -> DataFrame:
    """Catalog rows of a category whose id or name contains a text."""
    if category and category != "ALL":
        catalog = catalog.filter(F.col("category") == category)
    if text and text.strip():
        wanted = text.strip().lower()
        catalog = catalog.filter(F.lower("id").contains(wanted) | F.lower("name").contains(wanted))
    return catalog


def search_formulas(formulas: DataFrame, category: str | None = None, text: str | None = None) -> DataFrame:
    """Formulas of a category whose id, name or expression contains a text."""
    if category and category != "ALL":
        formulas = formulas.filter(F.col("category") == category)
    if text and text.strip():
        wanted = text.strip().lower()
        hit = F.lower("id").contains(wanted) | F.lower("name").contains(wanted) | F.lower("expression").contains(wanted)
        formulas = formulas.filter(hit)
    return formulas


def distinct_categories(df: DataFrame) -> DataFrame:
    return df.select("category").filter(F.col("category") != "").distinct()


def registry_to_formulas(registry: DataFrame) -> DataFrame:
    """FORMULA rows of the registry as formulas, with description and times where the registry has them."""
    kept = [name for name in ("description", "created_at", "updated_at") if name in registry.columns]
    serial = F.col("serial").cast("string")
    coded = F.when(F.col("sensor_code") != "", F.col("sensor_code")).otherwise(F.concat(F.lit("FML_"), serial))
    text = F.when(F.col("formula_expression") != "", F.col("formula_expression"))
    return registry.filter(F.col("sensor_type") == "FORMULA").select(
        clean_formula_id(coded).alias("id"), "serial", "sensor_code", F.col("sensor_name").alias("name"),
        F.coalesce(text, F.lit("value * 1.0")).alias("expression"),
        F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("Efficiency")).alias("category"),
        primary_sensor_of(F.coalesce(text, F.lit(""))).alias("target_sensor"),
        F.array(F.lit("Registry"), F.concat(F.lit("P_"), serial)).alias("tags"), *kept,
    )


def merge_formulas(registry: DataFrame, session: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """Registry formulas, of equal ids the one with the highest serial, and session formulas with other ids.

    An empty registry gives the local formulas, if there are any.
    """
    if local is not None and registry.isEmpty():
        return local
    mapped = registry_to_formulas(registry)
    rest = [c for c in mapped.columns if c != "id"]
    last = mapped.groupBy("id").agg(F.max_by(F.struct(*rest), "serial").alias("_last")).select("id", "_last.*")
    others = session.join(last.select("id"), "id", "left_anti")
    return last.unionByName(others, allowMissingColumns=True)
