"""Files for people: simulation points and formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom import schemas
from sensorloom.operators.formulas import import_formulas as merge_items


def simulation_rows(points: DataFrame, primary: str, target: str, formulas: list[str]) -> DataFrame:
    """Points in the export's columns: index, time, primary sensor, other formulas, result."""
    others = [F.col(f"`{name}`") for name in formulas if name != target]
    return points.select(
        F.col("pos").alias("index"), F.date_format("ts", "HH:mm:ss").alias("timestamp"),
        F.col("primary_value").alias(f"sensor_{primary}"), *others, F.col("computed_value").alias("computed_result"),
    )


def export_simulation_csv(points: DataFrame, path: str, primary: str, target: str, formulas: list[str]) -> None:
    """Points as CSV files with a header, in order from file to file."""
    rows = simulation_rows(points, primary, target, formulas)
    rows.repartitionByRange("index").sortWithinPartitions("index").write.mode("overwrite").option("header", True).csv(path)


def export_formulas(formulas: DataFrame, path: str) -> None:
    """Formulas as JSON, one object per line."""
    formulas.write.mode("overwrite").json(path)


def import_formulas(spark: SparkSession, path: str, formulas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The formula table after an import of JSON files, and the number of imported items.

    Each file holds one object per line or one array, whatever the others hold. An array is
    read by one task; only the names of such files come to the driver.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"))
    firsts = lines.filter(F.trim("value") != "").groupBy("file_path").agg(F.min_by("value", "place").alias("first"))
    arrays = [row[0] for row in firsts.filter(F.ltrim("first").startswith("[")).select("file_path").collect()]
    other_names = [T.StructField(name, schemas.FORMULA[field].dataType) for name, field in schemas.FORMULA_JSON.items()]
    reader = spark.read.schema(T.StructType([*schemas.FORMULA.fields, *other_names]))
    items = reader.json(path).filter(~F.col("_metadata.file_path").isin(arrays))
    if arrays:
        items = items.unionByName(reader.option("multiLine", True).json(arrays))
    items = items.withColumns({field: F.coalesce(field, name) for name, field in schemas.FORMULA_JSON.items()})
    return merge_items(formulas, items.select(*schemas.FORMULA.fieldNames()))
