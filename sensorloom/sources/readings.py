"""Tables of readings: append, scan and fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sensorloom import schemas
from sensorloom.functions.ids import is_blank
from sensorloom.functions.times import millis_to_nanos
from sensorloom.session import small_side

STORED = T.StructType([*schemas.READING.fields, T.StructField("date", T.DateType())])


def stored_form(df: DataFrame, nanos: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Readings as they are stored: no null ids, no blank devices, and the day they belong to.

    Rows without a time cannot be placed and are skipped. `nanos` adds the time as `ts_ns`,
    `keep` names further columns to carry along.
    """
    rows = df.filter(F.col("ts").isNotNull()).withColumns({
        "sensor_id": F.coalesce("sensor_id", F.lit("")),
        "device_id": F.when(~is_blank(F.col("device_id")), F.col("device_id")),
        "has_inaccurate_data": F.coalesce("has_inaccurate_data", F.lit(False)),
        "date": F.to_date("ts"),
    })
    names = [*schemas.READING.fieldNames(), "date", *(keep or [])]
    if nanos:
        rows = rows.withColumn("ts_ns", millis_to_nanos(F.unix_millis("ts")))
        names.append("ts_ns")
    return rows.select(*names)


def ingest_batch(df: DataFrame | None, path: str, cluster: bool = True) -> None:
    """Append readings to the table at `path`, in one directory per day.

    `cluster` sorts them by day, sensor and time, so that later scans of a sensor skip
    most row groups; a large sensor is split over several files.
    """
    if df is None:
        return
    rows = stored_form(df)
    if cluster:
        rows = rows.repartitionByRange("date", "sensor_id", "ts").sortWithinPartitions("date", "sensor_id", "ts")
    rows.write.mode("append").partitionBy("date").parquet(path)


def discard(df: DataFrame) -> None:
    """Run a job for nothing but its work."""
    df.write.format("noop").mode("overwrite").save()


def write_readings(stream: DataFrame, path: str, checkpoint: str, every: str = "1 second", once: bool = False) -> StreamingQuery:
    """Append a stream of readings to the table at `path`."""
    writer = (
        stored_form(stream).writeStream.format("parquet").partitionBy("date").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """The table at `path`; filters on `date`, sensor and time reach the files."""
    return spark.read.schema(STORED).parquet(path)


def table_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """The table at `path`, or no rows where there is none yet."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return read_readings(spark, path)
    return spark.createDataFrame([], STORED)


def read_readings_jdbc(spark: SparkSession, url: str, table: str = "sensor_data", pieces: list[str] | None = None, **properties: str) -> DataFrame:
    """Readings of a relational table; filters and limits are pushed into the database.

    `pieces` are WHERE texts that together cover the table, one task each.
    """
    if pieces:
        return spark.read.jdbc(url, table, predicates=pieces, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def series_with_fallback(*sources: tuple[str, DataFrame]) -> DataFrame:
    """For each sensor, the rows of the first source that has any, tagged with `source`."""
    (name, first), *others = sources
    rows, seen = first.withColumn("source", F.lit(name)), first.select("sensor_id").distinct()
    for name, df in others:
        missing = df.join(small_side(seen), "sensor_id", "left_anti")
        rows = rows.unionByName(missing.withColumn("source", F.lit(name)))
        seen = seen.unionByName(df.select("sensor_id")).distinct()
    return rows
