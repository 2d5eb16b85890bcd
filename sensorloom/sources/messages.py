"""Device messages to readings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.functions.ids import DEFAULT_DEVICE, status_to_state
from sensorloom.functions.times import parse_local_space, parse_local_t
from sensorloom.operators.registry import resolve_serials

DEVICE_HEADER = "deviceId"
TIME_HEADER = "timestamp"

# Fields that may stand in an item and in a finished reading; any other makes a message invalid.
ITEM_FIELDS = ["sensorIndex", "value", "status"]
READING_FIELDS = ["sensorId", "deviceId", "sensorIndex", "timestamp", "value", "state", "hasInaccurateData"]

_OBJECT = "map<string,string>"
_LIST = "array<map<string,string>>"


def kafka_records(spark: SparkSession, servers: str, topic: str, starting: str = "latest", **options: str) -> DataFrame:
    """A stream of records with key, value, headers and time from a Kafka topic."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("includeHeaders", "true").option("startingOffsets", starting)
    )
    return reader.options(**options).load()


def file_records(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same stream from a folder of parquet files with the record schema."""
    reader = spark.readStream.schema(schemas.RECORD).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def read_sensor_stream(spark: SparkSession, path: str | None = None, servers: str | None = None, topic: str | None = None) -> DataFrame:
    """Device records from Kafka, or from a folder when `path` is given."""
    return file_records(spark, path) if path else kafka_records(spark, servers, topic)


def arrival_number(moment: Column, offset: Column) -> Column:
    """An arrival number for records of several topics: by append time, then by offset."""
    return F.shiftleft(F.unix_millis(moment), 20) + offset.cast("bigint").bitwiseAND(F.lit(2 ** 20 - 1))


def _last_header(name: str) -> Column:
    matching = F.filter("headers", lambda h: h["key"] == name)
    return F.try_element_at(matching, F.lit(-1))["value"].cast("string")


def record_device(default: str = DEFAULT_DEVICE) -> Column:
    """Device of a record: its last device header, else its key, else the default device."""
    return F.coalesce(_last_header(DEVICE_HEADER), F.col("key").cast("string"), F.lit(default))


def stated_millis(text: Column, zone: str = "UTC") -> Column:
    """Time of a record from its time header: milliseconds, else local text, else the record's own time."""
    return F.coalesce(
        # The pattern goes first, as a failing cast costs far more.
        F.when(text.rlike(r"^[+-]?\d{1,19}$"), text.try_cast("bigint")),
        F.unix_millis(parse_local_t(text, zone)), F.unix_millis(parse_local_space(text, zone)), F.unix_millis("timestamp"),
    )


def _field(item: Column | str, name: str) -> Column:
    return F.try_element_at(item, F.lit(name))


def _fits(text: Column, kind: str) -> Column:
    number = text.try_cast("double").try_cast("int") if kind == "int" else text.try_cast(kind)
    return text.isNull() | number.isNotNull()


def _all_known(items: Column, names: list[str], numbers: dict[str, str]) -> Column:
    """Whether all objects of a list have only known fields, and numbers where they should."""
    def known(item: Column) -> Column:
        test = item.isNotNull() & F.forall(F.map_keys(item), lambda key: key.isin(names))
        for name, kind in numbers.items():
            test = test & _fits(_field(item, name), kind)
        return test

    return F.forall(items, known)


def _opened(records: DataFrame, zone: str) -> DataFrame:
    """Records with `shape`, `_items`, the list of their objects or null, device and time.

    The columns are made step by step, each from columns of the step before, so that no
    text is parsed twice; a message is parsed as a map, and only the parts of an envelope
    are parsed again.
    """
    text = F.regexp_replace(F.col("value").cast("string"), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    opened = records.withColumns({"_text": text, "_device": record_device(), "_stamp": F.trim(_last_header(TIME_HEADER))})
    opened = opened.withColumns({
        "_millis": stated_millis(F.col("_stamp"), zone),
        "_root": F.when(F.col("_text").startswith("{"), F.from_json("_text", _OBJECT)),
    })
    shape = (
        F.when(F.col("_text").startswith("["), "array")
        .when(F.map_contains_key("_root", "sensorIndex"), "item")
        .when(_field("_root", "body").startswith("["), "envelope")
        .when(F.map_contains_key("_root", "sensorId"), "reading")
    )
    # A time that is not positive counts as none, and the message as sent now.
    now = F.current_timestamp()
    opened = opened.withColumns({
        "shape": shape, "_time": F.when(F.col("_millis") > 0, F.timestamp_millis("_millis")).otherwise(now),
    })
    listed = F.when(F.col("shape") == "array", F.from_json("_text", _LIST)).when(
        F.col("shape") == "envelope", F.from_json(_field("_root", "body"), _LIST)).when(
        F.col("shape").isNotNull(), F.array("_root"))
    header = F.when(F.col("shape") == "envelope", F.from_json(_field("_root", "header"), _OBJECT))
    opened = opened.withColumns({"_list": listed, "_head": header})
    fine = F.when(F.col("shape") == "reading", _all_known(
        F.col("_list"), READING_FIELDS, {"sensorIndex": "int", "value": "double", "timestamp": "bigint", "state": "int"},
    )).otherwise(_all_known(F.col("_list"), ITEM_FIELDS, {"sensorIndex": "int", "value": "double"}))
    return opened.withColumns({
        "_device": F.coalesce(_field("_head", "deviceId"), "_device"),
        "_time": F.coalesce(F.timestamp_millis(_field("_head", "timestamp").try_cast("bigint")), "_time"),
        "_items": F.when(fine, F.col("_list")),
    })


def decode_device_records(
    records: DataFrame, mappings: DataFrame | None = None, keep: Iterable[str] = (), zone: str = "UTC",
) -> DataFrame:
    """Readings of device records, none to many per record; see `rejected_records` for the rest.

    A message is a list of items, one item, an envelope with header and body, or one
    finished reading. Items get the serial of their device slot, from `mappings` (device_id,
    sensor_index, serial) or computed. `keep` names record columns to carry along.
    """
    keep = list(keep)
    # The outer form keeps the optimizer from testing, and so parsing, every list in a filter first.
    items = _opened(records, zone).select(
        *keep, "shape", "_device", "_time", F.posexplode_outer("_items").alias("item_number", "_item"),
    ).filter(F.col("_item").isNotNull())

    def field(name: str) -> Column:
        return _field("_item", name)

    finished = F.col("shape") == "reading"
    # A finished reading has its own id, and may have its own device, time and state.
    index = F.when(finished, field("sensorIndex").try_cast("double")).otherwise(
        F.coalesce(field("sensorIndex").try_cast("double"), F.lit(0.0))).try_cast("int")
    own_time = field("timestamp").try_cast("bigint")
    columns = items.select(
        *keep, "item_number", finished.alias("_finished"), field("sensorId").alias("_own_id"),
        F.when(finished, F.coalesce(field("deviceId"), "_device")).otherwise(F.col("_device")).alias("device_id"),
        index.alias("sensor_index"),
        F.when(finished & (own_time > 0), F.timestamp_millis(own_time)).otherwise(F.col("_time")).alias("ts"),
        F.coalesce(field("value").try_cast("double"), F.lit(0.0)).alias("value"),
        F.when(finished, F.coalesce(field("state").try_cast("double").try_cast("int"), F.lit(0)))
        .otherwise(status_to_state(field("status"))).alias("state"),
        (finished & F.coalesce(field("hasInaccurateData") == "true", F.lit(False))).alias("has_inaccurate_data"),
    )
    none = records.sparkSession.createDataFrame([], "device_id string, sensor_index int, serial bigint")
    numbered = resolve_serials(columns, none if mappings is None else mappings)
    sensor = F.when(F.col("_finished"), F.col("_own_id")).otherwise(F.col("serial").cast("string"))
    return numbered.withColumn("sensor_id", sensor).select(*keep, "item_number", *schemas.READING.fieldNames())


def rejected_records(records: DataFrame, zone: str = "UTC") -> DataFrame:
    """Records that give no readings, with the reason: empty, unknown shape or malformed."""
    opened = _opened(records, zone)
    reason = F.when(F.col("_items").isNull(), (
        F.when(F.coalesce("_text", F.lit("")) == "", "empty")
        .when(F.col("shape").isNull() & F.col("_root").isNotNull(), "unknown_shape")
        .otherwise("malformed")
    ))
    return opened.withColumn("reason", reason).select(*records.columns, "reason").filter(F.col("reason").isNotNull())
