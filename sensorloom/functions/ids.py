"""Sensor and device identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier defaults and the numbering of unregistered sensors.
DEFAULT_DEVICE = "DEVICE-DEFAULT"
DEFAULT_SERIAL = 10001
PREFIX = "P_"
LEGACY_PREFIX = "SN_"
SERIAL_FLOOR = 10000
HASHED_FLOOR = 500000
DEVICE_STRIDE = 1000
HASH_SLOTS = 500

# A serial in running text: four to six digits with or without a prefix.
SERIAL_IN_TEXT = r"\b(?:P_|SN_)?\d{4,6}\b"
PREFIXED_SERIAL_IN_TEXT = r"\b(?:P_|SN_)\d{4,6}\b"


def _trim(text: Column) -> Column:
    """Cut every leading and trailing control character and blank."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (_trim(text) == "")


def normalize_device_id(device: Column) -> Column:
    """Trimmed and upper-cased device name; the default device for none."""
    return F.coalesce(F.nullif(F.upper(_trim(device)), F.lit("")), F.lit(DEFAULT_DEVICE))


# A device name, the first `#` or else the first `:`, and a whole number.
_COMPOSITE = r"(?s)^(?:([^#]+)#|([^#:]+):)[\x00-\x20]*([+-]?\d+)[\x00-\x20]*$"


def parse_composite_id(text: Column) -> Column:
    """`DEVICE#5` or `DEVICE:5` as struct(device_id, sensor_index), else null."""
    index = F.regexp_extract(text, _COMPOSITE, 3).try_cast("int")
    device = F.concat(F.regexp_extract(text, _COMPOSITE, 1), F.regexp_extract(text, _COMPOSITE, 2))
    return F.when(index.isNotNull(), F.struct(
        normalize_device_id(device).alias("device_id"), index.alias("sensor_index"),
    ))


def composite_id(device: Column, index: Column) -> Column:
    """The text form `DEVICE#index` of a device slot."""
    return F.concat(normalize_device_id(device), F.lit("#"), index.cast("string"))


def canonical_serial_id(sensor: Column, ignore_case: bool = False) -> Column:
    """`P_10001` and `SN_10001` become `10001`; other ids are trimmed."""
    flag = "(?i)" if ignore_case else ""
    return F.regexp_replace(_trim(sensor), flag + r"^(?:P_|SN_)(\d+)$", "$1")


def counterpart_serial_id(sensor: Column, ignore_case: bool = False) -> Column:
    """The other spelling of a serial: digits with prefix, prefixed as digits, else null."""
    flag = "(?i)" if ignore_case else ""
    text = _trim(sensor)
    return (
        F.when(text.rlike(r"^\d+$"), F.concat(F.lit(PREFIX), text))
        .when(text.rlike(flag + r"^(?:P_|SN_)\d+$"), F.regexp_extract(text, r"(\d+)$", 1))
    )


def parse_serial(sensor: Column) -> Column:
    """The serial of any spelling as a long, else null."""
    text = canonical_serial_id(sensor)
    return F.when(text.rlike(r"^\d+$"), text.try_cast("bigint"))


def prefixed_serial(serial: Column) -> Column:
    return F.concat(F.lit(PREFIX), serial.cast("string"))


def string_hash(text: Column) -> Column:
    """The 32-bit polynomial hash (factor 31) over the UTF-16 units of a text."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    codes = F.transform(units, lambda unit: F.conv(unit, 16, 10).cast("bigint"))
    unsigned = F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return (unsigned + 2 ** 31).bitwiseAND(F.lit(0xFFFFFFFF)) - 2 ** 31


def fallback_serial(device: Column, index: Column) -> Column:
    """A repeatable serial for a device slot that is in no registry."""
    name = normalize_device_id(device)
    # A number too large to work with is none, and the name is hashed instead.
    number = F.regexp_extract(name, r"(\d+)$", 1).try_cast("bigint")
    offset = F.try_multiply(F.greatest(F.lit(0).cast("bigint"), number - 1), F.lit(DEVICE_STRIDE).cast("bigint"))
    numbered = F.when(number.isNotNull(), F.try_add(offset, F.lit(SERIAL_FLOOR).cast("bigint")))
    hashed = F.lit(HASHED_FLOOR) + (F.abs(string_hash(name)) % HASH_SLOTS + 1) * DEVICE_STRIDE
    return F.coalesce(numbered, hashed) + index.cast("bigint") + 1


def target_sensor_of(expression: Column, fallback: Column | None = None, strict: bool = False) -> Column:
    """The first serial named in an expression as written there.

    `strict` asks for a prefix, so that a plain number such as 1000 is not a sensor.
    """
    found = F.regexp_extract(expression, PREFIXED_SERIAL_IN_TEXT if strict else SERIAL_IN_TEXT, 0)
    other = F.lit(None).cast("string") if fallback is None else F.when(~is_blank(fallback), fallback)
    return F.coalesce(F.when(found != "", found), other, F.lit(str(DEFAULT_SERIAL)))


def primary_sensor_of(expression: Column, default: str = str(DEFAULT_SERIAL)) -> Column:
    """The digits of the first serial, else the first `sensor_<n>`, else the default."""
    serial = F.regexp_extract(expression, r"\b(?:P_|SN_)?(\d{4,6})\b", 1)
    named = F.regexp_extract(expression, r"(?i)\b(sensor_\d+)\b", 1)
    return F.coalesce(F.when(serial != "", serial), F.when(named != "", named), F.lit(default))


def output_sensor_id(derived: Column, source: Column, suffix: str = "_derived") -> Column:
    """Id of a computed reading: the canonical derived id, else the source id with a suffix."""
    return F.when(~is_blank(derived), canonical_serial_id(derived)).otherwise(F.concat(source, F.lit(suffix)))


def status_to_state(status: Column) -> Column:
    return F.coalesce(F.when(F.lower(status) == "down", 1), F.lit(0))
