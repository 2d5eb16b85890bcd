"""Conversions between epoch numbers, texts and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}(:\d{2})?)$"
_LOCAL_T = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"
_LOCAL_SPACE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"

# Above this an epoch number is read as nanoseconds.
NANOSECOND_FLOOR = 1_000_000_000_000_000


def millis_to_nanos(millis: Column) -> Column:
    return millis.cast("bigint") * 1_000_000


def epoch_number_to_millis(number: Column) -> Column:
    """Milliseconds as they are; larger numbers are nanoseconds and are cut down."""
    whole = number.cast("bigint")
    return F.when(whole > NANOSECOND_FLOOR, F.call_function("div", whole, F.lit(1_000_000).cast("bigint"))).otherwise(whole)


def _local(text: Column, zone: str) -> Column:
    """A wall clock text of one zone as a timestamp."""
    return F.to_utc_timestamp(text.try_cast("timestamp_ntz").cast("timestamp"), zone)


def parse_local_t(text: Column, zone: str = "UTC") -> Column:
    return F.when(text.rlike(_LOCAL_T), _local(text, zone))


def parse_local_space(text: Column, zone: str = "UTC") -> Column:
    return F.when(text.rlike(_LOCAL_SPACE), _local(text, zone))


def parse_timestamp(text: Column, zone: str = "UTC", default: Column | None = None) -> Column:
    """Instants with an offset, then local texts with `T` or a blank, else the default (now)."""
    clean = F.trim(text)
    return F.coalesce(
        F.when(clean.rlike(_INSTANT), clean.try_cast("timestamp")),
        parse_local_t(clean, zone),
        parse_local_space(clean, zone),
        F.current_timestamp() if default is None else default,
    )


def to_local(moment: Column, zone: str = "UTC") -> Column:
    """The wall clock of a zone for a moment."""
    return F.from_utc_timestamp(moment, zone).cast("timestamp_ntz")


def from_local(local: Column, zone: str = "UTC", current: Column | None = None) -> Column:
    """The moment of a wall clock; a null clock leaves the current moment."""
    moment = F.to_utc_timestamp(local.cast("timestamp"), zone)
    return moment if current is None else F.coalesce(moment, current)


def format_local_time(moment: Column, zone: str = "UTC") -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(moment, zone), "HH:mm:ss"), F.lit("00:00:00"))


def format_local_date_time(moment: Column, zone: str = "UTC") -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(moment, zone), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def format_local_iso(moment: Column, zone: str = "UTC") -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(moment, zone), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def recent_range(seconds: int = 3600) -> tuple[Column, Column]:
    """Bounds of the most recent `seconds`, up to now."""
    now = F.current_timestamp()
    return now - F.make_dt_interval(secs=F.lit(seconds)), now
