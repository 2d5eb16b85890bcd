"""Sliding windows over the last n readings of a sensor."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.formula import WindowCall
from sensorloom.operators.skew import SPLIT_ROWS, over_chunks, with_history

# The history of on-demand and simulation runs, for callers who want that cap; a maximum starts here.
HISTORY_ROWS = 100
LOWEST = -1.7976931348623157e308

# Rows from which a window is put together from blocks: a row frame's cost grows with its length, that of blocks does not.
WIDE = 256

NAN = float("nan")


def _no_nan(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def window_rate(values: Column) -> Column:
    """Percent change from the first to the last value of a window."""
    first, last = F.try_element_at(values, F.lit(1)), F.try_element_at(values, F.lit(-1))
    return F.when((F.size(values) < 2) | (first == 0), 0.0).otherwise((last - first) / first * 100)


@dataclass(frozen=True)
class Mergeable:
    """A window function whose parts can be taken of two stretches and merged.

    `parts` gives for each part its kind (sum, count, min, max, first or last; nulls are left out) and what is taken of a
    value; `finish` turns the parts of the whole window into its result.
    """

    parts: dict[str, tuple[str, Callable[[Column], Column]]]
    finish: Callable[[dict[str, Column]], Column]


def _itself(value: Column) -> Column:
    return value


# How a part is taken of rows in their order, of rows in the opposite order, and merged from two stretches.
_KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, F.count, lambda a, b: a + b),
    "min": (F.min, F.min, F.least),
    "max": (F.max, F.max, F.greatest),
    "first": (lambda v: F.first(v, True), lambda v: F.last(v, True), lambda a, b: F.coalesce(a, b)),
    "last": (lambda v: F.last(v, True), lambda v: F.first(v, True), lambda a, b: F.coalesce(b, a)),
}

# The same parts of an array.
_OF_ARRAY: dict[str, Callable[[Column], Column]] = {
    "sum": lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda total, x: total + x)),
    "count": lambda v: F.size(v).cast("bigint"),
    "min": F.array_min, "max": F.array_max,
    "first": lambda v: F.try_element_at(v, F.lit(1)), "last": lambda v: F.try_element_at(v, F.lit(-1)),
}


def _rate(parts: dict[str, Column]) -> Column:
    first, last = parts["first"], parts["last"]
    return F.when((parts["n"] < 2) | (first == 0), 0.0).otherwise((last - first) / first * 100)


_mergeable: dict[str, Mergeable] = {
    "avg": Mergeable({"total": ("sum", _itself), "n": ("count", _itself)}, lambda p: F.when(p["n"] > 0, p["total"] / p["n"])),
    "max": Mergeable({"top": ("max", _no_nan)}, lambda p: F.greatest(F.coalesce(p["top"], F.lit(LOWEST)), F.lit(LOWEST))),
    "min": Mergeable({"bottom": ("min", _no_nan)}, lambda p: F.coalesce(p["bottom"], F.lit(NAN))),
    "rate": Mergeable({"n": ("count", _itself), "first": ("first", _itself), "last": ("last", _itself)}, _rate),
}

_custom: dict[str, Callable[[Column], Column]] = {"rate": window_rate}


def _named(name: str) -> str:
    if not name.isidentifier():
        raise ValueError(f"{name!r} is no name")
    return name


def register_window(name: str, reduce: Callable[[Column], Column]) -> None:
    """Make `window_<name>(n)` known; `reduce` turns the array of the window's values into a number.

    Each row gets its own array, so long windows cost as much as they are long; see `register_mergeable`.
    """
    _custom[_named(name)] = reduce
    _mergeable.pop(name, None)


def register_mergeable(name: str, parts: dict[str, tuple[str, Callable[[Column], Column]]], finish: Callable[[dict[str, Column]], Column]) -> None:
    """Make `window_<name>(n)` known by parts that can be merged, see `Mergeable`; its cost does not depend on n."""
    if unknown := {kind for kind, _ in parts.values()} - set(_KINDS):
        raise ValueError(f"no kinds of parts: {sorted(unknown)}")
    held = Mergeable(parts, finish)
    _mergeable[_named(name)] = held
    _custom[name] = lambda values: finish({
        part: _OF_ARRAY[kind](F.filter(F.transform(values, take), lambda x: x.isNotNull())) for part, (kind, take) in parts.items()})


def known_windows() -> set[str]:
    return {"avg", "max", "min", *_custom}


def _empty(name: str, dialect: str) -> float:
    """Result of a window over no values."""
    if dialect == "ui":
        return 0.0
    return {"avg": NAN, "max": LOWEST}.get(name, 0.0)


def _over_frame(name: str, value: str, frame) -> Column:
    v = F.col(value)
    if name == "avg":
        return F.avg(v).over(frame)
    if name == "max":
        return F.greatest(F.coalesce(F.max(_no_nan(v)).over(frame), F.lit(LOWEST)), F.lit(LOWEST))
    if name == "min":
        return F.coalesce(F.min(_no_nan(v)).over(frame), F.lit(NAN))
    if name in _mergeable and name != "rate":
        held = _mergeable[name]
        return held.finish({part: _KINDS[kind][0](take(v)).over(frame) for part, (kind, take) in held.parts.items()})
    return _custom[name](F.collect_list(v).over(frame))


def _over_blocks(df: DataFrame, keys: list[str], order: list[str], sizes: dict[WindowCall, int], value: str) -> DataFrame:
    """Windows of mergeable functions, at a cost per row that does not depend on their size.

    The rows of a key are numbered and cut into blocks as long as the window. A window is a whole block, or the end of
    one block and the beginning of the next: both are running aggregates inside blocks, from the front and from the back.
    One shuffle serves all of it, as blocks lie inside keys.
    """
    df = df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    numbered, v = Window.partitionBy(*keys).orderBy("_at"), F.col(value)
    for size in sorted(set(sizes.values())):
        df = df.withColumn("_block", F.call_function("div", F.col("_at"), F.lit(size)))
        block = Window.partitionBy(*keys, "_block")
        forward, backward = (block.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("_at"), F.desc("_at")))
        heads, tails, before, results = {}, {}, {}, {}
        whole = (F.col("_at") < size) | (F.col("_at") % size == size - 1)
        for call in sorted((c for c, n in sizes.items() if n == size), key=lambda c: c.column):
            parts = {}
            for part, (kind, take) in _mergeable[call.name].parts.items():
                name = f"_{call.column}_{part}"
                ahead, behind, merge = _KINDS[kind]
                heads[f"{name}_head"], tails[f"{name}_tail"] = ahead(take(v)).over(forward), behind(take(v)).over(backward)
                before[f"{name}_before"] = F.lag(f"{name}_tail", size - 1).over(numbered)
                parts[part] = F.when(whole, F.col(f"{name}_head")).otherwise(merge(F.col(f"{name}_before"), F.col(f"{name}_head")))
            results[call.column] = _mergeable[call.name].finish(parts)
        df = df.withColumns(heads).withColumns(tails).withColumns(before).withColumns(results).drop(*heads, *tails, *before)
    return df.drop("_at", "_block")


def _over_list(name: str, values: Column) -> Column:
    """The window function over an array of values, oldest first."""
    if name == "avg":
        return F.aggregate(values, F.lit(0.0), lambda total, x: total + x) / F.size(values)
    numbers = F.filter(values, lambda x: ~F.isnan(x))
    if name == "max":
        return F.greatest(F.coalesce(F.array_max(numbers), F.lit(LOWEST)), F.lit(LOWEST))
    if name == "min":
        return F.coalesce(F.array_min(numbers), F.lit(NAN))
    return _custom[name](values)


def _newest(values: Column | str, size: int) -> Column:
    """The last `size` entries of an array."""
    return F.slice(values, -F.least(F.lit(size), F.size(values)), F.lit(size))


def window_over_history(call: WindowCall, history: Column) -> Column:
    """A window function over a history array that ends with the current value; 0 without history."""
    if call.size <= 0:
        return F.when(F.size(history) > 0, _empty(call.name, "server")).otherwise(0.0)
    return F.when(F.size(history) > 0, _over_list(call.name, _newest(history, call.size))).otherwise(0.0)


def _check(calls: set[WindowCall]) -> set[WindowCall]:
    return {call for call in calls if call.name in known_windows()}


def _adder(calls: set[WindowCall], value: str, cap: int | None, dialect: str, within: tuple[str, int] | None):
    sizes = {call: call.size if cap is None else min(call.size, cap) for call in calls}

    longest = max([*sizes.values(), 1])

    def held_values(ordered) -> Column:
        """The values of the longest frame that are young enough, oldest first; collected once for all calls."""
        clock, seconds = within
        rows = F.collect_list(F.struct(F.unix_micros(clock).alias("at"), F.col(value).alias("value")))
        oldest = F.unix_micros(clock) - int(seconds * 1_000_000)
        # a reading without time has only such readings as its history
        fresh = F.filter(
            rows.over(ordered.rowsBetween(-(longest - 1), 0)),
            lambda row: F.coalesce(row["at"] > oldest, row["at"].isNull() & oldest.isNull()),
        )
        return F.transform(fresh, lambda row: row["value"])

    def add(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        ordered = Window.partitionBy(*keys).orderBy(*order)
        columns = {}
        if within is not None:
            df = df.withColumn("_held", held_values(ordered))
        wide = {call: size for call, size in sizes.items() if within is None and size >= WIDE and call.name in _mergeable}
        if wide:
            df = _over_blocks(df, keys, order, wide, value)
        for call in sorted(calls - wide.keys(), key=lambda c: c.column):
            size = sizes[call]
            if size <= 0:
                columns[call.column] = F.lit(_empty(call.name, dialect))
            elif within is None:
                columns[call.column] = _over_frame(call.name, value, ordered.rowsBetween(-(size - 1), 0))
            else:
                columns[call.column] = _over_list(call.name, _newest("_held", size))
        return df.withColumns(columns).drop("_held")

    return add, longest


def rolling(
    df: DataFrame,
    calls: Iterable[WindowCall],
    keys: Iterable[str] = ("sensor_id",),
    order: Iterable[str] = ("ts", "seq"),
    value: str = "value",
    cap: int | None = None,
    dialect: str = "server",
    within: tuple[str, int] | None = None,
    split_rows: int = SPLIT_ROWS,
    profile: DataFrame | None = None,
    most_rows: float | None = None,
) -> DataFrame:
    """Add one column per window call, named as `WindowCall.column`.

    All calls share one sort. `cap` bounds the held history by count (`HISTORY_ROWS` is the usual one; none
    unless asked for), `within` = (time column, seconds) by time. Windows of WIDE rows or more are put together
    from blocks where the function's parts can be merged. A sensor with more than `split_rows` rows is
    worked on in chunks; `profile` saves counting them, see `hot_keys`, and so does
    `most_rows`, a bound of the rows per sensor.
    """
    wanted = _check(set(calls))
    if not wanted:
        return df
    add, longest = _adder(wanted, value, cap, dialect, within)
    return with_history(df, list(keys), list(order), longest - 1, add, split_rows, profile, most_rows)


def rolling_by_position(
    df: DataFrame, calls: Iterable[WindowCall], pos: str = "pos", keys: Iterable[str] = (), value: str = "value",
    cap: int | None = None, dialect: str = "ui", chunk_rows: int = 50_000,
) -> DataFrame:
    """As `rolling`, for rows that carry dense positions: always in chunks."""
    wanted = _check(set(calls))
    if not wanted:
        return df
    add, longest = _adder(wanted, value, cap, dialect, None)
    return over_chunks(df, list(keys), longest - 1, add, pos, chunk_rows)
