"""Order-dependent work on keys of any size.

A window over `partitionBy(sensor)` puts a whole sensor into one task. The helpers
here find sensors with more than `split_rows` rows, give every row of them its exact
position, and cut them by position into chunks that are worked on side by side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.session import cut, shuffled, small_side

# Rows of a key that one task may work on in order. Windows over blocks need about 1 KB a row in all their sorts.
SPLIT_ROWS = 250_000
# Slices and chunks of a split key are smaller, so that tasks that get several of them by chance are about as large.
PARTS = 4


def micros(df: DataFrame, column: str) -> Column:
    """An order column as a long."""
    kind = dict(df.dtypes)[column]
    if kind == "timestamp":
        return F.unix_micros(F.col(column))
    if kind == "timestamp_ntz":
        return F.unix_micros(F.col(column).cast("timestamp"))
    if kind == "date":
        return F.unix_date(column).cast("bigint")
    # Texts have no number that follows their order; all rows are in one slice then.
    return F.lit(0).cast("bigint") if kind == "string" else F.col(column).cast("bigint")


def join_keys(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which null equals null, as in a window's partitions. Keys are those of `df`."""
    renamed = other.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return df.join(renamed, same, how).drop(*[f"_key_{k}" for k in keys])


def hot_keys(
    df: DataFrame, keys: list[str], order: list[str], split_rows: int = SPLIT_ROWS, profile: DataFrame | None = None,
) -> DataFrame | None:
    """Keys with more than `split_rows` rows and the width of their slices, or None.

    There are at most (rows of df / split_rows) of them, whatever the data; `_rows` is their
    number of rows. The slices of a key are narrowed until each holds `split_rows` rows at most, or
    cannot be narrowed any more (that many rows with one and the same first order value).
    `profile` gives the number of rows and the range of the first order column per key
    (`_rows`, `_low`, `_high`) where they are known already.
    """
    if profile is None:
        first = micros(df, order[0])
        profile = df.select(*keys, first.alias("_at")).groupBy(*keys).agg(
            F.count("*").alias("_rows"), F.min("_at").alias("_low"), F.max("_at").alias("_high"),
        )
    hot = profile.filter(F.col("_rows") > split_rows)
    if hot.isEmpty():
        return None
    hot = cut(hot.select(*keys, "_rows", "_low", F.greatest(
        F.lit(1), F.ceil((F.col("_high") - F.col("_low") + 1) / F.ceil(F.col("_rows") * PARTS / split_rows)),
    ).cast("bigint").alias("_width")))
    while True:
        fullest = (
            _sliced(df, hot, keys, order).groupBy(*keys, "_slice").count()
            .groupBy(*keys).agg(F.max("count").alias("_most"))
        )
        narrowed = cut(join_keys(hot, fullest, keys).select(*keys, "_rows", "_low", "_width", "_most"))
        dense = (F.col("_most") > split_rows) & (F.col("_width") > 1)
        if narrowed.filter(dense).isEmpty():
            return narrowed.drop("_most")
        hot = cut(narrowed.select(*keys, "_rows", "_low", F.when(
            dense, F.greatest(F.lit(1), F.ceil(F.col("_width") / 16)),
        ).otherwise(F.col("_width")).cast("bigint").alias("_width")))


def _sliced(df: DataFrame, hot: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of the hot keys with `_slice`, which never falls along the order; rows without a first order value come first."""
    at = micros(df, order[0])
    joined = join_keys(df.withColumn("_at", at), small_side(hot.drop("_rows")), keys)
    slice_of = F.coalesce(F.call_function("div", F.col("_at") - F.col("_low"), F.col("_width")), F.lit(-1).cast("bigint"))
    return joined.withColumn("_slice", slice_of).drop("_at", "_low", "_width")


def _tasks(hot: DataFrame, split_rows: int) -> int:
    """Tasks for the rows of the hot keys; a number that is given is not lowered by their size in bytes."""
    return max(1, -(-(hot.agg(F.sum("_rows")).first()[0] or 0) // split_rows))


def _positions_of_hot(df: DataFrame, hot: DataFrame, keys: list[str], order: list[str], out: str, tasks: int) -> DataFrame:
    sliced = _sliced(df, hot, keys, order)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(
        sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_rows"))
        .select(*keys, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = sliced.repartition(tasks, *keys, "_slice").withColumn("_inside", F.row_number().over(inside) - 1)
    return (
        join_keys(numbered, small_side(offsets), [*keys, "_slice"])
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset", "_slice")
    )


def positions(df: DataFrame, keys: list[str], order: list[str], out: str = "pos", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Add the zero-based position of each row among the rows of its key."""
    hot = hot_keys(df, keys, order, split_rows)
    plain = Window.partitionBy(*keys).orderBy(*order)
    if hot is None:
        return df.withColumn(out, (F.row_number().over(plain) - 1).cast("bigint"))
    rest = join_keys(df, small_side(hot), keys, "left_anti").withColumn(out, (F.row_number().over(plain) - 1).cast("bigint"))
    return rest.unionByName(_positions_of_hot(df, hot, keys, order, out, _tasks(hot, split_rows)).select(*rest.columns))


def over_chunks(
    df: DataFrame, keys: list[str], reach: int, add: Callable[[DataFrame, list[str], list[str]], DataFrame],
    pos: str = "pos", chunk_rows: int = SPLIT_ROWS, tasks: int | None = None,
) -> DataFrame:
    """Run `add(df, keys, order)` on chunks of consecutive positions, in so many tasks if `tasks` is given.

    The last `reach` rows of a chunk are copied in front of the next one, so that a row
    frame of up to `reach` rows back sees just what it would see in one piece.
    """
    size = max(chunk_rows, reach + 1)
    home = F.call_function("div", F.col(pos), F.lit(size).cast("bigint"))
    near_end = F.col(pos) % size >= size - reach
    copied = df.withColumn("_home", home).withColumn("_chunk", F.explode(
        F.when(near_end, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array(F.col("_home"))),
    ))
    if tasks is not None:
        copied = copied.repartition(tasks, *keys, "_chunk")
    return add(copied, [*keys, "_chunk"], [pos]).filter(F.col("_chunk") == F.col("_home")).drop("_home", "_chunk")


def with_history(
    df: DataFrame, keys: list[str], order: list[str], reach: int,
    add: Callable[[DataFrame, list[str], list[str]], DataFrame], split_rows: int = SPLIT_ROWS,
    profile: DataFrame | None = None, most_rows: float | None = None,
) -> DataFrame:
    """Run a window step that looks back over at most `reach` rows of its key.

    `most_rows` is a bound of the rows per key where one is known; within `split_rows` it
    saves counting them.
    """
    small = most_rows is not None and most_rows <= split_rows
    hot = None if small else hot_keys(df, keys, order, split_rows, profile)
    if hot is None:
        return add(df, keys, order)
    tasks = _tasks(hot, split_rows)
    numbered = _positions_of_hot(df, hot, keys, order, "_pos", tasks)
    split = over_chunks(numbered, keys, reach, add, "_pos", -(-split_rows // PARTS), tasks).drop("_pos")
    rest = add(join_keys(df, small_side(hot), keys, "left_anti"), keys, order)
    return rest.unionByName(split.select(*rest.columns))


FREQUENT = 2_000_000  # rows of one key that a lookup lets meet in one task; their sort takes about 130 bytes a row


def look_up(df: DataFrame, table: DataFrame, key: str, split_rows: int = FREQUENT) -> DataFrame:
    """A left join with a table of one row per key, in which no key's rows have to meet in one task.

    Rows of keys that come more than `split_rows` times stay where they are and get the table's rows for these keys,
    at most (rows of df / split_rows); the others are shuffled, as the table is.
    """
    hot = df.groupBy(key).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > split_rows).select(key)
    if hot.isEmpty():
        return df.join(shuffled(table), key, "left")
    hot = cut(hot)
    few = cut(table.join(small_side(hot), key, "left_semi"))
    rest = join_keys(df, small_side(hot), [key], "left_anti").join(shuffled(table), key, "left")
    there = join_keys(df, small_side(hot), [key], "left_semi").join(small_side(few), key, "left")
    return rest.unionByName(there)


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str | None = None) -> DataFrame:
    """The first n rows per key in a given order.

    Spark drops surplus rows before the shuffle as long as n is within the session's
    threshold, which is raised to n where it is lower.
    """
    conf, name = df.sparkSession.conf, "spark.sql.optimizer.windowGroupLimitThreshold"
    if n > int(conf.get(name)):
        conf.set(name, str(n))
    rank = out or "_rank"
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.filter(F.col(rank) <= n)
    return ranked if out else ranked.drop(rank)


STRIDE = 4_096  # numbers that one row is spread over at a time


def explode_range(df: DataFrame, low: Column, high: Column, out: str) -> DataFrame:
    """One row per whole number from `low` to `high`.

    Done in two steps, so that no row ever holds the whole of a long range.
    """
    start, end, one = low.cast("bigint"), high.cast("bigint"), F.lit(1).cast("bigint")
    parts = df.withColumns({"_end": end}).withColumn(out, F.explode(F.sequence(start, F.col("_end"), F.lit(STRIDE).cast("bigint"))))
    inner = F.sequence(F.col(out), F.least(F.col(out) + (STRIDE - 1), F.col("_end")), one)
    return parts.withColumn(out, F.explode(inner)).drop("_end")
