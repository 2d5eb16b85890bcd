"""Many formulas at once: one Column per formula shape instead of one per rule.

`value * 1.1 + 3` and `value * 2.5 + 7` have the same shape; the numbers travel with the
row. A rule table then needs as many Columns as it has shapes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.formula import FormulaError, WindowCall, formula_column, window_calls

_REAL = r"(?<![\w.])(?:\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)"
_WHOLE = r"(?<![\w.])\d+(?![\w.])"
_ANY = f"{_REAL}|{_WHOLE}"
# Names that mean nothing next to a single reading; calls are left alone.
_UNBOUND = r"\b(?!(?:value|state|true|false|math|Math)\b)[A-Za-z_]\w*\b(?!\s*[(.])"
_WINDOW_SIZE = r"(\bwindow_[A-Za-z]\w*\s*\(\s*-?\s*)(\d+)"

# Blanks between a word and a sign, which make no difference.
_BLANKS = r"(?<=\w)\s+(?=\W)|(?<=\W)\s+(?=\w)"

# Shapes that share one Column; a table with more gets several, all in one pass.
SHAPES_PER_COLUMN = 40


def with_shape(df: DataFrame, expression: str = "expression", key: str = "rule_key") -> DataFrame:
    """Add `shape` (the text without numbers) and `numbers` to rows with an expression.

    The row's own sensor, in any spelling, is read as `value`; all unknown names are one,
    so that they make no shapes of their own.
    """
    text, own = F.col(expression), F.col(key)
    spelled = F.when(own.rlike(r"^\d+$"), F.regexp_replace(text, F.concat(F.lit(r"\b(?:P_|SN_)"), own, F.lit(r"\b")), F.lit("value")))
    spelled = spelled.when(own.rlike(r"^[A-Za-z_]\w*$"), F.regexp_replace(text, F.concat(F.lit(r"\b"), own, F.lit(r"\b")), F.lit("value")))
    bound = F.regexp_replace(spelled.otherwise(text), _UNBOUND, "unbound")
    marked = F.regexp_replace(bound, _WINDOW_SIZE, "$1w$2")
    df = df.withColumn("_marked", marked)
    shape = F.regexp_replace(F.regexp_replace(F.col("_marked"), _REAL, "#d"), _WHOLE, "#i")
    numbers = F.regexp_extract_all(F.col("_marked"), F.lit(_ANY), F.lit(0))
    return df.withColumns({"shape": F.regexp_replace(F.trim(shape), _BLANKS, ""), "numbers": numbers}).drop("_marked")


def _readable(shape: str) -> tuple[str, list[str]]:
    """A shape as a formula with a name for every number, and the kinds of the numbers."""
    kinds = re.findall(r"#([di])", shape)
    counter = iter(range(len(kinds)))
    named = re.sub(r"#[di]", lambda _: f"_λ{next(counter)}", shape)
    return re.sub(r"(\(\s*-?\s*)w(\d+)", r"\1\2", named), kinds


def shape_windows(shape: str) -> set[WindowCall]:
    try:
        return window_calls(_readable(shape)[0])
    except FormulaError:
        return set()


def shape_column(shape: str, windows: dict[WindowCall, Column], dialect: str = "server") -> Column:
    """The Column of a shape; null for a shape that is no formula."""
    text, kinds = _readable(shape)

    def scope(name: str):
        if name == "value":
            return F.col("value")
        if name == "state":
            return F.col("state").cast("bigint"), "long"
        number = re.fullmatch(r"_λ(\d+)", name)
        if number:
            at = int(number.group(1))
            given = F.col("numbers")[at]
            return (given.cast("double"), "double") if kinds[at] == "d" else (given.try_cast("bigint"), "long", True)
        return None  # other sensors are unknown next to a single reading

    try:
        return formula_column(text, scope, windows, dialect)
    except FormulaError:
        return F.lit(None).cast("double")


def shapes_of(rules: DataFrame) -> list[str]:
    """The distinct shapes of a rule table, from which the plan is made."""
    return sorted(row[0] for row in rules.select("shape").filter(F.col("shape").isNotNull()).distinct().collect())


def evaluate_shapes(df: DataFrame, shapes: list[str], window_columns, out: str = "result", dialect: str = "server") -> DataFrame:
    """Add the result of each row's shape; null without a rule or on failure.

    `window_columns(call)` gives the Column of a window call.
    """
    def chosen(some: list[str]) -> Column:
        result = F.lit(None).cast("double")
        for shape in reversed(some):
            windows = {call: window_columns(call) for call in shape_windows(shape)}
            windows = {call: column for call, column in windows.items() if column is not None}
            result = F.when(F.col("shape") == shape, shape_column(shape, windows, dialect)).otherwise(result)
        return result

    groups = [shapes[i:i + SHAPES_PER_COLUMN] for i in range(0, len(shapes), SHAPES_PER_COLUMN)]
    if len(groups) <= 1:
        return df.withColumn(out, chosen(shapes))
    columns = {f"_result_{n}": chosen(group) for n, group in enumerate(groups)}
    return df.withColumns(columns).withColumn(out, F.coalesce(*columns)).drop(*columns)
