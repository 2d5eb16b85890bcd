"""Checks of rule texts, one verdict column per test."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.ids import canonical_serial_id, is_blank

# The longest text, the allowed characters and the banned words.
MAX_LENGTH = 500
ALLOWED = r"^[a-zA-Z0-9_\s+\-*/%?:><=!&|(),.]+$"
LONE_ASSIGNMENT = r"(?<![=><!])=(?!=)"
BANNED_WORDS = (
    "let fn def while for in return try catch throw use import include load new Class System Runtime "
    "Process ProcessBuilder exec eval sys system java javax org com net lambda nil null"
).split()
BANNED = r"(?i)\b(" + "|".join(BANNED_WORDS) + r")\b"

REASONS = ["empty", "too_long", "bad_character", "assignment", "banned_word"]


def uses_window(expression: Column) -> Column:
    """Whether an expression needs the history of its sensor."""
    return F.coalesce(expression.contains("window_") | expression.contains("previous_"), F.lit(False))


def verdicts(expression: Column) -> dict[str, Column]:
    """Failed tests by name, in the order in which they are tried."""
    return {
        "empty": is_blank(expression),
        "too_long": F.coalesce(F.length(expression) > MAX_LENGTH, F.lit(False)),
        "bad_character": F.coalesce(~expression.rlike(ALLOWED), F.lit(False)),
        "assignment": F.coalesce(expression.rlike(LONE_ASSIGNMENT), F.lit(False)),
        "banned_word": F.coalesce(expression.rlike(BANNED), F.lit(False)),
    }


def first_reason(expression: Column) -> Column:
    """Name of the first failed test, null for a clean text."""
    failed = verdicts(expression)
    return F.coalesce(*[F.when(failed[name], name) for name in REASONS])


def is_clean(expression: Column) -> Column:
    return first_reason(expression).isNull()


def audit_rules(rules: DataFrame, column: str = "expression") -> DataFrame:
    """Add a verdict per test, `reason` and `valid` to a table of rule texts."""
    expression = F.col(column)
    return rules.withColumns({
        **{f"fails_{name}": test for name, test in verdicts(expression).items()},
        "reason": first_reason(expression),
        "valid": is_clean(expression),
    })


def usable_rules(rules: DataFrame) -> DataFrame:
    """Rules that take effect: a clean text and a target; adds key and window flag."""
    key = canonical_serial_id(F.col("target_sensor_id"))
    kept = rules.filter(is_clean(F.col("expression")) & ~is_blank(F.col("target_sensor_id")))
    return kept.withColumns({"rule_key": key, "uses_window": uses_window(F.col("expression"))})


def check_text(expression: str | None) -> None:
    """Raise for a single text that the audit rejects, before a plan is made of it."""
    if expression is None or not expression.strip():
        raise ValueError("the expression is empty")
    if len(expression) > MAX_LENGTH:
        raise ValueError(f"the expression is longer than {MAX_LENGTH} characters")
    if not re.fullmatch(ALLOWED, expression, re.ASCII):
        raise ValueError("the expression has characters that are not allowed")
    if re.search(LONE_ASSIGNMENT, expression):
        raise ValueError("the expression assigns a value")
    if re.search(BANNED, expression, re.ASCII):
        raise ValueError("the expression has a banned word")
