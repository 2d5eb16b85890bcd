"""Keyed state of the stream: the rule of a sensor and the history its windows need."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sensorloom import schemas
from sensorloom.functions.audit import usable_rules
from sensorloom.functions.formula import WindowCall
from sensorloom.functions.ids import canonical_serial_id
from sensorloom.streaming.sliding import BUILT_IN, Windows

_READING = ["seq", *schemas.READING.fieldNames()]
_RULE = ["rule_id", "expression", "derived_sensor_id", "uses_window"]

# Values pass through pandas as texts: as numbers, NaN and null would become one.
_CARRIED = [T.StructField(f.name, T.StringType() if f.name == "value" else f.dataType) for f in schemas.ARRIVED_READING.fields]

_EVENT = T.StructType([
    T.StructField("rule_key", T.StringType()),
    T.StructField("is_rule", T.BooleanType()),
    *_CARRIED,
    T.StructField("rule_id", T.StringType()),
    T.StructField("expression", T.StringType()),
    T.StructField("derived_sensor_id", T.StringType()),
    T.StructField("uses_window", T.BooleanType()),
])

OUTPUT = T.StructType([
    T.StructField("rule_key", T.StringType()),
    *_CARRIED,
    T.StructField("rule_id", T.StringType()),
    T.StructField("expression", T.StringType()),
    T.StructField("derived_sensor_id", T.StringType()),
    T.StructField("uses_window", T.BooleanType()),
    T.StructField("inaccurate_result", T.BooleanType()),
    # results of the rule's windows; for functions that only Columns know, the values they look at
    T.StructField("windows", T.MapType(T.StringType(), T.StringType())),
    T.StructField("history", T.ArrayType(T.StringType())),
])

_CALLS = re.compile(r"\bwindow_([A-Za-z]\w*)\s*\(\s*(-?)\s*(\d+)")


def _calls_of(expression: str) -> tuple[list[WindowCall], int]:
    """The calls of built-in windows, and the longest size of the others."""
    calls = {WindowCall(name, int(sign + size)) for name, sign, size in _CALLS.findall(expression)}
    return [c for c in calls if c.name in BUILT_IN], max((c.size for c in calls if c.name not in BUILT_IN), default=0)


def _as_number(text: str | None) -> float | None:
    return None if text is None else float(text)


class RuleState(StatefulProcessor):
    """Gives each reading the rule in force and the results of its windows, whatever their size.

    History is held while the rule of the sensor uses windows, for the retention time, and
    starts anew after any reading without such a rule. With `live` time is the clock and
    the store itself drops old values; otherwise time is that of the readings.
    """

    def __init__(self, retention_seconds: float, live: bool):
        self.retention = int(retention_seconds * 1_000_000)
        self.live = live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rule = handle.getValueState("rule", "rule_id string, expression string, derived_sensor_id string, uses_window boolean")
        lifetime = self.retention // 1000 if self.live else None
        self.values = handle.getListState("history", "at bigint, value string", ttlDurationMs=lifetime)
        self.start = handle.getValueState("start", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True)
        events = events.sort_values(["seq", "is_rule"], ascending=[True, False], kind="stable")
        rule = self.rule.get() if self.rule.exists() else None
        held = [(row[0], row[1]) for row in self.values.get()] if self.values.exists() else []
        start = self.start.get()[0] if self.start.exists() else None
        found = len(held)  # entries at the front of `held` that the store has already
        first = 0  # entries before it are too old
        replaced, rule_changed, start_before = False, False, start
        now, out, calls = int(time.time() * 1_000_000), [], {}
        windows = Windows([_as_number(value) for _, value in held])
        moments = events["ts"].astype("datetime64[us]").astype("int64").tolist()
        is_rule, values = events["is_rule"].tolist(), events["value"].tolist()
        offered = list(zip(*(events[name].tolist() for name in _RULE)))
        for at, moment in enumerate(moments):
            if is_rule[at]:
                rule, rule_changed = offered[at], True
                continue
            if rule is None or not rule[3]:
                if held:
                    replaced, held, first, windows = True, [], 0, Windows([])
                start = None
                out.append((at, rule, False, None, None))
                continue
            moment = now if self.live else moment
            held.append((moment, values[at]))
            oldest = moment - self.retention
            while held[first][0] <= oldest:  # the newest is never too old
                first += 1
            start = moment if start is None else start
            windows.values.append(_as_number(values[at]))
            if rule[1] not in calls:
                calls[rule[1]] = _calls_of(rule[1])
            known, longest = calls[rule[1]]
            found_now = {c.column: None if (x := windows.result(c, first)) is None else repr(x) for c in known}
            recent = [value for _, value in held[max(first, len(held) - longest):]] if longest else None
            out.append((at, rule, moment - start < self.retention, found_now, recent))
        # with `live` the store itself drops old entries, so the list is only added to
        if first and not self.live:
            replaced, held = True, held[first:]
        self._save(rule if rule_changed else None, held, found, replaced, start, start_before)
        if out:
            places, used, young, results, history = zip(*out)
            frame = events.iloc[list(places)][_READING].reset_index(drop=True)
            frame.insert(0, "rule_key", key[0])
            for number, name in enumerate(_RULE):
                frame[name] = [None if rule is None else rule[number] for rule in used]
            frame["inaccurate_result"], frame["windows"], frame["history"] = young, results, history
            yield frame

    def _save(self, rule, held, found, replaced, start, start_before) -> None:
        if rule is not None:
            self.rule.update(rule)
        if not held:
            self.values.clear()
        elif replaced:
            self.values.put(held)
        elif len(held) > found:
            self.values.appendList(held[found:])
        if start is None:
            self.start.clear()
        elif start != start_before:
            self.start.update((start,))

    def close(self) -> None:
        pass


def _events(readings: DataFrame, rules: DataFrame) -> DataFrame:
    def shaped(df: DataFrame) -> DataFrame:
        return df.select(*[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in _EVENT.fields
        ])

    keyed = readings.withColumns({"rule_key": canonical_serial_id(F.col("sensor_id")), "is_rule": F.lit(False)})
    return shaped(keyed).unionByName(shaped(usable_rules(rules).withColumn("is_rule", F.lit(True))))


def with_rule_state(readings: DataFrame, rules: DataFrame, retention_seconds: float, live: bool) -> DataFrame:
    """Readings with their rule, flag and window results; both streams need `seq`, the arrival number.

    Rules are keyed by their target as the readings are, so each goes to the one task that
    needs it and nothing is broadcast.
    """
    done = _events(readings, rules).groupBy("rule_key").transformWithStateInPandas(
        statefulProcessor=RuleState(retention_seconds, live), outputStructType=OUTPUT, outputMode="Append",
        timeMode="ProcessingTime" if live else "None",
    )
    return done.withColumns({
        "value": F.col("value").cast("double"), "windows": F.col("windows").cast("map<string,double>"), "history": F.col("history").cast("array<double>")})
