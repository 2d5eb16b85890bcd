import math

import pytest
from pyspark.sql import functions as F

from sensorloom.functions.formula import FormulaError, WindowCall, formula_column, formula_names, window_calls
from sensorloom.operators.evaluate import evaluate_on_demand, evaluate_series
from sensorloom.operators.windows import register_window, rolling
from tests.helpers import START, readings


def run(spark, text, dialect="server", **names):
    scope = {k: (F.lit(v), "long") if isinstance(v, int) else F.lit(v) for k, v in names.items()}
    return spark.range(1).select(formula_column(text, scope, dialect=dialect).alias("x")).first()[0]


@pytest.mark.parametrize("text, value, expected", [
    ("value * 2.0 + 10", 10.5, 31.0),
    ("value > 50 ? value * 1.1 : value", 60.0, 66.0),
    ("value > 50 ? value * 1.1 : value", 40.0, 40.0),
    ("value > 100 ? 1 : value > 50 ? 2 : 3", 60.0, 2.0),
    ("value > 10 && value < 20 ? 1.0 : 0.0", 15.0, 1.0),
    ("!(value > 10) || value == 15 ? 1.0 : 0.0", 15.0, 1.0),
    ("!(value > 10) ? 1.0 : 0.0", 15.0, 0.0),
    ("5 / 2", 0.0, 2.0),
    ("5 % 3 + value", 1.0, 3.0),
    ("5 / 2.0", 0.0, 2.5),
    ("-value", 4.0, -4.0),
    ("(value - 32) / 1.8 * 0.95", 50.0, 9.5),
    ("abs(value) + math.abs(value)", -3.0, 6.0),
    ("max(value, 10) + min(value, 2)", 4.0, 12.0),
    ("round(value)", -2.5, -2.0),
    ("pow(value, 2) + sqrt(16.0)", 3.0, 13.0),
    ("floor(value) + ceil(value)", 1.5, 3.0),
])
def test_values(spark, text, value, expected):
    assert run(spark, text, value=value) == pytest.approx(expected)


def test_division_by_zero(spark):
    assert run(spark, "value / 0.0", value=1.0) == math.inf
    assert run(spark, "value / state", value=-1.0, state=0) == -math.inf
    assert math.isnan(run(spark, "value / state", value=0.0, state=0))
    assert run(spark, "1 / state", state=0) is None
    assert run(spark, "1 / state", dialect="ui", state=0) == math.inf


def test_nan_compares_with_nothing(spark):
    nan = float("nan")
    for sign, expected in [(">", 0.0), (">=", 0.0), ("<", 0.0), ("<=", 0.0), ("==", 0.0), ("!=", 1.0)]:
        assert run(spark, f"value {sign} 1 ? 1.0 : 0.0", value=nan) == expected
        assert run(spark, f"1 {sign} value ? 1.0 : 0.0", value=nan) == expected


def test_logarithm(spark):
    assert run(spark, "log(value)", value=0.0) == -math.inf
    assert math.isnan(run(spark, "log(value)", value=-1.0))
    assert run(spark, "log(value)", value=math.e) == pytest.approx(1.0)


def test_unknown_names_and_truth_values_fail(spark):
    assert run(spark, "other + 1", value=1.0) is None
    assert run(spark, "value > 1", value=2.0) is None
    assert run(spark, "value > 1", dialect="ui", value=2.0) == 0.0
    assert run(spark, "other > 1 ? 5 : 6", value=2.0) is None


@pytest.mark.parametrize("text", ["value +", "(value", "value)", "a ? b", "value 2", "value ^ 2", "[1]", "f(", "'x'"])
def test_no_formula(text):
    with pytest.raises(FormulaError):
        window_calls(text)


def test_names_and_windows():
    assert formula_names("math.abs(P_10001 - A) + window_avg(3)") == {"P_10001", "A"}
    assert window_calls("window_avg(3) + window_max( 5 )") == {WindowCall("avg", 3), WindowCall("max", 5)}


def values(df):
    return [row["value"] for row in df.orderBy("ts").collect()]


@pytest.mark.parametrize("text", ["P_10001 * 2.0 + window_avg(2)", "SN_10001 * 2.0 + window_avg(2)"])
def test_own_serial(spark, text):
    assert values(evaluate_series(readings(spark, [15, 25]), text))[-1] == 70.0


def test_series(spark):
    series = readings(spark, [25, 35])
    out = evaluate_series(series, "P_10001 + window_avg(2)", "10005")
    assert values(out) == [50.0, 65.0]
    assert {row["sensor_id"] for row in out.collect()} == {"10005"}
    assert "device_id" not in out.columns
    history = readings(spark, [2, 4, 6, 8, 10])
    assert values(evaluate_series(history, "value + window_avg(3)"))[-1] == 18.0
    assert values(evaluate_series(history, "window_max(4) * 2"))[-1] == 20.0
    assert values(evaluate_series(history.filter("false"), "value")) == []


def test_failing_points(spark):
    two = readings(spark, [1, 2]).unionByName(readings(spark, [3], sensor="10002"))
    assert values(evaluate_series(two, "P_10001 * 2")) == [2.0, 4.0]
    assert sorted(values(evaluate_series(two, "P_10001 * 2", on_error="zero"))) == [0.0, 2.0, 4.0]
    counted = evaluate_series(two, "P_10001 * 2", on_error="count")
    assert counted.agg(F.sum("failed")).first()[0] == 1
    with pytest.raises(ValueError):
        evaluate_series(two, "x = 1")


def test_on_demand(spark):
    series = readings(spark, [10, 20, 30], sensor="s1", step=60)
    out = evaluate_on_demand(series, "s1", "value * 2", every="1m")
    assert values(out) == [20.0, 40.0, 60.0]
    assert out.first()["sensor_id"] == "s1_ondemand_eval"
    later = evaluate_on_demand(series, "s1", "value", start=START.replace(minute=1), every=None)
    assert values(later) == [20.0, 30.0]
    assert values(evaluate_on_demand(readings(spark, [5, 15], sensor="s1"), "s1", "window_avg(2)", every="1s")) == [5.0, 10.0]


@pytest.mark.parametrize("call, given, expected", [
    (("avg", 5), [10, 20], 15.0), (("avg", 3), [10, 20, 30, 40, 50], 40.0), (("avg", 3), [10, 20, 30], 20.0),
    (("max", 5), [10, 30, 20], 30.0), (("max", 3), [50, 10, 20, 30, 25], 30.0),
    (("max", 2), [-50, -20, -30, -10], -10.0), (("max", 0), [1], -1.7976931348623157e308),
    (("max", -2), [1], -1.7976931348623157e308), (("min", 5), [50, 20, 40, 30, 5], 5.0),
    (("rate", 3), [1, 10, 12, 15], 50.0), (("rate", 3), [4], 0.0),
    (("max", 3), [1, float("nan"), 0.5], 1.0), (("max", 1), [float("nan")], -1.7976931348623157e308),
])
def test_windows(spark, call, given, expected):
    call = WindowCall(*call)
    last = rolling(readings(spark, given), [call]).orderBy(F.desc("seq")).first()
    assert last[call.column] == expected


def test_history_cap(spark):
    call = WindowCall("avg", 150)
    last = rolling(readings(spark, range(200)), [call], cap=100).orderBy(F.desc("seq")).first()
    assert last[call.column] == sum(range(100, 200)) / 100


def test_custom_window(spark):
    register_window("span", lambda v: F.array_max(v) - F.array_min(v))
    assert values(evaluate_series(readings(spark, [1, 5, 2]), "window_span(2)")) == [0.0, 4.0, 3.0]


def test_hot_sensor_gives_the_same_windows(spark):
    noise = [(i * 7919) % 101 for i in range(500)]
    df = readings(spark, noise).unionByName(readings(spark, noise[:20], sensor="10002"))
    calls = [WindowCall("avg", 7), WindowCall("max", 20), WindowCall("min", 3)]
    whole = {(r["sensor_id"], r["seq"]): r for r in rolling(df, calls).collect()}
    split = {(r["sensor_id"], r["seq"]): r for r in rolling(df, calls, split_rows=40).collect()}
    assert whole.keys() == split.keys()
    for key, row in whole.items():
        assert all(row[c.column] == pytest.approx(split[key][c.column]) for c in calls)
