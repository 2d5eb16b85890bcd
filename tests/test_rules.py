import itertools

import pytest

from sensorloom.functions.audit import audit_rules, check_text
from sensorloom.operators.rules import apply_rules, current_rules, evaluate_rules, rule_counters, rules_as_of
from tests.helpers import readings, rules

VALID = [
    "value * 2.0 + 10", "value > 50 ? value * 1.1 : value", "window_avg(3) + window_max(5)",
    "(TEMP - 32) / 1.8 * 0.95", "A == 100 && B != 20", "value >= 10.5 || value <= 0.0",
]
INVALID = {
    None: "empty", "": "empty", "   ": "empty", "value + " * 100 + "1.0": "too_long", "a = 10": "assignment",
    "x = y + 1": "assignment", "val = 5.0": "assignment", "arr[0] + 1": "bad_character", "'x' + 1": "bad_character",
    "`x`": "bad_character", "let a = 10": "assignment", "while(true) 1": "banned_word", "exec(cmd)": "banned_word",
    "eval(code)": "banned_word", "java.lang.System": "banned_word", "new ProcessBuilder()": "banned_word",
}


def test_audit(spark):
    texts = spark.createDataFrame([(t,) for t in [*VALID, *INVALID]], "expression string")
    found = {r["expression"]: r["reason"] for r in audit_rules(texts).collect()}
    assert found == {**{t: None for t in VALID}, **INVALID}
    for text in INVALID:
        with pytest.raises(ValueError):
            check_text(text)
    for text in VALID:
        check_text(text)


def output(df):
    return [(r["sensor_id"], r["value"]) for r in df.orderBy("seq", "ord", "sensor_id").collect()]


def test_derived_before_raw(spark):
    rule = rules(spark, [(0, "r1", "P_10001", "value * 2.0 + 10.0", "10201")])
    assert output(apply_rules(readings(spark, [45.0]), rule)) == [("10201", 100.0), ("10001", 45.0)]
    rule = rules(spark, [(0, "r1", "10002", "value + 5.5", None)])
    assert output(apply_rules(readings(spark, [20.0], "10002"), rule)) == [("10002_derived", 25.5), ("10002", 20.0)]


def test_many_rules(spark):
    two = rules(spark, [(0, "a", "10001", "P_10001 * 1.8 + 32.0", "d1"), (1, "b", "10002", "value * 1.25", "d2")])
    both = readings(spark, [25.0]).unionByName(readings(spark, [40.0], "10002", first_seq=1))
    assert dict(output(apply_rules(both, two).filter("ord = 0"))) == {"d1": 77.0, "d2": 50.0}
    legacy = rules(spark, [(0, "a", "SN_10001", "SN_10001 * 1.8 + 32", "d1")])
    assert dict(output(apply_rules(both, legacy).filter("ord = 0"))) == {"d1": 77.0}


def test_latest_usable_rule_wins(spark):
    three = rules(spark, [
        (0, "a", "10001", "value * 2", "x"), (1, "b", "P_10001", "value * 3", "y"), (2, "c", "10001", "value = 4", "z"),
        (3, "d", " ", "value", "z"),
    ])
    assert [r["rule_id"] for r in current_rules(three).collect()] == ["b"]
    assert output(apply_rules(readings(spark, [1.0]), three)) == [("y", 3.0), ("10001", 1.0)]
    both = apply_rules(readings(spark, [1.0]), three, multi=True)
    assert output(both) == [("x", 2.0), ("y", 3.0), ("10001", 1.0)]


def test_failures_and_counters(spark):
    two = rules(spark, [(0, "a", "10001", "P_10002 + 1", "x"), (1, "b", "10002", "value + +", "y"), (2, "c", "10003", "value / 2", "z")])
    some = readings(spark, [1, 2]).unionByName(readings(spark, [3], "10002", first_seq=2)).unionByName(
        readings(spark, [4], "10003", first_seq=3)).unionByName(readings(spark, [5], "10004", first_seq=4))
    evaluated = evaluate_rules(some, two)
    assert tuple(rule_counters(evaluated).first()) == (1, 1, 3)


def test_rule_changes(spark):
    changing = rules(spark, [(2, "a", "10001", "value * 2", "x"), (5, "b", "10001", "value * 3", "x")])
    series = readings(spark, [1.0] * 8)
    held = {r["seq"]: r["rule_id"] for r in rules_as_of(series, changing).collect()}
    assert held == {0: None, 1: None, 2: "a", 3: "a", 4: "a", 5: "b", 6: "b", 7: "b"}
    derived = apply_rules(series, changing, as_of=True).filter("ord = 0")
    assert [v for _, v in output(derived)] == [2.0] * 3 + [3.0] * 3


def simulated(series, changes, retention):
    """The stream operator on plain Python values: rule lookup, history, resets and flag."""
    history, started, out = [], None, []
    for seq, value in enumerate(series):
        current = [c for c in changes if c[0] <= seq]
        kind = current[-1][1] if current else None
        if kind == "avg":
            history.append((seq, value))
            history = [(s, v) for s, v in history if s > seq - retention]
            started = seq if started is None else started
            recent = [v for _, v in history[-4:]]
            out.append((seq, sum(recent) / len(recent), seq - started < retention))
        else:
            history, started = [], None
            if kind == "plain":
                out.append((seq, value * 2, False))
    return out


@pytest.mark.parametrize("retention, split_rows", [(1000, 10 ** 6), (3, 10 ** 6), (7, 12)])
def test_window_rules_restart(spark, retention, split_rows):
    changes = [(3, "avg"), (9, "plain"), (12, "avg"), (15, "avg"), (30, "plain"), (31, "avg")]
    texts = {"avg": "window_avg(4)", "plain": "value * 2"}
    table = rules(spark, [(at, f"r{at}", "10001", texts[kind], "x") for at, kind in changes])
    values = [float((i * 37) % 11) for i in range(50)]
    derived = apply_rules(
        readings(spark, values), table, as_of=True, retention_seconds=retention, split_rows=split_rows,
    ).filter("ord = 0")
    found = [(r["seq"], r["value"], r["has_inaccurate_data"]) for r in derived.orderBy("seq").collect()]
    expected = simulated(values, changes, retention)
    assert [f[0] for f in found] == [e[0] for e in expected]
    assert [f[1] for f in found] == pytest.approx([e[1] for e in expected])
    assert [f[2] for f in found] == [e[2] for e in expected]


def test_more_shapes_than_one_plan_holds(spark):
    signs = ["".join(s) for s in itertools.product("+-", repeat=7)][:69]
    texts = ["value" + "".join(f" {s} value" for s in line) for line in signs]
    table = rules(spark, [(n, f"r{n}", str(10000 + n), t, None) for n, t in enumerate(texts, 1)])
    rows = [(n, str(10000 + n), "D", n, None, 1.0, 0, False) for n in range(1, 72)]
    series = spark.createDataFrame(rows, readings(spark, []).schema)
    derived = evaluate_rules(series, table)
    assert {r["seq"]: r["result"] for r in derived.collect()} == {
        **{n: 1.0 + line.count("+") - line.count("-") for n, line in enumerate(signs, 1)}, 70: None, 71: None,
    }


def test_rule_that_changes_all_the_time(spark):
    table = rules(spark, [(n * 3, f"r{n}", "10001", f"value * {n}", "x") for n in range(2000)])
    series = spark.range(7000).selectExpr(
        "id AS seq", "CASE WHEN id % 10 = 9 THEN '10002' ELSE '10001' END AS sensor_id", "'D' AS device_id", "0 AS sensor_index",
        "timestamp_seconds(id) AS ts", "1.0D AS value", "0 AS state", "false AS has_inaccurate_data",
    )
    held = {r["seq"]: r["rule_id"] for r in rules_as_of(series, table).collect()}
    assert held == {n: None if n % 10 == 9 else f"r{min(n // 3, 1999)}" for n in range(7000)}


def test_history_flag_depends_on_the_text(spark):
    two = rules(spark, [(-2, "a", "10001", "state > 5 ? previous_x : value", "x"), (-1, "b", "10002", "state > 5 ? other : value", "y")])
    both = readings(spark, [4.0]).unionByName(readings(spark, [5.0], "10002", first_seq=1))
    derived = apply_rules(both, two).filter("ord = 0").orderBy("seq").collect()
    assert [(r["sensor_id"], r["value"], r["has_inaccurate_data"]) for r in derived] == [("x", 4.0, True), ("y", 5.0, False)]
