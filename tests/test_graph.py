import random

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import graph
from sensorloom.operators.align import align_series
from sensorloom.operators.composite import dry_run, dry_run_table, evaluate_composite, simulation_metrics
from tests.helpers import formulas, readings


@pytest.fixture(scope="module")
def chain(spark):
    return formulas(spark, [
        ("BASE_TEMP_F", "sensor_000 * 1.8 + 32"), ("HEAT_INDEX", "BASE_TEMP_F * 1.05 + 10"),
        ("COMPOSITE_METRIC", "HEAT_INDEX + window_avg(5) - sensor_001"),
    ])


@pytest.fixture(scope="module")
def looped(spark):
    return formulas(spark, [("A", "B + 1"), ("B", "A * 2"), ("C", "D + A"), ("D", "value"), ("E", "E + 1")])


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_references(spark):
    table = formulas(spark, [("X", "value", 20001), ("Y", "X + P_20001 + sn_10001 + P_10002 + flow_stream + sensor_x + zzz + abs(1)")])
    found = pairs(graph.formula_references(table).select("src", "kind", "ref"))
    assert found == {
        ("Y", "formula", "X"), ("Y", "sensor", "10001"), ("Y", "sensor", "10002"),
        ("Y", "sensor", "flow_stream"), ("Y", "sensor", "sensor_x"),
    }


def test_order(spark, chain):
    steps, sensors = graph.formula_tree(chain, "COMPOSITE_METRIC")
    assert [s["id"] for s in steps] == ["BASE_TEMP_F", "HEAT_INDEX", "COMPOSITE_METRIC"]
    target = spark.createDataFrame([("COMPOSITE_METRIC",)], "id string")
    order = graph.evaluation_order(chain, target).orderBy("level", "id").collect()
    assert [r["id"] for r in order] == ["BASE_TEMP_F", "HEAT_INDEX", "COMPOSITE_METRIC"]
    needed = graph.required_sensors(chain, target)
    assert pairs(needed.select("sensor")) == {("sensor_000",), ("sensor_001",)}
    assert pairs(graph.dependents(chain)) == {("BASE_TEMP_F", "HEAT_INDEX"), ("HEAT_INDEX", "COMPOSITE_METRIC")}


def test_cycles(looped):
    found = {r["id"]: r for r in graph.find_cycles(looped).collect()}
    assert found["A"]["cycle_path"] == ["A", "B", "A"]
    assert found["C"]["cycle_path"] == ["C", "A", "B", "A"]
    assert found["E"]["cycle_path"] == ["E", "E"]
    assert not found["D"]["has_cycle"]
    with pytest.raises(ValueError, match="is part of a cycle"):
        graph.formula_tree(looped, "A")
    assert pairs(graph.self_references(looped)) == {("E",)}


def counted_rounds(monkeypatch):
    rounds, real = [0], graph.cut

    def cut(df):
        rounds[0] += 1
        return real(df)

    monkeypatch.setattr(graph, "cut", cut)
    return rounds


def link_table(spark, monkeypatch, n, uses):
    """Formulas 0..n-1 with given uses, without texts to be read."""
    links = spark.createDataFrame([(f"N{a}", f"N{b}", k) for a, of in enumerate(uses) for k, b in enumerate(of)], "src string, dst string, pos int")
    monkeypatch.setattr(graph, "edges", lambda _: links)
    return spark.range(n).select(F.concat(F.lit("N"), F.col("id").cast("string")).alias("id"))


def plain_cycles(uses):
    """Path of first uses that lead to a cycle, until a formula comes again."""
    stuck = set(range(len(uses)))
    while free := {a for a in stuck if not stuck & set(uses[a])}:
        stuck -= free
    out = []
    for a in range(len(uses)):
        path = [a] if a in stuck else None
        while path and path.count(path[-1]) == 1:
            path.append(next(b for b in uses[path[-1]] if b in stuck))
        out.append(path)
    return out


def test_cycles_of_random_graphs(spark, monkeypatch):
    rng = random.Random(8)
    for n, most in ((1, 1), (30, 1), (40, 2), (60, 3)):
        uses = [list(dict.fromkeys(rng.choice([rng.randrange(n), (a + 1) % n, a // 2]) for _ in range(rng.randrange(most + 1)))) for a in range(n)]
        found = {r["id"]: r["cycle_path"] for r in graph.find_cycles(link_table(spark, monkeypatch, n, uses)).collect()}
        assert found == {f"N{a}": path and [f"N{b}" for b in path] for a, path in enumerate(plain_cycles(uses))}


def test_long_chain_into_a_cycle(spark, monkeypatch):
    n = 10_000
    uses = [[a + 1] for a in range(n - 1)] + [[n - 3]]
    rounds = counted_rounds(monkeypatch)
    found = graph.find_cycles(link_table(spark, monkeypatch, n, uses)).select("id", F.size("cycle_path").alias("n"), F.element_at("cycle_path", -1).alias("last"))
    assert found.filter(F.col("n") != F.greatest(F.lit(4), n - F.substring("id", 2, 9).cast("int") + 1)).isEmpty()
    assert found.filter("id = 'N0'").first()["last"] == f"N{n - 3}"
    # seven rounds each to follow single uses and to lengthen the paths, and what is written once
    assert rounds[0] <= 7 + 7 + 8


def plain_closure(uses, targets):
    out = set()
    for t in targets:
        seen, edge = {t}, [t]
        while edge:
            edge = [b for b in {b for a in edge for b in uses[a]} if b not in seen]
            seen |= set(edge)
        out |= {(f"N{t}", f"N{x}") for x in seen}
    return out


def test_closure_of_a_deep_graph(spark, monkeypatch):
    rng = random.Random(4)
    n = 120
    deep = [[b for b in {a - 1, rng.randrange(a) if a else 0, a - 7} if 0 <= b < a] if a < 25 else [rng.randrange(25)] for a in range(n)]
    looped = [*deep[:-6], [n - 5, 3], [n - 4], [n - 6, 24], [n - 3], [n - 2, 7, n - 3], [n - 1]]
    for uses in (deep, looped):
        table = link_table(spark, monkeypatch, n, uses)
        rounds = counted_rounds(monkeypatch)
        targets = table.filter(F.substring("id", 2, 9).cast("int") % 3 != 1)
        assert pairs(graph.closure(table, targets)) == plain_closure(uses, [a for a in range(n) if a % 3 != 1])
        # two for each level of the peeling; the pairs are written once a level, not rewritten
        assert rounds[0] <= 2 * 26 + 12


def test_delete_guard(spark, chain):
    asked = spark.createDataFrame([("BASE_TEMP_F",), ("COMPOSITE_METRIC",)], "id string")
    assert [tuple(r) for r in graph.blocked_deletes(chain, asked).collect()] == [("BASE_TEMP_F", "HEAT_INDEX")]
    assert pairs(graph.delete_formulas(chain, asked).select("id")) == {("BASE_TEMP_F",), ("HEAT_INDEX",)}


def test_aliases(spark):
    table = formulas(spark, [("PUMP_1", "value", 20001)]).withColumn("sensor_code", F.lit("pump-1"))
    asked = spark.createDataFrame([(x,) for x in ["PUMP_1", "pump-1", "20001", "P_20001", "SN_20001", " pump 1", "none"]], "name string")
    found = {r["name"]: r["formula_id"] for r in graph.find_formulas(table, asked).collect()}
    assert [n for n, f in found.items() if f is None] == ["none"]


def test_aliases_by_frequent_names(spark):
    table = formulas(spark, [(f"F{k}", "value", 20001 + k) for k in range(9)])
    asked = spark.createDataFrame([(n, [None, "none", "F1", " f2", f"P_{20001 + n % 9}"][n % 5]) for n in range(200)], "n long, name string")
    expected = {(n, [None, None, "F1", "F2", f"F{n % 9}"][n % 5]) for n in range(200)}
    whole = graph.find_formulas(table, asked).select("n", "formula_id")
    assert "Broadcast" not in whole._jdf.queryExecution().executedPlan().toString()
    assert whole.count() == 200 and pairs(whole) == expected
    split = graph.find_formulas(table, asked, split_rows=10).select("n", "formula_id")  # three names and null are frequent
    assert split.count() == 200 and pairs(split) == expected


def test_composite(spark, chain):
    both = readings(spark, range(20), "sensor_000").unionByName(readings(spark, [2] * 30, "sensor_001"))
    points = evaluate_composite(both, chain, "COMPOSITE_METRIC", duration=100)
    rows = points.orderBy("pos").collect()
    assert len(rows) == 20
    for i, row in enumerate(rows):
        window = [float(v) for v in range(max(0, i - 4), i + 1)]
        expected = (i * 1.8 + 32) * 1.05 + 10 + sum(window) / len(window) - 2
        assert row["computed_value"] == pytest.approx(expected, abs=6e-4)
    metrics = simulation_metrics(points, 10).first()
    assert (metrics["total_points"], metrics["nan_count"]) == (2, 0)
    assert metrics["min"] == pytest.approx(rows[0]["computed_value"], abs=0.006)


def test_serial_composite(spark):
    both = readings(spark, [100] * 3, "10002").unionByName(readings(spark, [49.999] * 5, "10004"))
    table = formulas(spark, [("RATIO", "P_10002 / (P_10004 + 0.001)", None, "10002")])
    assert {r["computed_value"] for r in evaluate_composite(both, table, "RATIO").collect()} == {2.0}


def test_failures_are_zero_and_counted(spark):
    table = formulas(spark, [("A", "nothing + 1", None, "s"), ("B", "A + 0 / (value - value)", None, "s")])
    points = evaluate_composite(readings(spark, [1, 2, 3], "s"), table, "B")
    assert {r["computed_value"] for r in points.collect()} == {0.0}
    assert simulation_metrics(points).first()["nan_count"] == 3


def test_align(spark):
    a, b = readings(spark, [1, 2, 3], "a"), readings(spark, [7, 8], "b")
    steps = align_series(a.unionByName(b), ["a", "b"])
    assert [tuple(r)[2:] for r in steps.orderBy("pos").collect()] == [(1.0, 7.0), (2.0, 8.0)]
    assert align_series(a, ["a", "b"]).count() == 0
    zero = align_series(a, ["a", "b"], missing="zero").orderBy("pos").collect()
    assert [tuple(r)[2:] for r in zero] == [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)]
    late = readings(spark, [5, 6], "b", step=2)
    at = align_series(a.unionByName(late), ["a", "b"], by="ts").orderBy("pos").collect()
    assert [tuple(r)[2:] for r in at] == [(1.0, 5.0), (3.0, 6.0)]
    long = readings(spark, range(300), "a").unionByName(readings(spark, range(300), "b"))
    rows = align_series(long, ["a", "b"], split_rows=30).orderBy("pos").collect()
    assert [r["a"] for r in rows] == [float(i) for i in range(300)] == [r["b"] for r in rows]


def test_dry_run(spark):
    table = formulas(spark, [("A", "P_10001 + value"), ("B", "A * 2 + window_avg(3)"), ("C", "zzz + 1"), ("D", "1 / 3"), ("E", "sensor_001 > 45 ? abs(0-A) : 0")])
    expected = {"A": 95.5, "B": 194.0, "C": None, "D": 0.333, "E": 72.0}
    assert {r["id"]: r["result"] for r in dry_run_table(table).collect()} == expected
    assert dry_run(table, "A * 2 + window_avg(3)").first()[0] == 194.0
