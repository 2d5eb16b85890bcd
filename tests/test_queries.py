"""A sample of the registered queries against DuckDB; `python -m tests.compare` runs all."""

import pytest

import __spark_entry__ as entry
from sensorloom.plans import catalogue
from tests.compare import compare, connect

FOLDER = entry.SMOKE_FOLDER
SAMPLE = [
    "sensor_id_spellings", "audit_rule_texts", "sample_by_hour", "window_functions", "evaluate_on_demand_sampled",
    "apply_changing_rules", "evaluate_composite_formula", "decoded_messages", "formula_cycles", "created_sensors",
]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, duck, name):
    assert compare(spark, duck, FOLDER, name) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["sensor_id", "value", "state", "has_inaccurate_data", "ts_us"]


def test_every_query_has_a_check():
    assert set(catalogue.JOBS) == set(catalogue.CHECKS)
