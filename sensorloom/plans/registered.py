"""The table of registered queries: name, DataFrame job and check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sensorloom.plans.tables import Tables, micros, rounded, with_tables

JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a job under its function name; `sql` gives the same rows in DuckDB."""
    def add(job: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(micros(job(Tables(spark, folder))))

        run.group = job.__module__.rpartition(".")[2]
        JOBS[job.__name__] = run
        if sql is not None:
            CHECKS[job.__name__] = with_tables(sql)
        return job

    return add
