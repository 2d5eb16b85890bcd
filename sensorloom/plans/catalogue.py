"""All registered queries."""

from sensorloom.plans import series, tables_of_sensors, values, watching  # noqa: F401
from sensorloom.plans.registered import CHECKS, JOBS

__all__ = ["CHECKS", "JOBS"]
