"""Sensor time series and user-written formulas as Spark DataFrame jobs."""

from sensorloom.session import build_session, configure

__all__ = ["build_session", "configure"]
