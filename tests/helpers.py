"""Small tables for the tests."""

from datetime import datetime, timedelta

from sensorloom import schemas

START = datetime(2024, 1, 1)


def readings(spark, values, sensor="10001", device="DEVICE-001", index=0, first_seq=0, step=1.0):
    rows = [
        (first_seq + i, sensor, device, index, START + timedelta(seconds=i * step), float(v), 0, False)
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, schemas.ARRIVED_READING)


def rules(spark, rows):
    """Rows of (seq, rule_id, target, expression, derived id)."""
    return spark.createDataFrame(
        rows, "seq long, rule_id string, target_sensor_id string, expression string, derived_sensor_id string",
    )


def formulas(spark, pairs):
    """Formulas of (id, expression) or (id, expression, serial, target)."""
    rows = [(p[0], p[2] if len(p) > 2 else None, p[0], p[1], "General", p[3] if len(p) > 3 else None, [], None, None, None, None) for p in pairs]
    return spark.createDataFrame(rows, schemas.FORMULA)
