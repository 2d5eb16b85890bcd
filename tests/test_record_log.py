"""Record logs: appending, reading by offset, and the streaming job on them over restarts."""

import json
import tempfile
import threading
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sensorloom.sources.record_log import append_records, log_arrival, log_records
from sensorloom.streaming.evaluator import evaluate_records


def run_once(query):
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()


def test_stream_goes_on_where_it_stopped(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    sent = []

    def send(partition, n):
        rows = [(b"k", f"{partition}/{len(sent) + i}".encode(), [("h", None)]) for i in range(n)]
        sent.extend(r[1].decode() for r in rows)
        return append_records(f"{folder}/log", partition, rows)

    assert send(0, 3) == 0 and send(1, 2) == 0 and send(0, 4) == 3 and append_records(f"{folder}/log", 0, []) == 7

    def read():
        stream = log_records(spark, f"{folder}/log").withColumn("seq", log_arrival(F.col("timestamp"), F.col("partition")))
        run_once(stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
        return spark.read.parquet(f"{folder}/out").collect()

    assert sorted(r["value"].decode() for r in read()) == sorted(sent)
    send(1, 5)
    send(7, 1)  # a partition that was not there before
    rows = read()
    assert Counter(r["value"].decode() for r in rows) == Counter(sent)
    assert len({r["seq"] for r in rows}) == len(sent) == len({(r["partition"], r["offset"]) for r in rows})
    assert [r["offset"] for r in sorted(rows, key=lambda r: r["seq"]) if r["partition"] == 0] == list(range(7))
    assert len(read()) == len(sent)
    whole = log_records(spark, f"{folder}/log", stream=False)
    assert whole.count() == len(sent) and whole.first()["headers"] == [("h", None)]


def test_writers_at_once(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    firsts = []

    def write(name):
        for n in range(20):
            firsts.append((append_records(folder, 3, [(None, f"{name}-{n}-{i}".encode(), []) for i in range(3)], datetime(2024, 1, 1)), name))

    threads = [threading.Thread(target=write, args=(name,)) for name in "abcd"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = log_records(spark, folder, stream=False).withColumn("seq", log_arrival(F.col("timestamp"), F.col("partition"))).orderBy("offset").collect()
    assert [r["offset"] for r in rows] == list(range(240)) and sorted(f for f, _ in firsts) == list(range(0, 240, 3))
    assert len({r["value"] for r in rows}) == 240 and [r["seq"] for r in rows] == sorted({r["seq"] for r in rows})


def test_partition_numbers():
    with pytest.raises(ValueError, match="partitions"):
        append_records(tempfile.mkdtemp(prefix="run-"), 1024, [])


def test_job_on_logs_over_restarts(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    at = datetime(2024, 1, 1)
    append_records(f"{folder}/rules", 0, [(None, json.dumps({"ruleId": "r", "targetSensorId": "P_10001", "expression": "window_avg(3)", "derivedSensorId": "P_10201"}).encode(), [])], at)
    for part in range(3):
        # all records of a part are appended in one microsecond each, far more than one a millisecond
        rows = [(b"device-001", json.dumps([{"sensorIndex": 0, "value": 100 * part + n}]).encode(), []) for n in range(50)]
        append_records(f"{folder}/sensors", 0, rows, at + timedelta(milliseconds=1))
        run_once(evaluate_records(log_records(spark, f"{folder}/sensors"), log_records(spark, f"{folder}/rules"), f"{folder}/out", f"{folder}/checkpoint", from_logs=True, live=False))
    out = spark.read.parquet(f"{folder}/out")
    values = [float(100 * part + n) for part in range(3) for n in range(50)]
    assert [r["value"] for r in out.filter("ord = 1").orderBy("seq").collect()] == values
    want = [sum(values[max(0, i - 2):i + 1]) / len(values[max(0, i - 2):i + 1]) for i in range(len(values))]
    assert [r["value"] for r in out.filter("ord = 0").orderBy("seq").collect()] == pytest.approx(want)
