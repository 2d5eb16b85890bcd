"""Tables kept as a log of changes."""

import tempfile

import pytest
from pyspark.sql import functions as F

from sensorloom.operators.changes import ChangeLog, Conflict


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def log(spark):
    held = ChangeLog(spark, tempfile.mkdtemp(prefix="run-"), ["serial"])
    assert held.create(spark.createDataFrame([(n, f"s{n}", None) for n in range(6)], "serial long, name string, note string")) == 1
    return held


def renamed(name, serial):
    return lambda df: df.withColumn("name", F.when(F.col("serial") == serial, name).otherwise(F.col("name")))


def test_changes_fold_to_a_snapshot(spark, log):
    assert log.change(renamed("a", 1)) == 2
    assert log.change(lambda df: df.filter("serial <> 2").unionByName(spark.createDataFrame([(9, "new", "n")], df.schema))) == 3
    assert log.change(renamed("b", 1)) == 4
    assert log.change(lambda df: df.unionByName(spark.createDataFrame([(2, "again", None)], df.schema))) == 5
    want = [(0, "s0", None), (1, "b", None), (2, "again", None), (3, "s3", None), (4, "s4", None), (5, "s5", None), (9, "new", "n")]
    assert rows(log.snapshot()) == want
    assert rows(log.snapshot(2))[1] == (1, "a", None) and 2 not in {r[0] for r in rows(log.snapshot(3))}
    # only what differs was written
    assert [spark.read.parquet(c["rows"]).count() for c in log._commits(5)] == [6, 1, 2, 1, 1]
    assert log.change(lambda df: df) == 5
    assert log.compact() == 6 and rows(log.snapshot()) == want and len(log._commits(6)) == 1
    assert log.change(renamed("c", 0)) == 7 and rows(log.snapshot())[0] == (0, "c", None)


def test_one_of_two_writers_is_refused(spark, log):
    other = ChangeLog(spark, log.path, ["serial"])
    seen = log.version()
    assert other.version() == seen
    assert log.change(renamed("mine", 3), base=seen) == seen + 1
    with pytest.raises(Conflict):
        other.change(renamed("theirs", 3), base=seen)
    assert rows(log.snapshot())[3] == (3, "mine", None)
    # on the new version it goes through
    assert other.change(renamed("theirs", 4)) == seen + 2
    assert rows(log.snapshot())[3:5] == [(3, "mine", None), (4, "theirs", None)]
    with pytest.raises(Conflict):
        log.create(log.snapshot())
