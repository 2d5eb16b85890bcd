"""Runs registered queries in Spark and their checks in DuckDB, and compares all rows.

    python -m tests.compare <data folder> [name or group ...]
"""

import math
import sys
import time

import duckdb

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def kinds(frame):
    """Kinds of the columns, so that 1 and 1.0 and '1' are told apart."""
    return {name: str(frame[name].dtype) for name in frame.columns}


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(row[i]) for i in order] for row in data), key=repr)


def compare(spark, connection, folder, name):
    """None if both give the same rows, else what differs."""
    df = entry.queries()[name](spark, folder)
    ours = rows(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if ours[1] else "no rows"
    result = connection.sql(sql)
    theirs = rows(result.columns, result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    spark_kinds = {n: k.replace("string", "varchar").replace("int", "integer") if k in ("string", "int") else k for n, k in df.dtypes}
    for column, kind in zip(result.columns, map(str, result.types)):
        if spark_kinds[column] != kind.lower() and "[]" not in kind:
            print(f"  note: {name}.{column} is {spark_kinds[column]} here and {kind} there")
    if ours[1] == theirs[1]:
        return None if ours[1] else "no rows"
    left = [r for r in ours[1] if r not in theirs[1]][:3] if len(ours[1]) < 20000 else []
    right = [r for r in theirs[1] if r not in ours[1]][:3] if len(theirs[1]) < 20000 else []
    return f"{len(ours[1])} / {len(theirs[1])} rows; columns {ours[0]}; only here {left}; only there {right}"


def main():
    from sensorloom.session import build_session

    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    folder, wanted = sys.argv[1], sys.argv[2:]
    names = [n for n, job in entry.queries().items() if not wanted or n in wanted or getattr(job, "group", "llm") in wanted]
    connection, bad = connect(folder), 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, connection, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        checked = "same rows" if name in entry.oracle_sql() else "rows only"
        print(f"{name}: {problem or checked} ({time.time() - start:.1f} s)", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    spark.stop()


if __name__ == "__main__":
    main()
