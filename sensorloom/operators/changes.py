"""Tables kept as a log of changes: a change adds the rows it alters, and is refused if another came first.

    <path>/rows/<name>          Parquet: the changed rows of one commit; `_gone` marks deleted keys
    <path>/commits/<number>     JSON: which rows a version adds, and whether they stand for all before

A commit is a small file that is renamed to the number of its version, which fails if that is there; so of two writers
that saw the same version one is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another change was committed on the version that this one was made for."""


class ChangeLog:
    """A table with unique `keys` in a folder that driver and executors share, of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join((self.path, *parts)))

    def version(self) -> int:
        """Number of the newest commit, 0 for none."""
        folder = self._at("commits")
        if not self._files.exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in self._files.listStatus(folder) if s.getPath().getName().isdigit()), default=0)

    def _commits(self, version: int) -> list[dict]:
        """The commits that make up a version: from the last whole one on."""
        found = []
        for number in range(version, 0, -1):
            lines = self.spark.read.text(f"{self.path}/commits/{number:020d}").collect()
            found.append(json.loads(lines[0][0]))
            if found[-1]["whole"]:
                break
        return found[::-1]

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the newest: the last row of each key, without deleted ones."""
        commits = self._commits(self.version() if version is None else version)
        if not commits:
            raise ValueError(f"{self.path} has no version {version}")
        if len(commits) == 1:
            rows = self.spark.read.parquet(commits[0]["rows"])
        else:
            rows = self.spark.read.option("mergeSchema", "true").parquet(*[c["rows"] for c in commits])
            rest = [c for c in rows.columns if c not in self.keys]
            last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_version").alias("last"))
            rows = last.select(*self.keys, "last.*")
        return rows.filter("NOT _gone").drop("_gone", "_version")

    def commit(self, base: int, rows: DataFrame, whole: bool = False) -> int:
        """Add rows (with `_gone`) on top of version `base` and return the new version; Conflict if that is not the newest any more."""
        number, folder = base + 1, f"{self.path}/rows/{uuid.uuid4().hex}"
        rows.withColumn("_version", F.lit(number).cast("long")).write.parquet(folder)
        draft = self._at("commits", f".{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps({"rows": folder, "whole": whole}).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            # renaming without options fails if the name is there
            context.rename(draft, self._at("commits", f"{number:020d}"), options)
        except Exception as error:
            self._files.delete(draft, False)
            if "exist" not in str(error).lower():
                raise
            raise Conflict(f"version {number} of {self.path} was committed by another writer") from None
        return number

    def create(self, table: DataFrame) -> int:
        """The first version."""
        return self.commit(0, table.withColumn("_gone", F.lit(False)), whole=True)

    def change(self, work: Callable[[DataFrame], DataFrame], base: int | None = None) -> int:
        """Replace the table by `work` of it. Only rows that differ are written; nothing is, and `base` returned, if none do.

        `base` is the version that the change was made for, by default the newest.
        """
        base = self.version() if base is None else base
        before = self.snapshot(base)
        after = work(before).select(*before.columns)
        same = [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in self.keys]
        met = before.select(F.struct("*").alias("b")).join(after.select(F.struct("*").alias("a")), same, "full_outer")
        changed = met.filter(~F.col("a").eqNullSafe(F.col("b")))
        row = F.coalesce("a", "b")
        rows = changed.select(*[row[c].alias(c) for c in before.columns], F.col("a").isNull().alias("_gone"))
        return base if rows.isEmpty() else self.commit(base, rows)

    def compact(self) -> int:
        """Write the newest version as a whole, so that reading starts there."""
        base = self.version()
        return self.commit(base, self.snapshot(base).withColumn("_gone", F.lit(False)), whole=True)
