"""Materialised stages and timing."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def stage_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one where it is unset and Spark runs in one process.

    On a cluster each executor would see its own disk, so there an unset folder is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="setsim-"))
    return _own_dir[0]


#: Settings for the query that writes a stage: its shuffle files go when it ends, and Python workers get small batches of long texts.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Sets values for the queries that run within; the session's own are put back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table that several branches of a plan read, and reads it back.

    A prefix join reads its collection four times; without a stage Spark would plan the
    tokenising and ranking again for each. Files also outlive the executors that wrote them.
    """
    path = f"{stage_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with settings(df.sparkSession, WHILE_WRITING):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


class Timer:
    """Named wall-clock intervals; intervals of one name add up."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def interval(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    @property
    def total(self) -> float:
        return sum(self.seconds.values())

    def report(self) -> str:
        width = max([5, *map(len, self.seconds)])
        lines = [f"{name:<{width}} {s:10.3f} s" for name, s in self.seconds.items()]
        return "\n".join([*lines, f"{'total':<{width}} {self.total:10.3f} s"])
