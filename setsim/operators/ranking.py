"""Global row numbers without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import stage

#: Rows that one task may number; more are dealt out by range.
MAX_SINGLE = 1_000_000


def ranked(df: DataFrame, order: list[str], name: str, max_single: int = MAX_SINGLE, at_most: int | None = None) -> DataFrame:
    """Adds `name`, the row's place from 0 in the order of the given columns, which must tell rows apart.

    Beyond max_single rows, ranges of the order go to partitions, rows are numbered within
    each, and each range starts at the number of rows in the ranges before it; only those
    counts, one per partition, meet in one place. at_most is a bound on the rows, if one is
    known; if it is small, they need not be counted.
    """
    if at_most is None or at_most > max_single:
        df = stage(df, "to-rank")
        at_most = df.count()
    if at_most <= max_single:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    parted = stage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = parted.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(counts.select("__part", F.coalesce(before, F.lit(0)).alias("__start")))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parted.withColumn("__k", within).join(starts, "__part").withColumn(name, F.col("__start") + F.col("__k") - 1).drop("__part", "__k", "__start")
