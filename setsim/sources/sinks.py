"""Results: pairs as text or rows, or only their number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Lines of two ids with a blank between, the probe first; their order is not fixed."""
    pairs.select(F.concat_ws(" ", F.col("id1").cast("string"), F.col("id2").cast("string"))).write.mode("overwrite").text(path)


def read_pairs(spark, path: str) -> DataFrame:
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].cast("long").alias("id1"), parts[1].cast("long").alias("id2"))


def count_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n_pairs"))
