"""Features of partitions, as the cost model takes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Jaccard


def moments(values: Column) -> list[Column]:
    """Aggregates that merge across tasks: n, sum, min, max, mean, variances, skewness, kurtosis (3 for a normal shape)."""
    x = values.cast("double")
    return [
        F.count(x).alias("n"),
        F.sum(x).alias("total"),
        F.min(x).alias("least"),
        F.max(x).alias("most"),
        F.avg(x).alias("mean"),
        F.var_pop(x).alias("variance_n"),
        F.var_samp(x).alias("variance"),
        F.skewness(x).alias("skew"),
        (F.kurtosis(x) + 3).alias("kurt"),
    ]


def size_moments(collection: DataFrame) -> DataFrame:
    return collection.agg(*moments(F.col("n")))


def partition_features(parted: DataFrame, measure: Jaccard, universe: int, by: str = "part") -> DataFrame:
    """Per partition: dataset_size, avg_set_size, set_size_std, token_freq, index_size, universe_size.

    token_freq is the deviation of the tokens' prefix frequencies over the whole universe,
    tokens of no prefix included; sums of frequencies and of their squares give it without them.
    """
    sizes = parted.groupBy(by).agg(F.count("*").alias("dataset_size"), F.avg("n").alias("avg_set_size"), F.stddev_pop("n").alias("set_size_std"))
    prefix = F.slice("tokens", F.lit(1), measure.midprefix(F.col("n")).cast("int"))
    freq = parted.select(by, F.explode(prefix).alias("token")).groupBy(by, "token").agg(F.count("*").alias("f"))
    u = F.lit(float(max(universe, 1)))
    sums = freq.groupBy(by).agg(F.sum("f").alias("index_size"), F.sum(F.col("f").cast("double") * F.col("f")).alias("squares"))
    mean = F.col("index_size") / u
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / u - mean * mean))
    return sizes.join(sums, by).select(by, "dataset_size", "avg_set_size", "set_size_std", deviation.alias("token_freq"), "index_size", F.lit(universe).cast("long").alias("universe_size"))


def pair_features(parted: DataFrame, measure: Jaccard, universe: int, by: str = "part") -> DataFrame:
    """Features of each pair of partitions left <= right, taken together; index_size is the left one's.

    The number of partitions is an option of a few units, so pairs are listed.
    """
    parts = parted.select(by).distinct()
    pairs = parts.select(F.col(by).alias("left")).join(parts.select(F.col(by).alias("right")), F.col("left") <= F.col("right"))
    pairs = pairs.select("left", "right", F.struct("left", "right").alias("pair"), F.explode(F.array_distinct(F.array("left", "right"))).alias(by))
    together = partition_features(parted.join(F.broadcast(pairs), by), measure, universe, "pair")
    own = partition_features(parted, measure, universe, by).select(F.col(by).alias("left"), F.col("index_size").alias("left_index"))
    both = together.select("pair.left", "pair.right", *(c for c in together.columns if c not in ("pair", "index_size")))
    return both.join(own, "left").withColumnRenamed("left_index", "index_size")
