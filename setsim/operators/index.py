"""Prefix entries and the inverted index they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import Jaccard


def prefix_entries(collection: DataFrame, measure: Jaccard, side: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per prefix token: set_id, n, token, pos (from 0), and the columns in keep.

    side: probe or index, whose prefixes differ in length.
    """
    if side not in ("probe", "index"):
        raise ValueError(f"side is probe or index, not {side!r}")
    length = measure.maxprefix(F.col("n")) if side == "probe" else measure.midprefix(F.col("n"))
    return collection.select("set_id", "n", *keep, F.posexplode(F.slice("tokens", F.lit(1), length.cast("int"))).alias("pos", "token"))


def token_histogram(collection: DataFrame) -> DataFrame:
    """Sets that each token is in: token, freq."""
    return collection.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


def prefix_histogram(collection: DataFrame, measure: Jaccard, side: str = "index") -> DataFrame:
    """Entries of each token's posting list: token, freq."""
    return prefix_entries(collection, measure, side).groupBy("token").agg(F.count("*").alias("freq"))


def index_offsets(collection: DataFrame, measure: Jaccard, universe: int) -> DataFrame:
    """Where each token's list starts and ends in the concatenation of all lists: token, first, last.

    Offsets need a running sum over tokens. Lengths are summed within ranges of tokens and
    then over the ranges' totals, so no task sees more than a range.
    """
    ranges = max(1, min(1000, universe // 1000))
    freq = prefix_histogram(collection, measure)
    part = F.floor(F.col("token") * F.lit(float(ranges)) / F.lit(float(max(universe, 1)))).cast("int")
    freq = freq.withColumn("part", part)
    totals = freq.groupBy("part").agg(F.sum("freq").alias("s"))
    base = totals.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    last = F.sum("freq").over(Window.partitionBy("part").orderBy("token")) + F.col("base")
    return freq.join(F.broadcast(base), "part").select("token", (last - F.col("freq")).alias("first"), last.alias("last"))  # 1000 ranges at most


def postings(collection: DataFrame, measure: Jaccard) -> DataFrame:
    """The inverted index, a row per entry: token, set_id, pos, n."""
    return prefix_entries(collection, measure, "index").select("token", "set_id", "pos", "n")


def block_postings(blocked: DataFrame, measure: Jaccard, block_id: int) -> DataFrame:
    """The inverted index of one block of a collection with block_id: token, set_id, pos, n."""
    return postings(blocked.where(F.col("block_id") == block_id), measure)
