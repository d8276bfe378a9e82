"""Filters that drop pairs which cannot be similar: length, order, position, signature, block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bitmaps import hamming, overlap_bound
from ..functions.similarity import Jaccard


def length_filter(measure: Jaccard, n1: Column, n2: Column) -> Column:
    """Whether an indexed set of n2 tokens is large enough for a probe of n1."""
    return measure.long_enough(n1, n2)


def upper_length_filter(measure: Jaccard, n1: Column, n2: Column) -> Column:
    """Whether an indexed set is small enough; always so where probes are the larger sets."""
    return n2 <= measure.maxsize(n1)


def probe_first(n1: Column, id1: Column, n2: Column, id2: Column) -> Column:
    """Whether the first set follows the second in the order of (size, id): each pair once, no set with itself."""
    return (n1 > n2) | ((n1 == n2) & (id1 > id2))


def bitmap_filter(measure: Jaccard, n1: Column, n2: Column, b1: Column, b2: Column, bits: int) -> Column:
    return overlap_bound(n1, n2, hamming(b1, b2, bits)) >= measure.minoverlap(n1, n2)


def block_summary(blocked: DataFrame, measure: Jaccard | None = None) -> DataFrame:
    """One row per block of a collection with dense_id and block_id; with a measure also `entries`, of the index of the block's prefixes."""
    rollup = [F.min("dense_id").alias("start_id"), F.max("dense_id").alias("end_id"), F.count("*").alias("n_sets"), F.sum(F.col("n").cast("long")).alias("n_tokens"), F.avg("n").alias("avg_set_size"), F.min("n").cast("long").alias("min_n"), F.max("n").cast("long").alias("max_n")]
    if measure is not None:
        rollup.append(F.sum(measure.midprefix(F.col("n"))).alias("entries"))
    return blocked.groupBy("block_id").agg(*rollup)


def largest_block(summary: DataFrame) -> DataFrame:
    """One row: the most index entries that a block has, for sizing what holds a block's index."""
    return summary.agg(F.coalesce(F.max("entries"), F.lit(0)).cast("long").alias("max_entries"))


def surviving_block_runs(summary: DataFrame, measure: Jaccard) -> DataFrame:
    """For each probe block the first of the run of blocks, up to itself, that may hold similar sets: probe_block, first.

    Blocks ascend by size. The run's start is the least block among those that reach the
    probe's bound: a running minimum over blocks and bounds from large to small. It has two
    rows per block, and a block stands for thousands of sets.
    """
    nothing = F.lit(None).cast("long")
    bounds = summary.select(measure.minsize(F.col("min_n")).alias("v"), F.lit(1).alias("kind"), F.col("block_id").alias("probe_block"), nothing.alias("b"))
    reach = summary.select(F.col("max_n").alias("v"), F.lit(0).alias("kind"), nothing.alias("probe_block"), F.col("block_id").alias("b"))
    so_far = Window.orderBy(F.desc("v"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bounds.union(reach).withColumn("first", F.min("b").over(so_far)).where("kind = 1").select("probe_block", "first")


def surviving_block_pairs(summary: DataFrame, measure: Jaccard) -> DataFrame:
    """Pairs of blocks (probe_block, index_block) that may hold similar sets; pairs that fail are never made."""
    return surviving_block_runs(summary, measure).select("probe_block", F.explode(F.sequence("first", "probe_block")).alias("index_block"))
