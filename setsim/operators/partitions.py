"""Blocks of sets, and partitions of blocks that share out a self-join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Jaccard
from ..sources.collections import with_dense_ids


def block_of(dense_id: Column, block_size: int) -> Column:
    return F.floor(dense_id / F.lit(float(block_size))).cast("long")


def with_blocks(collection: DataFrame, block_size: int = 10_000) -> DataFrame:
    """Adds dense_id and block_id: sets in the order of (n, set_id), block_size to a block."""
    if block_size < 1:
        raise ValueError("a block has one set at least")
    dense = collection if "dense_id" in collection.columns else with_dense_ids(collection)
    return dense.withColumn("block_id", block_of(F.col("dense_id"), block_size))


def even(block_id: Column, n_blocks: int, parts: int) -> Column:
    """Runs of equally many blocks; the last may be shorter, and none is left out."""
    return F.floor(block_id / F.lit(float(max(1, -(-n_blocks // parts))))).cast("int")


def dichotomy(block_id: Column, n_blocks: int, split: float) -> Column:
    """Whether a block is in the first part, of split percent of the blocks, rounded up; 0 and 100 leave one empty."""
    if not 0 <= split <= 100:
        raise ValueError("a split is a percentage")
    return block_id < math.ceil(split / 100 * n_blocks)


def square_root_cuts(n_sets: int, parts: int) -> list[int]:
    """Ids below which parts end, such that each part's probes meet about as many smaller sets."""
    if parts < 1:
        raise ValueError("a collection has one part at least")
    return [int(n_sets * math.sqrt((i + 1) / parts)) for i in range(parts - 1)] + [n_sets]


def square_root(dense_id: Column, n_sets: int, parts: int) -> Column:
    out: Column = F.lit(0)
    for cut in square_root_cuts(n_sets, parts)[:-1]:
        out = out + (dense_id >= cut).cast("int")
    return out


def partitioned(collection: DataFrame, measure: Jaccard, part: Column, parts: int, join) -> DataFrame:
    """The self-join as a union of joins, one per part: its probes against all sets up to its last.

    `collection` has dense_id; `part` is an expression on its rows that ascends with
    dense_id. Only the part's own sets probe, so no pair is made twice; any strategy can be used.
    """
    parted = collection.withColumn("part", part)
    out: DataFrame | None = None
    for k in range(parts):
        sides = parted.where(F.col("part") <= k).select("set_id", "tokens", "n", (F.col("part") == k).alias("probing"))
        pairs = join(sides, measure)
        out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        raise ValueError("a collection has one part at least")
    return out
