"""Exact overlap of candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Jaccard


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def verify(candidates: DataFrame, collection: DataFrame, measure: Jaccard) -> DataFrame:
    """Candidates (id1, id2) whose sets share enough tokens; both sets are joined to their ids."""
    one = collection.select(F.col("set_id").alias("id1"), F.col("tokens").alias("t1"), F.col("n").alias("n1"))
    two = collection.select(F.col("set_id").alias("id2"), F.col("tokens").alias("t2"), F.col("n").alias("n2"))
    both = candidates.select("id1", "id2").join(one, "id1").join(two, "id2")
    return both.where(overlap(F.col("t1"), F.col("t2")) >= measure.minoverlap(F.col("n1"), F.col("n2"))).select("id1", "id2")


def candidate_lists(candidates: DataFrame, entries: int) -> DataFrame:
    """Candidates as (id1, batch, candidates): lists of bounded length, several for a probe with very many."""
    sized = candidates.groupBy("id1").agg(F.count("*").alias("m"))
    batches = F.ceil(F.col("m") / F.lit(float(max(1, entries))))
    dealt = candidates.join(sized, "id1").select("id1", "id2", F.pmod(F.xxhash64("id2"), batches).alias("batch"))
    return dealt.groupBy("id1", "batch").agg(F.collect_list("id2").alias("candidates"))


def verify_lists(lists: DataFrame, collection: DataFrame, measure: Jaccard) -> DataFrame:
    """As verify, over candidate lists: a probe's tokens are joined once per list instead of once per candidate."""
    one = collection.select(F.col("set_id").alias("id1"), F.col("tokens").alias("t1"), F.col("n").alias("n1"))
    two = collection.select(F.col("set_id").alias("id2"), F.col("tokens").alias("t2"), F.col("n").alias("n2"))
    both = lists.join(one, "id1").select("id1", "t1", "n1", F.explode("candidates").alias("id2")).join(two, "id2")
    return both.where(overlap(F.col("t1"), F.col("t2")) >= measure.minoverlap(F.col("n1"), F.col("n2"))).select("id1", "id2")
