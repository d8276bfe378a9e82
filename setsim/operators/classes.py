"""Joins over classes of equal sets, and the pairs of sets that their pairs stand for.

Equal sets have the same bounds and the same candidates, so one of them is joined for all.
A class has a bounded number of members; more copies than that make several classes, which
the join finds as it finds other similar sets, so no row and no task stands for a large group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stages import stage
from .filters import probe_first

#: Members of a class at most: a pair of classes stands for the square of it.
MOST_MEMBERS = 256
#: Classes are made if the sets that differ are estimated at this share of all, or less.
WORTH = 0.9
#: Bytes of classes up to which they are broadcast to the pairs.
MAX_BROADCAST_MEMBERS = 32 << 20


def has_copies(collection: DataFrame) -> bool:
    """Whether enough sets are equal for classes to save work; an estimate that only chooses the plan."""
    every, different = collection.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("tokens"))).first()
    return different <= WORTH * every


def of(collection: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """The classes of a collection, staged: set_id (the least member's), tokens, n, members."""
    equal = collection.groupBy("tokens", "n").agg(F.sort_array(F.collect_list("set_id")).alias("every"))
    starts = F.sequence(F.lit(1), F.size("every"), F.lit(most))
    cut = equal.select("tokens", "n", F.explode(F.transform(starts, lambda k: F.slice("every", k, F.lit(most)))).alias("members"))
    return stage(cut.select(F.col("members")[0].alias("set_id"), "tokens", "n", "members"), "classes")


def sets(classes: DataFrame) -> DataFrame:
    """The classes as a collection of their own."""
    return classes.select("set_id", "tokens", "n")


def expanded(pairs: DataFrame, classes: DataFrame, directed: bool = False) -> DataFrame:
    """Pairs of sets for pairs of classes, those of different classes: id1, id2 and the pairs' other columns.

    Undirected pairs come once for two classes, and of sets of one size the larger id goes
    first. Directed ones say that the first class's members find the second's, where both
    are of one size only those of smaller id; the other direction is a pair of its own.
    The pairs are staged: with the join that makes them the plan is one method too long to be compiled.
    """
    pairs = stage(pairs, "class-pairs")
    many = classes.select("set_id", "n", "members")
    size = classes.agg(F.sum(64 + 8 * F.size("members").cast("long"))).first()[0] or 0
    small = F.broadcast if size <= MAX_BROADCAST_MEMBERS else (lambda df: df)
    rest = [c for c in pairs.columns if c not in ("id1", "id2")]
    met = pairs.join(small(many.toDF("id1", "n1", "m1")), "id1").join(small(many.toDF("id2", "n2", "m2")), "id2")
    each = met.select("n1", "n2", "m2", F.explode("m1").alias("a"), *rest).select("n1", "n2", "a", F.explode("m2").alias("b"), *rest)
    n1, n2, a, b = (F.col(c) for c in ("n1", "n2", "a", "b"))
    if directed:
        return each.where(probe_first(n1, a, n2, b)).select(a.alias("id1"), b.alias("id2"), *rest)
    larger = n1 > n2
    return each.select(F.when(larger, a).otherwise(F.greatest(a, b)).alias("id1"), F.when(larger, b).otherwise(F.least(a, b)).alias("id2"), *rest)


def within(classes: DataFrame, **columns: Column) -> DataFrame:
    """Pairs of the members of each class; columns are expressions on the class's row."""
    many = classes.where(F.size("members") > 1).select("members", *(c.alias(k) for k, c in columns.items()))
    each = many.select("members", F.explode("members").alias("id1"), *columns)
    return each.select("id1", F.explode(F.filter("members", lambda m: m < F.col("id1"))).alias("id2"), *columns)


def joined(collection: DataFrame, join: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs of a join, which is made between classes where there are copies."""
    if {"probing", "indexed"} & set(collection.columns) or not has_copies(collection):
        return join(collection)
    classes = of(collection)
    return expanded(join(sets(classes)), classes).unionByName(within(classes))
