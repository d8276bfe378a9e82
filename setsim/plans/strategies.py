"""Joins by name, with checked options."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.options import memory_entries
from ..functions.options import policy as parse_policy
from ..functions.similarity import MEASURES, Jaccard
from ..operators import classes, cost, joins, partitions, statistics
from ..sources.collections import with_dense_ids
from ..sources.sinks import write_pairs
from .stages import Timer, stage

Join = Callable[[DataFrame, Jaccard], DataFrame]


def strategies(block_size: int = 10_000, bits: int = 64, entries: int | str = 1 << 20) -> dict[str, Join]:
    """All strategies with the given options; each takes a collection and a measure.

    entries, the length of candidate lists, may be a size in memory such as 512M.
    """
    entries = memory_entries(entries) if isinstance(entries, str) else entries
    return {
        "naive": joins.naive,
        "allpairs": joins.allpairs,
        "ppjoin": joins.ppjoin,
        "ppjoin_bitmap": lambda c, m: joins.ppjoin(c, m, bits=bits),
        "prefix_blocked": lambda c, m: joins.prefix_blocked(c, m, block_size),
        "bitmap": lambda c, m: joins.bitmap(c, m, bits, block_size),
        "hybrid_allpairs": lambda c, m: joins.hybrid(c, m, False, entries),
        "hybrid_ppjoin": lambda c, m: joins.hybrid(c, m, True, entries),
    }


def strategy(name: str, **options: int) -> Join:
    found = strategies(**options)
    if name not in found:
        raise ValueError(f"strategies are {', '.join(found)}; there is no {name!r}")
    return found[name]


def measure_of(threshold: float, name: str = "jaccard") -> Jaccard:
    if name not in MEASURES:
        raise ValueError(f"measures are {', '.join(MEASURES)}; there is no {name!r}")
    return MEASURES[name](threshold)


def similarity_join(collection: DataFrame, threshold: float = 0.95, algorithm: str = "ppjoin", measure: str = "jaccard", **options: int) -> DataFrame:
    """Similar pairs (id1, id2) of a collection; copies are joined once and expanded at the end."""
    join, bounds = strategy(algorithm, **options), measure_of(threshold, measure)
    return classes.joined(collection, lambda sets: join(sets, bounds))


def similarity_join_count(collection: DataFrame, threshold: float = 0.95, algorithm: str = "ppjoin", measure: str = "jaccard", **options: int) -> DataFrame:
    """One row n_pairs; equal sets are counted, not expanded."""
    return joins.count_by_classes(collection, strategy(algorithm, **options), measure_of(threshold, measure))


def between_classes(composed: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A composed join whose parts hold one set of each class of copies."""

    @wraps(composed)
    def joined(collection: DataFrame, *args, **options) -> DataFrame:
        return classes.joined(collection, lambda sets: composed(sets, *args, **options))

    return joined


@between_classes
def sqrt_partitioned(collection: DataFrame, threshold: float, parts: int = 2, algorithm: str = "ppjoin") -> DataFrame:
    """Parts that balance the triangle of pairs."""
    dense = with_dense_ids(collection)
    n = dense.count()
    return partitions.partitioned(dense, measure_of(threshold), partitions.square_root(F.col("dense_id"), n, parts), parts, strategy(algorithm))


@between_classes
def even_partitioned(collection: DataFrame, threshold: float, parts: int = 2, block_size: int = 10_000, algorithm: str = "ppjoin") -> DataFrame:
    """Parts of equally many blocks."""
    blocked = stage(partitions.with_blocks(collection, block_size), "blocked")
    n_blocks = -(-blocked.count() // block_size)
    return partitions.partitioned(blocked, measure_of(threshold), partitions.even(F.col("block_id"), n_blocks, parts), parts, strategy(algorithm))


@between_classes
def dichotomy(collection: DataFrame, threshold: float, split: float = 50, policy: str = "ppjoin,allpairs", block_size: int = 10_000) -> DataFrame:
    """Two joins: the smaller sets among themselves, and the larger ones with all; each by its own strategy."""
    small, large = (strategy(x) for x in parse_policy(policy))
    blocked = stage(partitions.with_blocks(collection, block_size), "blocked")
    n_blocks = -(-blocked.count() // block_size)
    parted = blocked.withColumn("is_small", partitions.dichotomy(F.col("block_id"), n_blocks, split))
    measure = measure_of(threshold)
    within = small(parted.where("is_small").select("set_id", "tokens", "n"), measure)
    return within.unionByName(large(parted.select("set_id", "tokens", "n", (~F.col("is_small")).alias("probing")), measure))


def block_pair_queue(collection: DataFrame, threshold: float, block_size: int = 10_000) -> DataFrame:
    """Surviving block pairs as work items that Spark's scheduler hands out, joined by prefixes."""
    return joins.prefix_blocked(collection, measure_of(threshold), block_size)


#: Which strategy stands for a technique of the cost model.
BY_TECHNIQUE = {"cpu": "ppjoin", "hybrid": "hybrid_ppjoin", "bitmap": "bitmap", "prefix": "prefix_blocked"}


def cost_based(collection: DataFrame, threshold: float, coefficients: dict[str, dict[str, float]], parts: int = 2, bits: int = 0) -> DataFrame:
    """Chooses a technique for every pair of partitions and joins each by its own."""
    dense = with_dense_ids(collection)
    n, measure = dense.count(), measure_of(threshold)
    parted = stage(dense.withColumn("part", partitions.even(F.col("dense_id"), n, parts)), "parted")
    universe = parted.agg(F.max(F.array_max("tokens"))).first()[0]
    runs = cost.choose(statistics.pair_features(parted, measure, (universe or 0) + 1), coefficients, bits).collect()  # parts * (parts + 1) / 2 rows
    out: DataFrame | None = None
    for r in runs:
        both = parted.where(F.col("part").isin(r["left"], r["right"]))
        sides = both.select("set_id", "tokens", "n", (F.col("part") == r["right"]).alias("probing"), (F.col("part") == r["left"]).alias("indexed"))
        pairs = strategy(BY_TECHNIQUE[r["technique"]], **({"bits": bits} if bits else {}))(sides, measure)
        out = pairs if out is None else out.unionByName(pairs)
    return out if out is not None else strategy("ppjoin")(collection, measure)


#: Joins composed of others, by name; each takes a collection, a threshold and options of its own.
COMPOSED = {"sqrt_partitioned": sqrt_partitioned, "even_partitioned": even_partitioned, "dichotomy": dichotomy, "block_pair_queue": block_pair_queue, "cost_based": cost_based}


def run(collection: DataFrame, threshold: float = 0.95, algorithm: str = "ppjoin", output: str = "", timer: Timer | None = None, **options) -> int:
    """Writes the pairs of a strategy or a composed join to `output`, or only counts them if it is empty; gives their number."""
    timer = timer or Timer()
    with timer.interval("join"):
        if algorithm in COMPOSED:
            if not output:
                return joins.count_by_classes(collection, lambda sets, m: COMPOSED[algorithm](sets, m.threshold, **options), measure_of(threshold)).first()["n_pairs"]
            pairs = COMPOSED[algorithm](collection, threshold, **options)
        elif not output:
            return similarity_join_count(collection, threshold, algorithm, **options).first()["n_pairs"]
        else:
            pairs = similarity_join(collection, threshold, algorithm, **options)
        pairs = stage(pairs, "pairs")
    with timer.interval("output"):
        write_pairs(pairs, output)
        return pairs.count()
