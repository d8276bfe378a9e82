"""Exact set-similarity self-joins.

Every strategy gives the same pairs (id1, id2), the probe first: the set that follows in
the order of (size, id). They differ in how candidates are found and verified.

A collection may say which of its sets probe and which are indexed, in boolean columns
`probing` and `indexed`; without them all are both. A pair is found if its probe probes and
its other set is indexed, so parts of a join are joined without the pairs of other parts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bitmaps import MAX_UNIVERSE, bitmap_words, bits_below, exact_bits, shared_bits, signature
from ..functions.similarity import Jaccard
from ..plans.stages import stage
from . import cells, classes
from .filters import bitmap_filter, block_summary, length_filter, probe_first, surviving_block_pairs, surviving_block_runs
from .index import prefix_entries
from .partitions import with_blocks
from .verify import candidate_lists, overlap, verify, verify_lists

#: Mean set size up to which prefix entries carry their whole set.
CARRY_SIZE = 48
#: Bytes of prefix entries up to which Spark may broadcast them; beyond, they are merged by key.
MAX_BROADCAST_ENTRIES = 32 << 20


def probing(collection: DataFrame) -> DataFrame:
    return collection.where("probing") if "probing" in collection.columns else collection


def indexed(collection: DataFrame) -> DataFrame:
    return collection.where("indexed") if "indexed" in collection.columns else collection


def naive(collection: DataFrame, measure: Jaccard) -> DataFrame:
    """Counts the shared tokens of all pairs; the yardstick for the others.

    Pairs meet at their tokens, or in ranges of sizes where tokens are so few that sets are bits.
    """
    seen = shape(collection, measure)
    n1, n2 = F.col("n1"), F.col("n2")
    if words := seen.words:
        one, two = (numbered(side, k, words) for side, k in zip(bit_sides(collection, seen), (1, 2), strict=True))
        one = one.withColumn("sizes", F.explode(size_ranges(measure, n1)))
        met = one.join(two.withColumn("sizes", measure.size_range(n2)), "sizes").where(probe_first(n1, F.col("id1"), n2, F.col("id2")) & length_filter(measure, n1, n2))
        return met.where(shared_bits(bit_columns(words, 1), bit_columns(words, 2)) >= measure.minoverlap(n1, n2)).select("id1", "id2")
    entries = lambda sets: sets.select("set_id", "n", F.explode("tokens").alias("token"))
    one = entries(probing(collection)).select(F.col("set_id").alias("id1"), F.col("n").alias("n1"), "token")
    two = entries(indexed(collection)).select(F.col("set_id").alias("id2"), F.col("n").alias("n2"), "token")
    pairs = one.join(two, "token").where(probe_first(n1, F.col("id1"), n2, F.col("id2")) & length_filter(measure, n1, n2))
    counted = pairs.groupBy("id1", "n1", "id2", "n2").agg(F.count("*").alias("shared"))
    return counted.where(F.col("shared") >= measure.minoverlap(n1, n2)).select("id1", "id2")


class Shape(NamedTuple):
    """Of a collection: sets, mean size, bounds on the bytes of all prefix entries without and with their sets, words of a set as bits, bytes of the index entries with them.

    Spark's own estimate is the size of the collection's files, which entries exceed by far.
    """

    sets: int
    mean: float
    bare: int
    carrying: int
    words: int
    universe: int
    with_bits: int


def shape(collection: DataFrame, measure: Jaccard) -> Shape:
    """One pass over a collection. words is 0 unless all tokens lie from 0 to below MAX_UNIVERSE."""
    n = F.col("n").cast("long")
    least, most = F.min(F.array_min("tokens")), F.max(F.array_max("tokens"))
    sets, mean, bare, carrying, entries, least, most = collection.agg(F.count("*"), F.avg(n), F.sum(n * 40), F.sum(n * (n * 8 + 64)), F.sum(measure.midprefix(n)), least, most).first()
    words = bitmap_words(most + 1) if sets and least >= 0 and most < MAX_UNIVERSE else 0
    return Shape(sets, mean or 0.0, bare or 0, carrying or 0, words, (most or 0) + 1, (entries or 0) * (64 + 16 * words))


def bit_columns(words: int, side: int | str = "") -> list[Column]:
    return [F.col(f"bits_{w}_{side}" if side else f"bits_{w}") for w in range(words)]


def bit_sides(collection: DataFrame, seen: Shape) -> tuple[DataFrame, DataFrame]:
    """Probes and indexed sets with their bits; probes are dealt out, the few bytes of the others are broadcast to them."""
    session = collection.sparkSession
    parts = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    bits = [c.alias(f"bits_{w}") for w, c in enumerate(exact_bits(F.col("tokens"), seen.universe))]
    probe = probing(collection).repartition(max(1, min(parts, seen.sets // 64)), "set_id").select("*", *bits)
    index = indexed(collection).select("*", *bits)
    return probe, F.broadcast(index) if seen.sets * (64 + 16 * seen.words) <= MAX_BROADCAST_ENTRIES else index


def numbered(sets: DataFrame, side: int, words: int) -> DataFrame:
    return sets.select(F.col("set_id").alias(f"id{side}"), F.col("n").alias(f"n{side}"), *(c.alias(f"bits_{w}_{side}") for w, c in enumerate(bit_columns(words))))


def size_ranges(measure: Jaccard, n: Column) -> Column:
    """Ranges of sizes in which a probe finds similar sets."""
    return F.sequence(measure.size_range(measure.minsize(n)), measure.size_range(n))


def prefix_join(collection: DataFrame, measure: Jaccard, positional: bool, keep: tuple[str, ...] = (), size: int | None = None, both_ways: bool = False, seen: Shape | None = None) -> DataFrame:
    """Pairs of prefix entries with a common token that pass the length, order and, if asked for, position filters.

    Columns id1, n1, pos1, id2, n2, pos2, token and the columns in keep, numbered alike. The
    length filter is part of the join key: indexed sets are keyed by token and range of
    sizes, probes look in the ranges their bounds allow, two at most for thresholds of 1/2
    and more. A frequent token's list is so cut into parts that could not match anyway.
    size bounds the entries' bytes; too many for a broadcast are merged, which spills and splits skew.
    both_ways: sets of one size meet in both directions. With seen, of a collection whose sets are
    bits, only entries at the first token that two sets share are paired, and the bits are kept.
    """
    if size is None:
        size = seen.with_bits if seen else shape(collection, measure).bare
    words = seen.words if seen else 0
    probes, sets = bit_sides(collection, seen) if words else (probing(collection), indexed(collection))
    keep = (*keep, *(f"bits_{w}" for w in range(words)))
    name = lambda c, k: f"{c}_{k}" if c.startswith("bits_") else f"{c}{k}"
    # lists are ordered by (n, id); ranges replace the scan that skips short sets and stops at long ones
    index = prefix_entries(sets, measure, "index", keep)
    index = index.select("token", measure.size_range(F.col("n")).alias("sizes"), *(F.col(c).alias(name(a, 2)) for c, a in [("set_id", "id"), ("n", "n"), ("pos", "pos"), *((k, k) for k in keep)]))
    probe = prefix_entries(probes, measure, "probe", keep)
    probe = probe.select("token", F.explode(size_ranges(measure, F.col("n"))).alias("sizes"), *(F.col(c).alias(name(a, 1)) for c, a in [("set_id", "id"), ("n", "n"), ("pos", "pos"), *((k, k) for k in keep)]))
    n1, n2, id1, id2 = (F.col(c) for c in ("n1", "n2", "id1", "id2"))
    order = (n1 > n2) | ((n1 == n2) & (id1 != id2)) if both_ways else probe_first(n1, id1, n2, id2)
    condition = order & length_filter(measure, n1, n2)
    if positional:
        condition &= measure.position_filter(n1, n2, F.col("pos1"), F.col("pos2"))
    if words:
        probe = probe.select("*", *(bits_below(c, w, F.col("token")).alias(f"below_{w}") for w, c in enumerate(bit_columns(words, 1))))
        for w, c in enumerate(bit_columns(words, 2)):
            condition &= F.col(f"below_{w}").bitwiseAND(c) == 0
    if size > MAX_BROADCAST_ENTRIES:
        index = index.hint("merge")
    elif words:
        index = F.broadcast(index)
    return probe.join(index, ["token", "sizes"]).where(condition)


def class_candidates(collection: DataFrame, measure: Jaccard, positional: bool = False) -> DataFrame:
    """Distinct pairs whose prefixes meet, those of one size in each direction that they meet in."""
    seen = shape(collection, measure)
    if seen.words:
        return prefix_join(collection, measure, positional, both_ways=True, seen=seen).select("id1", "id2")
    return prefix_join(collection, measure, positional, size=seen.bare, both_ways=True).select("id1", "id2").distinct()


def prefix_candidates(collection: DataFrame, measure: Jaccard, positional: bool = False) -> DataFrame:
    """Distinct candidate pairs (id1, id2). Equal sets have equal candidates, and are candidates of each other."""
    if classes.has_copies(collection):
        equal = classes.of(collection)
        return classes.expanded(class_candidates(classes.sets(equal), measure, positional), equal, directed=True).unionByName(classes.within(equal))
    seen = shape(collection, measure)
    if seen.words:
        return prefix_join(collection, measure, positional, seen=seen).select("id1", "id2")
    return prefix_join(collection, measure, positional, size=seen.bare).select("id1", "id2").distinct()


def candidate_overlaps(collection: DataFrame, measure: Jaccard, positional: bool = False) -> DataFrame:
    """Candidate pairs with the number of tokens that their prefixes share: id1, id2, overlap."""
    copies = classes.has_copies(collection)
    equal = classes.of(collection) if copies else collection
    seen = shape(equal, measure)
    sets = equal.select("set_id", "tokens", "n")
    probe, index = measure.maxprefix(F.col("n")), measure.midprefix(F.col("n"))
    if seen.words and not positional:
        pre = lambda length: exact_bits(F.slice("tokens", F.lit(1), length.cast("int")), seen.universe)
        kept = [(f"{side}_{w}_", c) for side, length in (("probe", probe), ("index", index)) for w, c in enumerate(pre(length))]
        met = prefix_join(sets.select("*", *(c.alias(k) for k, c in kept)), measure, False, tuple(k for k, _ in kept), both_ways=copies, seen=seen)
        shared = shared_bits([F.col(f"probe_{w}_1") for w in range(seen.words)], [F.col(f"index_{w}_2") for w in range(seen.words)])
        found = met.select("id1", "id2", shared.alias("overlap"))
    else:
        found = prefix_join(sets, measure, positional, size=seen.bare, both_ways=copies).groupBy("id1", "id2").agg(F.count("*").alias("overlap"))
    if not copies:
        return found
    own = F.least(probe, index)
    if positional:  # equal sets share tokens at equal places
        own = F.least(own, F.col("n").cast("long") - measure.minoverlap(F.col("n"), F.col("n")) + 1)
    return classes.expanded(found, equal, directed=True).unionByName(classes.within(equal, overlap=own))


def prefix_filtered(collection: DataFrame, measure: Jaccard, positional: bool, carry: bool | None = None, bits: int = 0, keep: tuple[str, ...] = (), condition: Column | None = None) -> DataFrame:
    """The prefix-filter join. With bits, signatures of that size drop candidates before they are verified.

    condition is a further filter on pairs of entries, over the columns in keep, numbered 1
    for the probe's and 2 for the indexed set's.

    Small sets travel with their prefix entries: a pair is verified where its entries meet,
    at the first token their prefixes share, so one shuffle does all and no pair is made
    twice. Large sets would be copied once per prefix token; they are joined in cells, and
    with a condition or carry=False, their candidates are made distinct and the sets joined to them.
    """
    seen = shape(collection, measure)
    if carry is None:
        carry = seen.mean <= CARRY_SIZE or seen.words > 0
        if not carry and condition is None:
            return cells.cell_join(collection, measure, cells.Method(positional=positional, bits=bits))
    if bits:
        collection = stage(collection.withColumn("signature", signature(F.col("tokens"), bits)), "signed")
        keep = (*keep, "signature")
    n1, n2 = F.col("n1"), F.col("n2")
    as_bits = carry and seen.words > 0
    if as_bits:
        found = prefix_join(collection, measure, positional, keep, seen=seen)
    else:
        found = prefix_join(collection, measure, positional, ("tokens", *keep) if carry else keep, seen.carrying if carry else seen.bare)
    if condition is not None:
        found = found.where(condition)
    if bits:
        found = found.where(bitmap_filter(measure, n1, n2, F.col("signature1"), F.col("signature2"), bits))
    if not carry:
        return verify(found.select("id1", "id2").distinct(), collection, measure)
    if as_bits:
        return found.where(shared_bits(bit_columns(seen.words, 1), bit_columns(seen.words, 2)) >= measure.minoverlap(n1, n2)).select("id1", "id2")
    t1, t2 = F.col("tokens1"), F.col("tokens2")
    head1, head2 = (F.slice(t, F.lit(1), F.greatest(F.lit(1), p)) for t, p in ((t1, F.col("pos1") + 1), (t2, F.col("pos2") + 1)))
    first_shared = F.size(F.array_intersect(head1, head2)) == 1
    return found.where(first_shared & (overlap(t1, t2) >= measure.minoverlap(n1, n2))).select("id1", "id2")


def large(collection: DataFrame, measure: Jaccard) -> bool:
    """Whether sets are too large to travel with entries or candidates."""
    seen = shape(collection, measure)
    return seen.mean > CARRY_SIZE and not seen.words


def allpairs(collection: DataFrame, measure: Jaccard, carry: bool | None = None) -> DataFrame:
    return prefix_filtered(collection, measure, False, carry)


def ppjoin(collection: DataFrame, measure: Jaccard, carry: bool | None = None, bits: int = 0) -> DataFrame:
    return prefix_filtered(collection, measure, True, carry, bits)


def hybrid(collection: DataFrame, measure: Jaccard, positional: bool, entries: int = 1 << 20) -> DataFrame:
    """Filtering and verification as separate stages, with candidate lists of bounded length between them.

    Between large sets the lists are a cell's, which verifies each and lets it go.
    """
    if large(collection, measure):
        return cells.cell_join(collection, measure, cells.Method(positional=positional, entries=entries))
    lists = stage(candidate_lists(prefix_candidates(collection, measure, positional), entries), "candidate-lists")
    return verify_lists(lists, collection, measure)


def block_keys(blocked: DataFrame, measure: Jaccard) -> DataFrame:
    """Surviving block pairs; as many rows as blocks have neighbours in size."""
    return stage(surviving_block_pairs(stage(block_summary(blocked), "blocks"), measure), "block-pairs")


def prefix_blocked(collection: DataFrame, measure: Jaccard, block_size: int = 10_000) -> DataFrame:
    """The prefix join within surviving pairs of blocks.

    The blocks that survive with a probe's block are one run, so entries meet by token and
    range of sizes, once for each, and a pair stays if its indexed block lies in the run.
    """
    blocked = stage(with_blocks(collection, block_size), "blocked")
    runs = stage(surviving_block_runs(stage(block_summary(blocked), "blocks"), measure), "block-runs")
    with_run = blocked.join(runs.withColumnRenamed("probe_block", "block_id"), "block_id")
    in_run = F.col("block_id2").between(F.col("first1"), F.col("block_id1"))
    return prefix_filtered(with_run, measure, False, keep=("block_id", "first"), condition=in_run)


def bitmap_candidates(collection: DataFrame, measure: Jaccard, bits: int = 64, block_size: int = 10_000) -> DataFrame:
    """All pairs that pass the length and signature filters, compared within surviving block pairs.

    The work is the number of such pairs, quadratic in a range of sizes: for collections of
    a bounded number of sets. Joins of large ones should filter prefixes first (ppjoin with bits).
    """
    signed = stage(with_blocks(collection, block_size).withColumn("signature", signature(F.col("tokens"), bits)), "signed")
    pairs = block_keys(signed, measure)
    one = probing(signed).select(F.col("block_id").alias("probe_block"), F.col("set_id").alias("id1"), F.col("n").alias("n1"), F.col("signature").alias("b1"))
    two = indexed(signed).select(F.col("block_id").alias("index_block"), F.col("set_id").alias("id2"), F.col("n").alias("n2"), F.col("signature").alias("b2"))
    n1, n2 = F.col("n1"), F.col("n2")
    met = one.join(pairs, "probe_block").join(two, "index_block").where(probe_first(n1, F.col("id1"), n2, F.col("id2")) & length_filter(measure, n1, n2))
    return met.where(bitmap_filter(measure, n1, n2, F.col("b1"), F.col("b2"), bits)).select("id1", "id2")


def bitmap(collection: DataFrame, measure: Jaccard, bits: int = 64, block_size: int = 10_000) -> DataFrame:
    """All pairs of a range of sizes by signatures, verified; between large sets in cells, which are the blocks then."""
    if large(collection, measure):
        return cells.cell_join(collection, measure, cells.Method(prefixes=False, bits=bits))
    return verify(bitmap_candidates(collection, measure, bits, block_size), collection, measure)


def count_by_classes(collection: DataFrame, join, measure: Jaccard) -> DataFrame:
    """The number of similar pairs, n_pairs, without expanding equal sets into pairs.

    Equal sets become one with a multiplicity; pairs of different sets count the product of
    theirs, and equal sets are similar to each other. `join` is any strategy.
    """
    equal = collection.groupBy("tokens", "n").agg(F.min("set_id").alias("set_id"), F.count("*").alias("copies"))
    equal = stage(equal, "classes")
    pairs = join(equal.select("set_id", "tokens", "n"), measure)
    many = equal.select("set_id", "copies")
    if equal.count() * 64 <= classes.MAX_BROADCAST_MEMBERS:
        many = F.broadcast(many)
    across = pairs.join(many.toDF("id1", "c1"), "id1").join(many.toDF("id2", "c2"), "id2").select((F.col("c1") * F.col("c2")).alias("k"))
    within = equal.select((F.col("copies") * (F.col("copies") - 1) / 2).cast("long").alias("k"))
    return across.union(within).agg(F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("n_pairs"))
