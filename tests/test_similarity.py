"""Bounds at table values, among them float edges where exact arithmetic would differ."""

import math

import pytest
from pyspark.sql import functions as F

from setsim.functions import bitmaps, options
from setsim.functions.similarity import Jaccard
from setsim.plans.stages import Timer
from setsim.plans.strategies import measure_of, strategy


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(("t", "a", "b", "expected"), [(0.9, 19, 19, 19), (0.8, 32, 31, 29), (0.65, 50, 49, 40), (0.2, 3, 3, 2), (0.5, 4, 4, 3), (0.9, 1, 5, 1), (1.0, 7, 7, 7)])
def test_minoverlap(spark, t, a, b, expected):
    assert value(spark, Jaccard(t).minoverlap(a, b)) == expected


@pytest.mark.parametrize(("t", "n", "expected"), [(0.55, 100, 56), (0.9, 10, 9), (0.5, 5, 3), (1.0, 4, 4), (0.2, 1, 1)])
def test_minsize(spark, t, n, expected):
    assert value(spark, Jaccard(t).minsize(n)) == expected


def test_bounds_match_plain_arithmetic(spark):
    for t in (0.2, 0.5, 0.55, 0.65, 0.8, 0.9, 0.95, 1.0):
        m, n = Jaccard(t), F.col("id")
        cols = [m.minsize(n), m.maxsize(n), m.positional_maxsize(n, F.lit(2)), m.minoverlap(n, n), m.maxprefix(n), m.midprefix(n)]
        for r in spark.range(1, 120).select("id", *(c.alias(f"c{k}") for k, c in enumerate(cols))).collect():
            x = float(r.id)
            low, over = math.ceil(t * x), min(r.id, math.ceil((x + x) * t / (1 + t)))
            assert list(r)[1:] == [low, math.floor(x / t), math.floor((x - ((1 - 1e-10) + t) * 2.0) / t), over, min(r.id, r.id - low + 1), min(r.id, r.id - over + 1)]


def test_sizes_in_adjacent_ranges(spark):
    """Every size that can be similar lies in one of the ranges that a probe looks in."""
    for t in (0.2, 0.5, 0.8, 0.95, 1.0):
        m = Jaccard(t)
        probe = spark.range(1, 80).select(F.col("id").alias("n1"))
        index = spark.range(1, 80).select(F.col("id").alias("n2"))
        lo, hi, at = m.size_range(m.minsize(F.col("n1"))), m.size_range(F.col("n1")), m.size_range(F.col("n2"))
        missed = probe.crossJoin(index).where((F.col("n2") <= F.col("n1")) & m.long_enough(F.col("n1"), F.col("n2")) & ((at < lo) | (at > hi)))
        assert missed.count() == 0


def test_position_filter(spark):
    m = Jaccard(0.8)
    assert value(spark, m.position_filter(10, 10, 0, 0))
    assert not value(spark, m.position_filter(10, 10, 2, 0))


def test_thresholds_and_names_are_checked():
    for t in (0.0, -1.0, 1.1):
        with pytest.raises(ValueError):
            Jaccard(t)
    with pytest.raises(ValueError):
        strategy("all-pairs")
    with pytest.raises(ValueError):
        measure_of(0.5, "cosine")


def test_signatures(spark):
    assert [bitmaps.bitmap_words(b) for b in (1, 64, 65, 128)] == [1, 1, 2, 2]
    rows = [(1, [0, 1, 64]), (2, [1]), (3, [63, 127, 5, 69])]
    sets = spark.createDataFrame(rows, "id long, tokens array<long>").withColumn("b", bitmaps.signature(F.col("tokens"), 64))
    for r in sets.collect():
        bits = 0
        for t in r.tokens:
            bits ^= 1 << t % 64
        assert r.b[0] % 2**64 == bits
    two = sets.select("id", bitmaps.signature(F.col("tokens"), 128).alias("b"))
    got = {(r[0], r[1]): r[2] for r in two.toDF("i", "a").crossJoin(two.toDF("j", "c")).select("i", "j", bitmaps.hamming(F.col("a"), F.col("c"), 128)).collect()}
    assert got[1, 2] == 2 and got[3, 3] == 0 and got[1, 3] == 7


def test_options():
    assert options.memory_entries("512M") == 128_000_000 and options.memory_entries("2g") == 500_000_000
    assert options.policy("ppjoin, allpairs") == ["ppjoin", "allpairs"]
    for bad in ("512", "M", "12K", ""):
        with pytest.raises(ValueError):
            options.memory_entries(bad)
    with pytest.raises(ValueError):
        options.policy("ppjoin")


def test_timer_adds_up():
    timer = Timer()
    for _ in range(2):
        with timer.interval("a"):
            pass
    assert set(timer.seconds) == {"a"} and timer.total == timer.seconds["a"] and "total" in timer.report()
