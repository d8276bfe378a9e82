"""All strategies against a plain join, filters that lose nothing, and the awkward collections."""

import math
import random

import pytest
from pyspark.sql import functions as F

from setsim.functions.similarity import Jaccard
from setsim.operators import cost, filters, index, joins, partitions, ranking, statistics, verify
from setsim.plans import strategies
from setsim.sources import collections, sinks

SCHEMA = "id long, token long"


def plain(sets, t):
    """The pairs by the definition, in the order of operations that the bounds fix."""
    items = sorted(((len(s), i) for i, s in sets.items() if s), reverse=True)
    out = set()
    for k, (n1, i1) in enumerate(items):
        for n2, i2 in items[k + 1 :]:
            need = min(n1, n2, math.ceil((float(n1) + float(n2)) * t / (1.0 + t)))
            if n2 >= math.ceil(t * n1) and len(sets[i1] & sets[i2]) >= need:
                out.add((i1, i2))
    return out


def random_sets(seed, n=60, universe=25, most=14):
    rng = random.Random(seed)
    sets = {k: set(rng.sample(range(universe), rng.randint(1, most))) for k in range(n)}
    for k in range(0, n, 3):  # near copies and copies
        sets[n + k] = set(sets[k]) ^ set(rng.sample(range(universe), rng.randint(0, 2)))
    return {k: s for k, s in sets.items() if s}


def collection(spark, sets):
    rows = [(i, t) for i, s in sets.items() for t in s]
    return collections.from_rows(spark.createDataFrame(rows + rows[:5], SCHEMA).repartition(3))


def pairs(df):
    rows = [(r.id1, r.id2) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def sets():
    return random_sets(1)


@pytest.fixture(scope="module")
def coll(spark, sets):
    return collection(spark, sets)


OPTIONS = {"block_size": 13, "bits": 64, "entries": 5}


@pytest.mark.parametrize("t", [0.2, 0.5, 0.8, 0.9])
@pytest.mark.parametrize("name", list(strategies.strategies()))
def test_strategies_agree(coll, sets, name, t):
    assert pairs(strategies.similarity_join(coll, t, name, **OPTIONS)) == plain(sets, t)


@pytest.mark.parametrize("t", [0.55, 0.65, 0.95, 1.0])
def test_float_edges(spark, t):
    edge = random_sets(int(t * 100), 40, 60, 40)
    found = collection(spark, edge)
    for carry in (True, False):
        assert pairs(joins.ppjoin(found, Jaccard(t), carry)) == plain(edge, t)


@pytest.mark.parametrize("name", ["naive", "ppjoin", "bitmap"])
def test_counts_do_not_expand_copies(spark, name):
    copies = {k: {1, 2, 3} for k in range(30)} | {100 + k: {1, 2, 3, 4} for k in range(5)}
    for t in (0.7, 0.9):
        assert strategies.similarity_join_count(collection(spark, copies), t, name).first()["n_pairs"] == len(plain(copies, t))


def test_hand_made_edges(spark):
    same19 = set(range(1000, 1018))
    made = {1: {0}, 2: {0, 1, 2, 3, 4}, 3: {10, 11}, 4: {10, 11}, 5: same19 | {1}, 6: same19 | {2}, 7: set(range(2000, 2032)), 8: set(range(2000, 2028)) | {5, 6, 7}, 9: {20, 21, 22}, 10: {22, 23, 24}}
    found = collection(spark, made)
    assert pairs(joins.ppjoin(found, Jaccard(0.9))) == {(4, 3)}
    assert (8, 7) not in pairs(joins.ppjoin(found, Jaccard(0.8))) and (7, 8) not in pairs(joins.ppjoin(found, Jaccard(0.8)))
    assert (10, 9) not in pairs(joins.ppjoin(found, Jaccard(0.2)))


def test_filters_lose_no_pair(coll, sets):
    for t in (0.5, 0.8, 0.95):
        m, exact = Jaccard(t), plain(sets, t)
        every = pairs(joins.prefix_candidates(coll, m))
        placed = pairs(joins.prefix_candidates(coll, m, True))
        assert exact <= placed <= every
        assert exact <= pairs(joins.bitmap_candidates(coll, m, 64, 10))


def test_relabelling_changes_nothing(spark, sets):
    other = {1000 - i: {997 - 7 * t for t in s} for i, s in sets.items()}
    unordered = lambda found: {frozenset(p) for p in found}
    found = unordered(pairs(joins.ppjoin(collection(spark, other), Jaccard(0.8))))
    assert {frozenset(1000 - i for i in p) for p in found} == unordered(plain(sets, 0.8))


def test_empty_and_null_rows(spark):
    none = collections.from_rows(spark.createDataFrame([(None, 1), (1, None)], SCHEMA))
    assert none.count() == 0
    for name in strategies.strategies():
        assert strategies.similarity_join(none, 0.8, name).count() == 0
    assert strategies.similarity_join_count(none, 0.8).first()["n_pairs"] == 0


def test_partitioned_joins(coll, sets):
    exact = plain(sets, 0.8)
    for parts in (1, 3, 7):
        assert pairs(strategies.sqrt_partitioned(coll, 0.8, parts)) == exact
        assert pairs(strategies.even_partitioned(coll, 0.8, parts, 9)) == exact
    for split in (0, 30, 100):
        assert pairs(strategies.dichotomy(coll, 0.8, split, "naive,ppjoin", 9)) == exact


def test_partition_shapes(spark):
    assert partitions.square_root_cuts(100, 4) == [50, 70, 86, 100]
    ids = spark.range(10).select(partitions.even(F.col("id"), 10, 4).alias("e"), partitions.dichotomy(F.col("id"), 10, 25).alias("d"), partitions.square_root(F.col("id"), 10, 2).alias("s")).collect()
    assert [r.e for r in ids] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert [r.d for r in ids] == [True] * 3 + [False] * 7
    assert [r.s for r in ids] == [0] * 7 + [1] * 3


def test_block_pairs(coll):
    m = Jaccard(0.8)
    blocked = partitions.with_blocks(coll, 7)
    summary = filters.block_summary(blocked)
    got = {(r.probe_block, r.index_block) for r in filters.surviving_block_pairs(summary, m).collect()}
    blocks = {r.block_id: r for r in summary.collect()}
    assert got == {(p, i) for p in blocks for i in blocks if p >= i and blocks[i].max_n >= math.ceil(0.8 * blocks[p].min_n)}


def test_candidate_lists_are_bounded_and_whole(coll):
    found = joins.prefix_candidates(coll, Jaccard(0.2))
    lists = verify.candidate_lists(found, 3).collect()
    assert {(r.id1, c) for r in lists for c in r.candidates} == pairs(found)
    assert max(len(r.candidates) for r in lists) < 20


@pytest.mark.parametrize("most", [1000, 10])
def test_ranking(spark, most):
    df = spark.range(500).select((F.col("id") * 7919 % 1009).alias("v")).repartition(5)
    got = ranking.ranked(df, ["v"], "k", most).collect()
    assert {r.v: r.k for r in got} == {v: k for k, v in enumerate(sorted(k * 7919 % 1009 for k in range(500)))}


def test_text_files(spark, tmp_path):
    lines = ["1 2 3", "", "  ", "7  8", "2 1 3 3", "0"]
    (tmp_path / "sets.txt").write_text("\n".join(lines) + "\n")
    got = {r.set_id: list(r.tokens) for r in collections.read_lines(spark, f"file://{tmp_path}/sets.txt").collect()}
    assert got == {0: [1, 2, 3], 1: [7, 8], 2: [2, 1, 3, 3], 3: [0]}
    sets = collections.from_text(spark, f"file://{tmp_path}/sets.txt")
    assert pairs(joins.ppjoin(sets, Jaccard(0.9))) == {(2, 0)}
    n = strategies.run(sets, 0.9, output=f"file://{tmp_path}/out")
    assert n == 1 and pairs(sinks.read_pairs(spark, f"file://{tmp_path}/out")) == {(2, 0)}
    assert strategies.run(sets, 0.9) == 1
    assert sinks.count_pairs(joins.ppjoin(sets, Jaccard(0.9))).first()["n_pairs"] == 1


def test_malformed_fields(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("1 x 12abc\n")
    path = f"file://{tmp_path}/bad.txt"
    assert [list(r.tokens) for r in collections.read_lines(spark, path, "lenient").collect()] == [[1, 0, 12]]
    before = spark.conf.get("spark.sql.ansi.enabled")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            with pytest.raises(Exception, match="no whole number: x"):
                collections.read_lines(spark, path).collect()
        finally:
            spark.conf.set("spark.sql.ansi.enabled", before)
    with pytest.raises(ValueError):
        collections.read_lines(spark, path, "other")


@pytest.mark.parametrize("name", list(strategies.strategies()))
def test_sides_of_a_join(coll, sets, name):
    sided = coll.select("set_id", "tokens", "n", (F.col("set_id") % 3 != 0).alias("probing"), (F.col("set_id") % 2 == 0).alias("indexed"))
    got = pairs(strategies.strategy(name, block_size=7)(sided, Jaccard(0.5)))
    assert got == {(a, b) for a, b in plain(sets, 0.5) if a % 3 and b % 2 == 0}


def test_programs_by_name(coll, sets, tmp_path):
    exact = plain(sets, 0.8)
    table = {t: {"Intercept": float(k)} for k, t in enumerate(("prefix", "hybrid", "cpu"))}
    options = {"sqrt_partitioned": {"parts": 3}, "even_partitioned": {"parts": 2, "block_size": 9}, "dichotomy": {"split": 30, "block_size": 9}, "block_pair_queue": {"block_size": 9}, "cost_based": {"coefficients": table, "parts": 2}}
    assert set(options) == set(strategies.COMPOSED)
    for name, given in options.items():
        assert strategies.run(coll, 0.8, name, **given) == len(exact)
    assert strategies.run(coll, 0.8, "dichotomy", f"file://{tmp_path}/out", split=60, block_size=5) == len(exact)
    assert pairs(sinks.read_pairs(coll.sparkSession, f"file://{tmp_path}/out")) == exact
    with pytest.raises(ValueError):
        strategies.similarity_join(coll, 0.8, measure="other")


def test_candidate_overlaps_and_block_index(coll, sets):
    m = Jaccard(0.5)
    counted = {(r.id1, r.id2): r.overlap for r in joins.candidate_overlaps(coll, m).collect()}
    assert set(counted) == pairs(joins.prefix_candidates(coll, m)) and min(counted.values()) >= 1
    blocked = partitions.with_blocks(coll, 7)
    rows = filters.block_summary(blocked, m).collect()
    for r in rows:
        listed = index.block_postings(blocked, m, r.block_id).count()
        assert r.entries == listed and r.avg_set_size == pytest.approx(r.n_tokens / r.n_sets)
    assert filters.largest_block(filters.block_summary(blocked, m)).first()["max_entries"] == max(r.entries for r in rows)


def test_ties_of_the_cost_model(spark):
    row = spark.createDataFrame([(0, 0, 1.0, 1.0, 1.0, 1, 1, 1)], "left int, right int, set_size_std double, avg_set_size double, token_freq double, dataset_size long, universe_size long, index_size long")
    tied = {t: {"Intercept": 1.0} for t in cost.TECHNIQUES}
    for gone, wanted in ((set(), "bitmap"), ({"bitmap"}, "cpu"), ({"bitmap", "cpu"}, "prefix")):
        assert cost.choose(row, {t: c for t, c in tied.items() if t not in gone}, 64).first()["technique"] == wanted


def test_statistics(coll, sets):
    m = Jaccard(0.5)
    one = statistics.partition_features(coll.withColumn("part", F.lit(0)), m, 30).first()
    sizes = [len(s) for s in sets.values()]
    mean = sum(sizes) / len(sizes)
    assert one.dataset_size == len(sizes) and one.avg_set_size == pytest.approx(mean)
    assert one.set_size_std == pytest.approx(math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)))
    freq = {r.token: r.freq for r in index.prefix_histogram(coll, m).collect()}
    per_token = [freq.get(k, 0) for k in range(30)]
    centre = sum(per_token) / 30
    assert one.index_size == sum(per_token) and one.token_freq == pytest.approx(math.sqrt(sum((f - centre) ** 2 for f in per_token) / 30))
    moments = statistics.size_moments(coll).first()
    assert moments.kurt == pytest.approx(sum((s - mean) ** 4 for s in sizes) / len(sizes) / moments.variance_n**2)
    offsets = index.index_offsets(coll, m, 30).orderBy("token").collect()
    at = 0
    for r in offsets:
        assert (r["first"], r["last"]) == (at, at + freq[r.token])
        at = r["last"]


COEFFICIENTS = '{"cpu": {"0.8": {"Intercept": 5, "dataset_size_square": 1e-3}}, "hybrid": {"0.8": {"Intercept": -8}}, "bitmap": {"0.8": {"bitmap": 0.001}}}'


def test_cost_model(spark, coll, sets, tmp_path):
    table = cost.coefficients_of(COEFFICIENTS, 0.8)
    parted = coll.withColumn("part", F.pmod("set_id", F.lit(2)).cast("int"))
    features = statistics.pair_features(parted, Jaccard(0.8), 30)
    assert {r.technique for r in cost.choose(features, table, 64).collect()} == {"bitmap"}
    runs = {(r.left, r.right): (r.technique, r.cost) for r in cost.choose(features, table).collect()}
    for r in features.collect():
        costs = {"cpu": 5 + 1e-3 * r.dataset_size**2, "hybrid": 8.0}
        best = min(costs, key=lambda k: (costs[k], k))
        assert runs[r.left, r.right][0] == best and runs[r.left, r.right][1] == pytest.approx(costs[best])
    assert cost.indexed_partitions(cost.choose(features, table)).count() == 2
    (tmp_path / "c.json").write_text(COEFFICIENTS)
    assert cost.read_coefficients(spark, f"file://{tmp_path}/c.json", 0.8) == table
    assert set(cost.coefficients_of('{"host": {"0.8": {}}}', 0.8, {"host": "cpu"})) == {"cpu"}
    for bad in ('{"gpu": {"0.8": {}}}', '{"cpu": {"0.9": {}}}'):
        with pytest.raises(ValueError):
            cost.coefficients_of(bad, 0.8)
    assert pairs(strategies.cost_based(coll, 0.8, table, 3)) == plain(sets, 0.8)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id1", "id2"]
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names


def test_token_order_does_not_matter(spark, sets):
    words = spark.createDataFrame([(i, [f"t{t:03}" for t in s]) for i, s in sets.items()], "id long, tokens array<string>")
    assert pairs(joins.allpairs(collections.from_arrays(words), Jaccard(0.8))) == plain(sets, 0.8)
    texts = spark.createDataFrame([(i, "; ".join(f"T{t:03}" for t in s)) for i, s in sets.items()], "id long, text string")
    assert pairs(joins.allpairs(collections.from_words(texts, "id", "text"), Jaccard(0.8))) == plain(sets, 0.8)
