"""Joins of large sets in cells, against a plain join."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from setsim.functions.similarity import Jaccard
from setsim.operators import cells, joins
from setsim.plans import strategies
from setsim.plans.stages import stage_dir
from setsim.sources import collections

from .test_joins import collection, pairs, plain


def large_sets(seed, n=70):
    """Sets of 40 to 200 of 2,000 tokens, a third of them near copies of others, and several of one size."""
    rng = random.Random(seed)
    sets = {k: set(rng.sample(range(2000), rng.choice([40, 60, 60, 60, rng.randint(50, 200)]))) for k in range(n)}
    for k in range(0, n, 3):
        sets[n + k] = set(sets[k]) ^ set(rng.sample(range(2000), rng.randint(0, 40)))
    return sets


@pytest.fixture(scope="module")
def sets():
    return large_sets(1)


@pytest.fixture(scope="module")
def coll(spark, sets):
    return collection(spark, sets)


@pytest.fixture
def small_chunks(monkeypatch):
    for name, value in {"CHUNK_TOKENS": 700, "CHUNK_SETS": 9, "ROUND_BYTES": 3000}.items():
        monkeypatch.setattr(cells, name, value)


OPTIONS = {"block_size": 13, "bits": 64, "entries": 2}


def check_in_cells(coll, sets, monkeypatch, name, t):
    """The pairs are right and none of large sets is made outside a cell, where candidates are shuffled."""
    for shuffled in ("prefix_join", "verify", "bitmap_candidates", "verify_lists"):
        monkeypatch.setattr(joins, shuffled, lambda *args, **options: pytest.fail("candidates of large sets are shuffled"))
    assert pairs(strategies.similarity_join(coll, t, name, **OPTIONS)) == plain(sets, t)


@pytest.mark.parametrize("t", [0.5, 0.65, 0.8])
@pytest.mark.parametrize("name", ["allpairs", "ppjoin", "ppjoin_bitmap"])
def test_prefix_joins_in_cells(coll, sets, small_chunks, monkeypatch, name, t):
    check_in_cells(coll, sets, monkeypatch, name, t)


def test_cells_of_one_side(coll, sets):
    """Only pairs whose probe probes and whose other set is indexed."""
    sided = coll.withColumn("probing", F.col("set_id") % 2 == 0).withColumn("indexed", F.col("set_id") % 3 > 0)
    assert pairs(joins.ppjoin(sided, Jaccard(0.5))) == {(a, b) for a, b in plain(sets, 0.5) if a % 2 == 0 and b % 3}


def test_no_large_sets(coll):
    assert pairs(cells.cell_join(coll.limit(0), Jaccard(0.5), cells.Method())) == set()


def test_chunks_and_rounds_hold_every_cell_once():
    sizes = [(n, (n * 7) % 40 + 1) for n in range(1, 300)] + [(400, 30_000), (5_000_000, 2)]
    chunks, of = cells.cut(sizes)
    assert [n for n, _, _ in of] == [n for n, _ in sizes]
    assert all(chunks[first + k].least <= n <= chunks[first + k].most for n, first, slices in of for k in range(slices))
    assert dict((n, s) for n, _, s in of)[400] == 4
    for most in (1, 10**9):
        made = [c for r in cells.rounds(chunks, dict.fromkeys(range(len(chunks)), most // 3), 0.5) for c in r]
        assert len(made) == len(set(made))
        assert set(made) == {(p, i) for p in range(len(chunks)) for i in range(p + 1) if chunks[i].most >= np.ceil(0.5 * chunks[p].least)}


def test_packed_sets_come_back():
    n = np.array([2, 1, 3])
    tokens = np.array([5, 2**40, 7, 0, 1, 2**62])
    packed, size = cells.pack(np.array([9, -4, 2**50]), np.array([1, 2, 3]), n, tokens)
    ids, flags, sizes, back = cells.unpack(3, size, packed)
    assert ids.tolist() == [9, -4, 2**50] and flags.tolist() == [1, 2, 3] and sizes.tolist() == n.tolist() and back.tolist() == tokens.tolist()


@pytest.mark.parametrize("shift", [0, 2**40])
@pytest.mark.parametrize("how", [cells.Method(), cells.Method(positional=True, entries=1), cells.Method(prefixes=False, bits=64)])
def test_cells_in_many_small_steps(monkeypatch, how, shift):
    """Few probes, entries and candidates at once, and tokens far beyond the marks."""
    for name, value in {"PROBES": 3, "VISITS": 5, "CANDIDATES": 4}.items():
        monkeypatch.setattr(cells, name, value)
    sets = {k: s for k, s in large_sets(3, 30).items()}
    rows = [(k, np.sort(np.array(list(s)) + shift)) for k, s in sets.items()]
    one = cells.gathered([(1, size, packed) for packed, size in (cells.pack(np.array([k]), np.array([3]), np.array([len(s)]), s) for k, s in rows)])
    found = {(int(one.ids[p]), int(one.ids[x])) for p, c in cells.Cell(one, one, True, 0.5, how).pairs() for x in c}
    assert found == plain(sets, 0.5)


@pytest.mark.parametrize("name", ["hybrid_allpairs", "hybrid_ppjoin"])
def test_hybrid_joins_in_cells(coll, sets, small_chunks, monkeypatch, name):
    monkeypatch.setattr(joins, "prefix_candidates", lambda *args: pytest.fail("candidates of large sets are shuffled"))
    check_in_cells(coll, sets, monkeypatch, name, 0.5)


def test_bitmap_joins_in_cells(coll, sets, small_chunks, monkeypatch):
    check_in_cells(coll, sets, monkeypatch, "bitmap", 0.5)


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_encoding_leaves_no_words(spark, sets, monkeypatch, broadcast):
    """Of the stages by which tokens become ranks, those that are as large as the input are deleted."""
    monkeypatch.setattr(collections, "MAX_BROADCAST_TOKENS", broadcast)
    folder = Path(stage_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    made = collection(spark, sets)
    left = {p.name for p in set(folder.iterdir()) - before}
    assert not [name for name in left if name.startswith(("raw-sets", "numbered", "ranks"))]
    assert {r.set_id: r.n for r in made.collect()} == {k: len(s) for k, s in sets.items()}
