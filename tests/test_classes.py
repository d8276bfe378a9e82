"""Joins with copies are made between classes, and give the pairs of all sets."""

import random

import pytest
from pyspark.sql import functions as F

from setsim.functions.similarity import Jaccard
from setsim.operators import classes, joins
from setsim.plans import strategies

from .test_joins import collection, pairs, plain


def with_copies(many_tokens):
    rng = random.Random(3)
    kinds = [frozenset(rng.sample(range(30), rng.randint(8, 14))) for _ in range(12)]
    kinds += [k ^ {rng.randrange(30)} for k in kinds]
    sets = {7 * i % 101: set(kinds[i % len(kinds)]) for i in range(80)}
    return sets | ({1000 + k: set(range(300 + 9 * k, 309 + 9 * k)) for k in range(32)} if many_tokens else {})


@pytest.fixture(scope="module", params=[False, True], ids=["bits", "arrays"])
def made(spark, request):
    sets = with_copies(request.param)
    found = collection(spark, sets)
    assert (joins.shape(found, Jaccard(0.8)).words == 0) == request.param
    return found, sets


def reached(sets, t, positional):
    """Candidates by the definition: prefixes share a token, and it suffices for the overlap if asked for."""
    import math
    from collections import Counter

    freq = Counter(x for s in sets.values() for x in s)
    lists = {i: sorted(s, key=lambda x: (freq[x], x)) for i, s in sets.items()}
    out = Counter()
    for i, a in lists.items():
        for j, b in lists.items():
            n1, n2 = len(a), len(b)
            if (n1, i) <= (n2, j) or n2 < math.ceil(t * n1):
                continue
            need = min(n1, n2, math.ceil((n1 + n2) * t / (1 + t)))
            probe, index = n1 - math.ceil(t * n1) + 1, n2 - min(n2, math.ceil(2 * n2 * t / (1 + t))) + 1
            out[i, j] += sum(not positional or need <= min(n1 - p, n2 - b.index(x)) for p, x in enumerate(a[:probe]) if x in b[:index])
    return {k: c for k, c in out.items() if c}


def test_joins_of_copies(made):
    found, sets = made
    exact = plain(sets, 0.8)
    assert pairs(strategies.similarity_join(found, 0.8, "ppjoin")) == exact
    assert pairs(strategies.similarity_join(found, 0.8, "naive")) == exact
    assert strategies.run(found, 0.8, "dichotomy", split=50, policy="ppjoin,allpairs", block_size=20) == len(exact)


@pytest.mark.parametrize("positional", [False, True])
def test_candidates_of_copies(made, positional):
    found, sets = made
    want = reached(sets, 0.8, positional)
    assert pairs(joins.prefix_candidates(found, Jaccard(0.8), positional)) == set(want)
    assert {(r.id1, r.id2): r.overlap for r in joins.candidate_overlaps(found, Jaccard(0.8), positional).collect()} == want


def test_composed_joins_get_one_set_of_a_class(made, monkeypatch):
    found, sets = made
    seen = []
    join = joins.ppjoin
    monkeypatch.setattr(joins, "ppjoin", lambda c, m, *a, **k: (seen.append(c.count()), join(c, m, *a, **k))[1])
    assert pairs(strategies.even_partitioned(found, 0.8, 1, 9)) == plain(sets, 0.8)
    assert seen == [len({frozenset(s) for s in sets.values()})]


def test_large_classes_are_cut(spark):
    sets = {k: {1, 2, 3} for k in range(23)} | {100 + k: {1, 2, 3, 4} for k in range(4)}
    equal = classes.of(collection(spark, sets), 5)
    assert equal.agg(F.max(F.size("members"))).first()[0] == 5 and equal.count() == 6
    found = classes.expanded(joins.ppjoin(classes.sets(equal), Jaccard(0.7)), equal).unionByName(classes.within(equal))
    assert pairs(found) == plain(sets, 0.7)
    found = classes.expanded(joins.class_candidates(classes.sets(equal), Jaccard(0.7)), equal, directed=True).unionByName(classes.within(equal))
    assert pairs(found) == set(reached(sets, 0.7, False))


def test_bits_at_the_ends_of_words(spark):
    sets = {k: set(range(k, 130)) for k in (0, 1, 62, 63, 64, 65, 127, 128)}
    found = collection(spark, sets)
    assert joins.shape(found, Jaccard(0.5)).words == 3
    for t in (0.5, 0.9):
        assert pairs(joins.ppjoin(found, Jaccard(t))) == plain(sets, t) == pairs(joins.naive(found, Jaccard(t)))
