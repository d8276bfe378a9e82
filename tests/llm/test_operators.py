"""Every operator against a plain version of itself on small corpora."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from setsim.llm import components, extract, language_model, licenses, mixing, perplexity, personal_data, phrase_index, quality_rules, simhash, suffix_dedup
from setsim.llm import shared, shards
from setsim.llm import words as w

from .common import SCHEMA, corpus, frame, labels

SPACED = r"[^\x20\x09-\x0D]+"


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def tokens(t, pattern=SPACED):
    return re.findall(pattern, lowered(t))


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3)


def same(got, expected):
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# words


def test_words_of_blocks_match_regex(rows):
    texts = [r[1] for r in rows]
    for kind, pattern in ((w.NOT_SPACE, SPACED), (w.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = {}
        at = 0
        for size in (1, 100, 1 << 18):
            at = 0
            for b in w.blocks(pa.array(texts, pa.string()), size):
                found = w.words(b, kind)
                for k in range(b.n):
                    own = found.hashes[found.first[k] : found.first[k + 1]].tolist()
                    expected = tokens(texts[at + k], pattern)
                    assert len(own) == len(expected)
                    for h, x in zip(own, expected):
                        assert seen.setdefault(x, h) == h
                at += b.n
            assert at == len(texts)
        assert len(set(seen.values())) == len(seen)


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_structured_words_hash_apart():
    one, two = thue_morse(1024)
    (a,), (b,) = w.hash_words([one, two])
    assert a != b
    data = np.random.default_rng(2).integers(97, 99, 5000).astype(np.uint8)
    starts = np.arange(4000)
    for size in (3, 8, 9, 16, 17, 64, 65, 200):
        got = w.bytes_hashes(data, starts, starts + size)
        raw = data.tobytes()
        seen = {}
        assert all(seen.setdefault(raw[s : s + size], h) == h for s, h in zip(starts.tolist(), got.tolist()))
        assert len(set(seen.values())) == len(seen)


def test_structured_texts_are_told_apart(spark):
    one, two = thue_morse(1024)
    docs = spark.createDataFrame([(1, f"{one}\n{two}"), (2, one), (3, two)], "doc_id long, text string")
    items = spark.createDataFrame([(1, one)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in phrase_index.decontaminate(docs, items).collect()} == {1: 1, 2: 1, 3: 0}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.n_dup_lines for r in quality_rules.apply_rules(docs, none).collect()} == {0}
    far = spark.createDataFrame([(2, one), (3, two)], "doc_id long, text string")
    same([tuple(r) for r in suffix_dedup.remove_repeats(far, length=700).drop("__row_key").collect()], [(i, *x) for i, x in zip((2, 3), plain_removal([one, two], 700))])
    known = {r.doc_id: r.n_known for r in language_model.score(far).collect()}
    assert known == {i: n for i, _, _, n, *_ in plain_scores([(2, one), (3, two)])}


# 6 SimHash


def plain_fingerprint(t):
    x = tokens(t)
    if not x:
        return 0
    shingles = [" ".join(x[i : i + 3]) for i in range(len(x) - 2)] or [" ".join(x)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(find(k)) for k in range(len(fps))]


def test_near_duplicates(docs, rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    expected = [(r[0], fp - (fp >> 63 << 64), c) for r, fp, c in zip(rows, fps, plain_components([r[0] for r in rows], fps))]
    same([tuple(r) for r in simhash.near_duplicates(docs).collect()], expected)


@pytest.mark.parametrize("hot", [0, 2, 1000])
def test_links_reach_the_same_with_and_without_stars(spark, hot):
    rng = random.Random(hot)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (2**64 - 1) for b in base for _ in range(30)}
    fps |= {(base[0] & ~0xFFFFFFFF) | rng.getrandbits(32) for _ in range(40)}
    signed = [f - (f >> 63 << 64) for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), hot)
    found = {r.node: r.root for r in components.components(edges).collect()}
    assert [found.get(f, f) for f in signed] == plain_components(signed, [f & (2**64 - 1) for f in signed])


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([((k * 7919) % 1000, ((k + 1) * 7919) % 1000) for k in range(n)], "a long, b long")
    assert {r.root for r in components.components(edges).collect()} == {0}


def test_keep_one_of_each_component(docs, rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    comps = plain_components([r[0] for r in rows], fps)
    kept = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert Counter(k[0] for k in kept) == Counter(set(comps))
    assert all(k in rows for k in kept)


# 4 phrase index


def plain_hits(text, items, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    x = tokens(text, pattern)
    hit, found = set(), set()
    for item, t in items:
        y = tokens(t, pattern)
        for win in {tuple(y[k : k + window]) for k in range(max(1, len(y) - window + 1)) if y}:
            for k in range(len(x) - len(win) + 1):
                if tuple(x[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found.add("" if item is None else str(item))
    return len(x), len(hit), sorted(found)


@pytest.mark.parametrize("most", [100_000, 7])
def test_decontamination(spark, docs, rows, most):
    long_text = next(r[1] for r in rows if r[1] and len(r[1]) > 10_000)
    items = [(1, long_text[200:400]), (2, "one"), (3, None), (4, ""), (5, rows[2][1]), (5, rows[2][1]), (11, rows[5][1]), (None, "W1, w1"), (7, "not there at all")]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = phrase_index.decontaminate(docs, benchmark, most=most).select("doc_id", "n_words", "n_hit", "items").collect()
    same([tuple(r) for r in got], [(r[0], *plain_hits(r[1], items)) for r in rows])


def test_decontamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert phrase_index.decontaminate(docs, none).where("n_hit > 0").count() == 0
    assert phrase_index.decontaminate(empty(spark), none).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b x c d"), (2, "a b c d"), (3, "a b x x x c d")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "A b, c d")], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in phrase_index.decontaminate(docs, items, slop=1).collect()}
    assert got == {1: ([], ["9"]), 2: (["9"], ["9"]), 3: ([], [])}


def test_proximity_against_a_plain_version(spark):
    rng = random.Random(17)
    docs = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))) for k in range(60)]
    items = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))) for k in range(8)]

    def near(text, item, window=4, slop=1):
        x, y = text.split(), item.split()
        at = {}
        for p, word in enumerate(x):
            at.setdefault(word, set()).add(p)
        windows = [y[k : k + window] for k in range(max(1, len(y) - window + 1))]
        return any(all(any(s + k + d in at.get(word, ()) for d in range(-slop, slop + 1)) for k, word in enumerate(win)) for win in windows for s in range(-slop - window, len(x) + slop))

    as_frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = {r.doc_id: r.near_items for r in phrase_index.decontaminate(as_frame(docs, "doc_id long, text string"), as_frame(items, "item_id long, text string"), window=4, slop=1).collect()}
    assert got == {i: sorted(str(j) for j, u in items if near(t, u)) for i, t in docs}


# 5 quality rules


def plain_counts(t):
    t = t or ""
    x = re.findall(SPACED, t)
    lines = [line for line in t.split("\n") if re.search(SPACED, line)]
    windows = Counter(tuple(x[k : k + 3]) for k in range(len(x) - 2))
    repeated = {j for k in range(len(x) - 2) if windows[tuple(x[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    return len(x), sum(map(len, x)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(spark, docs, rows):
    extra = [(900, "a\na\n \n \nb\r\nb\na", "en", "s", 1, "", 1, ""), (901, "x#y * $ é|é\n\nx#y * $ é|é", "en", "s", 1, "", 1, "")]
    got = quality_rules.apply_rules(docs.union(frame(spark, extra)), labels(spark, rows)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    same([(r.doc_id, *(r[n] for n in names)) for r in got], [(r[0], *plain_counts(r[1])) for r in [*rows, *extra]])
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.apply_rules(empty(spark), labels(spark, rows)).count() == 0


def noisy(spark):
    rng = random.Random(3)
    good = [(k, " ".join(f"word{int(200 * rng.random() ** 1.5)}" for _ in range(rng.randint(60, 90)))) for k in range(150)]
    bad = [(1000 + k, " ".join(f"junk{int(200 * rng.random())}%" for _ in range(rng.randint(60, 90)))) for k in range(40)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in good + bad], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad if i % 2], "doc_id long, quality int, toxic int")
    return docs, marks


def test_quality_threshold_is_the_exact_rank(spark):
    n, share = 60_000, 0.3137
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in row) for row in (rng.random((n, 52)) ** 3 * 3000).astype(int)]
    docs = spark.createDataFrame(pa.table({"doc_id": np.arange(n), "text": texts})).repartition(16)
    good = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got = quality_rules.apply_rules(docs, good, max_trusted=100, low_share=share, margin=0.0).select("doc_id", "llr", "kept", "base_failed").toArrow().to_pandas()
    fitted = {r.doc_id for r in shared.sampled(shared.trusted_ids(good), "doc_id", 100).collect()}
    judged = np.sort(got.llr[~got.doc_id.isin(fitted)])
    assert len(judged) == n - 100
    assert (got.kept == (~got.base_failed & (got.llr >= judged[math.ceil(share * len(judged)) - 1]))).all()


@pytest.mark.parametrize(("values", "rows"), [([], 5), ([None], 5), ([2.0] * 40, 5), ([float(k % 7) for k in range(500)] + [None], 5), ([1e9, -1e9, *(k / 1e6 for k in range(3000))], 50)])
def test_exact_quantile(spark, monkeypatch, values, rows):
    monkeypatch.setattr(shared, "QUANTILE_ROWS", rows), monkeypatch.setattr(shared, "QUANTILE_RANGES", 16)
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    ordered = sorted(v for v in values if v is not None)
    for share in (0.0, 0.01, 0.5, 0.99, 1.0):
        assert shared.exact_quantile(df, "x", share) == (ordered[max(math.ceil(share * len(ordered)), 1) - 1] if ordered else None)
    grouped = df.withColumn("g", (F.col("x") % 3).cast("int"))
    got = shared.exact_quantiles(grouped, "x", [0.3, 0.9], "g")
    for g, xs in [(None, ordered), *((str(g), [x for x in ordered if int(math.fmod(x, 3)) == g]) for g in (0, 1, 2))]:
        assert got.get(g) == ([xs[max(math.ceil(s * len(xs)), 1) - 1] for s in (0.3, 0.9)] if xs else None)


@pytest.mark.parametrize("judge", [quality_rules.apply_rules, perplexity.classify])
def test_held_out_verdicts(spark, judge):
    docs, marks = noisy(spark)
    kept = {r.doc_id: r.kept for r in judge(docs, marks).collect() if r.doc_id % 2 == 0}  # rows without a label
    good = [v for i, v in kept.items() if i < 1000]
    bad = [v for i, v in kept.items() if i >= 1000]
    assert sum(good) >= 0.95 * len(good)
    assert sum(bad) <= 0.05 * len(bad)


# 9 perplexity


def plain_kneser_ney(training, texts):
    bi = Counter(b for t in training for b in zip(["<s>", *tokens(t)], [*tokens(t), "</s>"]))
    ctx, follow, before = Counter(), {}, Counter()
    for (u, x), c in bi.items():
        ctx[u] += c
        follow.setdefault(u, []).append(c)
        before[x] += 1
    of = lambda values: perplexity.discounts([sum(1 for v in values if v == k) for k in (1, 2, 3, 4)])
    d, d1 = of(bi.values()), of(before.values())
    total = sum(before.values())
    floor = sum(d1[min(c, 3) - 1] for c in before.values()) / total / (len(before) + 1)
    out = []
    for t in texts:
        x = [*tokens(t), "</s>"]
        logs = 0.0
        for u, v in zip(["<s>", *x], x):
            low = (before[v] - d1[min(before[v], 3) - 1]) / total + floor if before[v] else floor
            high = (bi[u, v] - d[min(bi[u, v], 3) - 1]) / ctx[u] if bi[u, v] else 0.0
            back = sum(d[min(c, 3) - 1] for c in follow[u]) / ctx[u] if ctx[u] else 1.0
            logs += math.log(high + back * low)
        out.append((math.exp(-logs / len(x)), math.exp(min(700.0, -logs / len(set(zip(["<s>", *x], x)))))))
    return out


@pytest.mark.parametrize("n", [1, 9])
def test_perplexity_matches_a_plain_model(docs, rows, n):
    training = [r for r in rows if r[0] is not None and r[0] % 2]
    model = perplexity.Model(docs.where("doc_id % 2 = 1"), "text", n)
    as_input = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("row"), F.col("text"))
    got = {(r.row.doc_id, r.row.h): (r.perplexity, r.type_perplexity) for r in perplexity.scored(as_input, model, n).collect()}
    expected = plain_kneser_ney([r[1] for r in training], [r[1] for r in rows])
    assert np.allclose(sorted(got.values()), sorted({(r[0], r[1]): p for r, p in zip(rows, expected)}.values()), rtol=1e-9)


def test_perplexity_thresholds_are_exact_ranks_by_language(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(f"{lang}{int(50 * rng.random() ** 2)}" for _ in range(rng.randint(3, 30))), lang) for k, lang in enumerate(rng.choices(["a", "b", None, "few"], [50, 40, 8, 2], k=500))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(k, 1, 0) for k, _, _ in rows], "doc_id long, quality int, toxic int")
    got = perplexity.classify(docs, marks, high_quantile=0.9, slack=1.5).collect()
    _, judged = shared.halved(shared.trusted_ids(marks), "doc_id")
    judged = {r.doc_id for r in judged.collect()}
    rank = lambda xs: sorted(xs)[math.ceil(0.9 * len(xs)) - 1]
    base = [r for r in got if r.doc_id in judged and r.n_words >= 5]
    for lang in ("a", "b", None, "few"):
        own = [r for r in base if r.lang == lang] if lang in ("a", "b") else base
        for r in (r for r in got if r.lang == lang):
            assert r.threshold == pytest.approx(1.5 * rank([x.perplexity for x in own])) and r.type_threshold == pytest.approx(1.5 * rank([x.type_perplexity for x in own]))
            assert r.kept == (r.n_words < 5 or (r.perplexity <= r.threshold and r.type_perplexity <= r.type_threshold))


def test_perplexity_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert perplexity.classify(docs, none).where("not kept").count() == 0
    assert perplexity.classify(empty(spark), none).count() == 0
    assert quality_rules.apply_rules(docs, none).count() == docs.count()


# 7 language model


def plain_model(rows, prior=language_model.PRIOR):
    """The probability function of a model of the training rows, and their token counts."""
    grams, texts = Counter(), 0
    for i, t in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1:
            x = ["<s>", *tokens(t), "</s>"]
            grams.update(tuple(x[k : k + n]) for n in (1, 2, 3) for k in range(len(x) - n + 1))
    uni = {g[0]: c for g, c in grams.items() if len(g) == 1 and g[0] != "<s>"}
    n, v = sum(uni.values()), len(uni)

    def p(history, y):
        if not history:
            return (uni.get(y, 0) + 0.5) / (n + 0.5 * (v + 1))
        m = prior[len(history) + 1]
        return (grams[(*history, y)] + m * p(history[1:], y)) / (grams[history] + m)

    return p, uni, n


def plain_scores(rows):
    p, uni, n = plain_model(rows)
    for i, t in rows:
        x = ["<s>", *tokens(t), "</s>"]
        base = sum(math.log10(p((), y)) for y in x[1:])
        score = sum(math.log10(p(tuple(x[max(0, k - 2) : k]), x[k])) for k in range(1, len(x)))
        yield i, zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1, len(x) - 1, sum(y in uni for y in x[1:]), n, base, score


@pytest.mark.parametrize(("n_shards", "piece", "chunk"), [(None, 256, 3 << 20), (7, 256, 3000), (1000, 3, 3 << 20)])
def test_language_model(docs, rows, monkeypatch, n_shards, piece, chunk):
    ask, texts = shards.ask, shards.texts
    monkeypatch.setattr(language_model, "ask", lambda d, o, n, c: ask(d, o, n, c, chunk))
    monkeypatch.setattr(language_model, "texts", lambda d: texts(d, chunk))
    got = [tuple(r) for r in language_model.score(docs, shards=n_shards, piece=piece).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]
    order = lambda r: tuple((x is None, x) for x in r)
    got, expected = sorted(got, key=order), sorted(plain_scores([(r[0], r[1]) for r in rows]), key=order)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert np.allclose([g[5:] for g in got], [e[5:] for e in expected], rtol=1e-9, atol=1e-9)


def test_language_model_probabilities_sum_to_one():
    rows = [(k, "a b a b c a b c c") for k in range(9)]
    p, uni, _ = plain_model(rows)
    inner = [y for y in uni if y != "</s>"]  # nothing follows an end
    for history in [(), *((a,) for a in ("<s>", *inner, "new")), *((a, b) for a in ("<s>", *inner, "new") for b in inner)]:
        assert abs(sum(p(history, y) for y in (*uni, "new")) - 1) < 1e-9  # one place for all unknown words


def test_packed_requests():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000):
        keys = np.sort(rng.integers(0, 1 << 56, n, dtype=np.uint64))
        assert (shards.unpacked_keys(*shards.packed_keys(keys)) == keys).all()
        counts = rng.integers(0, 300, n)
        assert (shards.unpacked_counts(shards.packed_counts(counts), n) == counts).all()


def test_language_model_refuses_answers_to_other_texts(spark, rows):
    first, second = frame(spark, rows[:20]).coalesce(1), frame(spark, rows[1:21]).coalesce(1)
    as_input = lambda d: d.select(F.struct(F.col("doc_id").alias("id")).alias("row"), F.col("text"))
    asked = shards.ask(as_input(first), 3, 2, language_model.training_counts).groupBy("shard").applyInArrow(language_model.add_up, shards.REPLY)
    every = shards.texts(as_input(second)).unionByName(asked.where(F.col("kind") == shards.ANSWER), allowMissingColumns=True).toArrow()
    with pytest.raises(RuntimeError, match="changed"):
        language_model.score_chunk(every, 2, 10, 10, language_model.PRIOR, 256)


def test_language_model_of_nothing(spark):
    assert language_model.score(empty(spark)).count() == 0


# 3 suffix arrays


def plain_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for q in range(len(b)) if gone[q] and (q == 0 or not gone[q - 1]))
        yield len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("length", "hot"), [(400, 1000), (40, 1000), (40, 1)])
def test_repeats_are_removed(docs, rows, monkeypatch, length, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    got = suffix_dedup.remove_repeats(docs, length=length).drop("__row_key").collect()
    same([tuple(r) for r in got], [(r[0], *x) for r, x in zip(rows, plain_removal([r[1] for r in rows], length))])


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(150):
        data = rng.integers(0, 3, int(rng.integers(1, 70))).astype(np.uint8)
        raw, order = data.tobytes(), suffix_dedup.suffix_array(data)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        lcp = suffix_dedup.common_prefixes(data, order)
        for k in range(1, len(raw)):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


# 8 personal data

KINDS = ("email", "ip", "card", "phone")
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(t):
    def valid(kind, m):
        d = re.sub("[^0-9]", "", m)
        return kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.split("."))) or (kind == "card" and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)

    return sorted((m.start(), KINDS.index(k), k, m.end()) for k in KINDS for m in re.finditer(PLAIN[k], t or "") if valid(k, m[0]))


PRIVATE = [
    "mail a.b@c.d, x@y@z.com and e@f.g_h@i.jk or a@b.c_d@e.f; not q@r",
    "ñandú +1 (269) 555-3296 4524132264652876 at 10.0.0.1.2.3.4.5 and 256.1.1.1, 001.2.3.4",
    "4111 1111 1111 1111, 4111-1111-1111-1112 1 2 3--4 5  6 +49 (30) 123.45-67 é",
    "é call (212) 555-0199 or +44 20 7946 0958. order 2024-123-456 sales (at) corp (dot) com",
    "1 " * 20000 + "a" * 20000 + "@" + "b." * 3000 + "c " + "1.2." * 3000 + "9" * 20000,
    "no data here",
    "",
    None,
]


def test_personal_data(spark):
    rows = [(k, t) for k, t in enumerate(PRIVATE)] + [(1, PRIVATE[1])] * 3 + [(None, PRIVATE[0])]
    got = personal_data.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same([(r.doc_id, [(s.start, s.order, s.kind, s.end) for s in r.base]) for r in got], [(i, plain_spans(t)) for i, t in rows])
    texts = dict(rows)
    for r in got:
        taken = [(s.start, s.end) for s in [*r.base, *r.added]]
        for s in r.added:
            assert s.kind in personal_data.ALL_KINDS and 0 <= s.start < s.end <= len(texts[r.doc_id])
            assert sum(a < s.end and s.start < b for a, b in taken) == 1
    assert any(texts[r.doc_id][s.start : s.end] == "(212) 555-0199" for r in got for s in r.added)


def test_personal_data_model_on_held_out_examples(spark):
    trees, limits = personal_data.train(spark)
    assert set(limits) == set(personal_data.ALL_KINDS)
    from setsim.llm import boosting

    rows = personal_data.examples(spark, 12_000).where("id is null or true") if "id" in personal_data.examples(spark, 1).columns else personal_data.examples(spark, 12_000)
    judged = rows.where("fold = 0").select("kind", "label", *personal_data.features()).select("kind", "label", boosting.probability(trees).alias("p")).collect()
    taken = [r.label for r in judged if r.p >= limits[r.kind]]
    assert sum(taken) / len(taken) >= 0.9
    assert sum(taken) >= 0.7 * sum(r.label for r in judged)


def test_secrets_are_learnt_from_the_corpus(spark):
    rng = random.Random(6)
    secret = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    hidden = {k: f"words before token = \"{secret(40)}\" and after" for k in range(60)}
    hidden |= {100 + k: f"plain api_key: {secret(32)} here" for k in range(20)}
    open_ = {200 + k: f"see section-{k}-of-the-long-report, by A1-{k} at home/user{k}/documents/letters" for k in range(40)}
    docs = spark.createDataFrame([*hidden.items(), *open_.items()], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.added] for r in personal_data.find_spans(docs).collect()}
    for k, t in hidden.items():
        m = re.search("[0-9a-f]{32,}", t)
        assert got[k] == [("secret", m.start(), m.end())]
    assert not any(got[k] for k in open_)
    cleaned = {r.doc_id: r.text for r in personal_data.redact(docs).collect()}
    assert all(cleaned[k] == re.sub("[0-9a-f]{32,}", "<secret>", t) for k, t in hidden.items())


def test_long_addresses_are_proposed(spark):
    text = "write to " + "a" * 90 + " (at) " + ".".join(["host" * 20] * 12) + " today"
    (got,) = personal_data.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [text[s.start : s.end] for s in got.added] == [text[9:-6]]


def test_redaction(spark):
    rows = [(1, "é a.b@c.de x +1 (212) 555-0199", "k"), (2, None, None), (3, "plain", "k"), (3, "plain", "k"), (4, "", None)]
    got = personal_data.redact(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()
    same([tuple(r) for r in got], [(1, "é <email> x <phone>", "k"), *rows[1:]])


# 2 extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad">Buy now, now, now, and more of it today.</div>
<div class="cookie-notice">We use cookies, as everyone does, all the time.</div>
<div id="content"><h2>Title &amp; more</h2><p>The first paragraph, of some length, has
 commas, and <b>bold</b> w<i>or</i>ds.<p>The second one is long too, so it scores points, I hope.<br>After a break.</p>
<form>Name <input name=a><button>Send it now please</button></form><script>var x = "<p>no</p>";</script>
<div class="comments"><p>I am a reader, and this comment, sadly, is rather long, too.</p></div></div>
<aside><p>Related things, of which there are many, in a sidebar, go here.</p></aside><footer>&copy; someone</footer></body></html>"""


def test_main_text():
    assert extract.main_text(PAGE) == "Title & more The first paragraph, of some length, has commas, and bold words. The second one is long too, so it scores points, I hope. After a break."


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p>hi", "hi"), ("a < b", "a < b"), ("<!-- x", ""), ("<script>abc", ""), ("<article>é&nbsp;x<br>y</article>", "é x y"), ("<p>a<p>b<div>c</p>d", "a b c d"), ("<div hidden>x</div>y", "y")])
def test_odd_pages(page, text):
    assert extract.main_text(page) == text


LONG = "This is a sentence of the article itself, which has commas, words, and some length."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="overflow-hidden"><p>{LONG}</p><p>{LONG}</p></div><p>Something short, elsewhere, on the page.</p>', f"{LONG} {LONG}"),
        (f'<div class="post comments-open"><p>{LONG}</p></div>', LONG),
        (f"<body><form action=x><div><p>{LONG}</p><input><p>{LONG}</p></div></form></body>", f"{LONG} {LONG}"),
        (f"<main><article><p>{LONG}</p></article><article><p>{LONG} Two.</p></article></main>", f"{LONG} {LONG} Two."),
        (f"<article><header><h1>Title</h1><p>A lead.</p></header><p>{LONG}</p></article>", f"Title A lead. {LONG}"),
        (f'<header><p>Site name, slogan.</p></header><article><p>{LONG}</p></article><form><p>Sign up here, now.</p></form>', LONG),
        (f'<article><p>{LONG}</p></article><div class="comment-list"><p>{LONG} Reader.</p><p>{LONG} Reader.</p></div>', LONG),
        (f'<article><p>{LONG}</p></article><article class="comment"><p>{LONG} Reader.</p></article>', LONG),
    ],
)
def test_text_is_not_lost_to_names(page, text):
    assert extract.main_text(page) == text


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "</x>" * 100_000 + "t", "<p>" + "<b>" * 20_000 + "<div></div>" * 20_000 + "t", "<table><tr><td>" + "<b>" * 20_000 + "<li>" * 20_000 + "t", "<b>" * 20_000 + "<p>word, word, word, word, word." * 5_000, "<a '" * 50_000 + "t", "<!" * 50_000, "&" * 100_000])
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    extract.main_text(page)
    assert time.perf_counter() - began < 4


class ArticleText(HTMLParser):
    """The text within <article>, blocks joined by a space: all there is to find on the synthetic pages."""

    def __init__(self):
        super().__init__()
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.parts.append(" " if tag not in extract.INLINE else "")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.parts.append(" " if tag not in extract.INLINE else "")

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_synthetic_pages_against_a_plain_parser():
    pages = Path("/root/testdata/sf0.001/pages.parquet")
    if not pages.exists():
        pytest.skip("no synthetic pages here")
    table = pq.read_table(pages)
    for page in table.column("html").to_pylist():
        plain = ArticleText()
        plain.feed(page or "")
        assert extract.main_text(page) == " ".join("".join(plain.parts).split())


def test_deep_and_long_pages_take_linear_time():
    assert extract.main_text("<div>" * 50_000 + "deep") == "deep"
    assert len(extract.main_text("<p>word " * 50_000).split()) == 50_000


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = extract.extract(pages).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got)
    assert extract.extract(pages.limit(0)).count() == 0


# 1 mixing


def test_rates_reach_targets(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        p = [rng.random() ** 4, rng.random() ** 2, rng.random()]
        rows.append((k, rng.randint(0, 300), [x / sum(p) for x in p]))
    soft = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>").cache()
    targets = {"a": 0.3, "b": 0.3, "c": 0.4}
    got = soft.withColumn("rate", mixing.fit_rates(soft, targets)).collect()
    total = sum(r.n_tokens for r in got)
    assert all(r.rate >= 0 for r in got)
    for k, share in enumerate(targets.values()):
        assert abs(sum(r.n_tokens * r.rate * r.posterior[k] for r in got) - share * total) <= 2e-3 * total


def test_mixing_cases(spark, docs, rows):
    targets = {"clean": 0.8, "low": 0.1, "toxic": 0.1}
    labelled = mixing.label_domains(labels(spark, rows))
    got = mixing.mix(docs, labelled, targets, keep=("source",)).collect()
    assert len(got) == len(rows)
    assert all(abs(sum(r.posterior) - 1) < 1e-9 and r.rate >= 0 and r.n_copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in got)
    assert sorted(r.n_tokens for r in got) == sorted(len([x for x in re.split(r"[ \t-\r]+", r[1] or "") if x]) for r in rows)
    assert mixing.mix_rows(docs, labelled, targets).columns == [*(c for c in docs.columns if c != "rate"), "rate", "n_copies"]
    assert mixing.mix(empty(spark), labelled, targets).count() == 0
    none = labelled.limit(0)
    assert mixing.mix(docs, none, targets).count() == len(rows)


def test_mixing_learns_rare_telling_words_and_warns(spark):
    rng = random.Random(12)
    text = lambda: " ".join(f"word{int(300 * rng.random() ** 1.5)}" for _ in range(60))
    clean = [(k, text()) for k in range(240)]
    toxic = [(1000 + k, text() + f" vile{k % 3} " + text()) for k in range(60)]
    copies = [(2000 + k, toxic[0][1]) for k in range(40)]
    docs = spark.createDataFrame([*clean, *toxic, *copies], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "clean" if i < 1000 else "toxic") for i, _ in [*clean, *toxic, *copies] if i % 2], "doc_id long, domain string")
    got = {r.doc_id: r for r in mixing.mix(docs, labelled, {"clean": 0.98, "toxic": 0.02}, epochs=1.2).collect()}
    assert all((r.posterior[1] > 0.5) == (i >= 1000) for i, r in got.items() if i % 2 == 0)
    assert all(r.n_copies > 0 for i, r in got.items() if i < 1000) and sum(r.n_copies > 0 for i, r in got.items() if i >= 1000) < 30
    rows = mixing.mix_rows(docs, labelled, {"clean": 0.98, "toxic": 0.02}, epochs=1.2, repeat=True)
    assert Counter(r.doc_id for r in rows.collect()) == Counter({i: r.n_copies for i, r in got.items()})
    soft = spark.createDataFrame([(10, [1.0, 0.0])] * 3, "n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="misses its target"):
        mixing.fit_rates(soft, {"a": 0.5, "b": 0.5}, steps=3)


def plain_rates(rows, targets, epochs, steps):
    """Projected steps in numpy: rates, and what is left of the targets."""
    n, p = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    wanted = epochs * n.sum() * np.array(targets) / sum(targets)
    rate = np.ones(len(n))
    for _ in range(steps):
        left = wanted - (n * rate) @ p
        if np.abs(left).max() <= mixing.TOLERANCE * epochs * n.sum():
            break
        free = n * (rate > 0)
        rate = np.maximum(0, rate + p @ np.linalg.solve((p * free[:, None]).T @ p + 1e-6 * n.sum() * np.eye(p.shape[1]), left))
    return rate


def test_lexicon_hits_match_plain_sets(spark):
    """Words of any characters; each counts once a row, in its own list."""
    rng = random.Random(21)
    odd = ["it's", 'say"', "a\\b", "${spark.app.name}", "x'41'", "%_", "naïve", "😀", "--", "w`", "\u00a0", "null"]
    lexica = [odd[:7], [f"w{k}" for k in range(300)], [], odd[7:], ["one"]]
    texts = [None, "", " \t\n", "ONE one", *(" ".join(rng.choices([*odd, *(f"W{k}" for k in range(600)), "rest"], k=rng.randint(1, 400))) for _ in range(40))]
    rows = mixing.with_words(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    for r in mixing.with_hits(rows, lexica).collect():
        plain = {x for x in re.split(r"[ \t-\r]+", lowered(r.text)) if x}
        assert [r[f"__n{k}"] for k in range(5)] == [len(plain & set(words)) for words in lexica]
    assert all(r["__hits0"] == 0 for r in mixing.with_hits(rows, [[]]).collect())


def test_rates_match_plain_steps(spark):
    rng = random.Random(15)
    rows = []
    for _ in range(300):
        p = [rng.random() ** 3, rng.random()]
        rows.append((rng.randint(0, 200), [x / sum(p) for x in p]))
    soft = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, n_tokens long, posterior array<double>")
    got = [r.rate for r in soft.withColumn("rate", mixing.fit_rates(soft, {"a": 0.1, "b": 0.9}, 1.3)).orderBy("k").collect()]
    assert np.allclose(got, plain_rates(rows, [0.1, 0.9], 1.3, mixing.MAX_STEPS), atol=1e-9)


def test_rates_of_many_steps_keep_plans_small(spark):
    """Only toxic rows and a target of none: every step is taken, and the plan is that of one step with more numbers."""
    rows = [(k, 10 + k, [0.2 + k / 1000, 0.8 - k / 1000]) for k in range(50)]
    soft = spark.createDataFrame(rows, "k int, n_tokens long, posterior array<double>")

    def planned(steps):
        with pytest.warns(UserWarning, match="misses its target"):
            out = soft.withColumn("rate", mixing.fit_rates(soft, {"a": 1.0, "b": 0.0}, steps=steps))
        return [r.rate for r in out.orderBy("k").collect()], out._jdf.queryExecution().optimizedPlan().toString().lower().count("greatest(")

    (few, one), (many, same) = planned(1), planned(mixing.MAX_STEPS)
    assert one == same == 1
    for got, steps in ((few, 1), (many, mixing.MAX_STEPS)):
        assert np.allclose(got, plain_rates([r[1:] for r in rows], [1.0, 0.0], 1.0, steps), atol=1e-6)


def test_posteriors_on_held_out_rows(spark):
    docs, marks = noisy(spark)
    got = mixing.mix(docs, mixing.label_domains(marks), {"clean": 0.5, "low": 0.5}).collect()
    right = [(r.posterior[0] > 0.5) == (r.doc_id < 1000) for r in got if r.doc_id % 2 == 0]
    assert sum(right) >= 0.97 * len(right)


# 10 licenses


def plain_cosines(text):
    """Cosines to all templates, by license the largest, from the texts of the templates alone."""
    split = lambda t: Counter(re.findall("[a-z0-9]+", t.lower()))
    templates = [(name, split(t)) for name, ts in licenses.TEMPLATES.items() for t in ts]
    df = Counter(x for _, c in templates for x in c)
    idf = lambda x: math.log((len(templates) + 1) / (df[x] + 1)) + 1
    vector = lambda c: {x: (1 + math.log(n)) * idf(x) for x, n in c.items()}
    unit = lambda v: {x: w / math.sqrt(sum(y * y for y in v.values())) for x, w in v.items()}
    own, out = unit(vector(split(text))), {}
    for name, c in templates:
        out[name] = max(out.get(name, 0.0), sum(w * own.get(x, 0.0) for x, w in unit(vector(c)).items()))
    return out


def test_names_that_operators_use_are_left_alone(spark, rows):
    """Rows whose own columns have the names of inner ones come back as they were."""
    names = ["__row_key", "__row", "__text", "__id", "__key", "__words", "__spans", "__clean", "__t"]
    docs = spark.createDataFrame([(*r[:4], *(f"{c}{k}" for c in names)) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names))
    marks, items = labels(spark, rows), spark.createDataFrame([(1, rows[2][1])], "item_id long, text string")
    before = set(map(tuple, docs.drop("text").collect()))
    for got in (simhash.keep_one(docs), personal_data.redact(docs), mixing.mix_rows(docs, mixing.label_domains(marks), {"clean": 1.0}).drop("rate", "n_copies")):
        assert got.columns == docs.columns and set(map(tuple, got.drop("text").collect())) <= before
    for got in (perplexity.classify(docs, marks), quality_rules.apply_rules(docs, marks), phrase_index.decontaminate(docs, items), suffix_dedup.remove_repeats(docs), language_model.score(docs), simhash.near_duplicates(docs), personal_data.find_spans(docs)):
        assert got.count() == len(rows)


def test_license_scan(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.py", "print(1)"),
        (3, "a/b/LICENSE.txt", notice),
        (4, "z/q.py", None),
        (5, "a/y.py", "# SPDX-License-Identifier: GPL-3.0-or-later\n" + "code\n" * 50),
        (6, None, "x"),
        (7, "top.txt", ""),
        (8, "a/k.py", "This license talk is about something quite different from any notice\n" + "code " * 50),
        (8, "a/k.py", "This license talk is about something quite different from any notice\n" + "code " * 50),
    ]
    files = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, license string")
    got = licenses.scan(files, keep=("doc_id",)).select("doc_id", "own_license", "license", "inherited_from").collect()
    expected = [(1, "MIT", "MIT", None), (2, None, "Apache-2.0", "a/b/"), (3, "Apache-2.0", "Apache-2.0", None), (4, None, None, None), (5, "GPL-3.0", "GPL-3.0", None), (6, None, None, None), (7, None, None, None), (8, None, "MIT", "a/"), (8, None, "MIT", "a/")]
    same([tuple(r) for r in got], expected)
    assert licenses.scan(files.limit(0)).count() == 0


def test_license_cosines(spark):
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts] + ["licensed under the public license", "copyright copyright me", "license"]
    frame_ = spark.createDataFrame([(t,) for t in texts], "passage string")
    named = frame_.withColumn("passage_id", shared.row_key("passage"))
    got = {r.passage: r for r in licenses.closest(frame_).join(named, "passage_id").collect()}
    for t in texts:
        first, second = sorted(plain_cosines(t).values(), reverse=True)[:2]
        assert (got[t].cosine if t in got else 0.0) == pytest.approx(first, abs=2e-6)
        assert (got[t].lead if t in got else 0.0) == pytest.approx(first - second, abs=4e-6)


def test_templates_have_cues():
    assert [t for ts in licenses.TEMPLATES.values() for t in ts if not re.search(licenses.CUE, t)] == []


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
        ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3", "AGPL-3.0"),
        ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
        ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Zlib"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        ("This code is not licensed under the MIT License.", None),
        ("A story about the public, and of a version of it.", None),
    ],
)
def test_licenses_by_notice(spark, text, name):
    (got,) = licenses.scan(spark.createDataFrame([("a/b.txt", "Some words before.\n\n" + text + "\n\nand after it")], "path string, text string")).collect()
    assert got.own_license == name
