"""The pipeline's stages over a corpus of awkward rows, against plain versions."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from .common import SCHEMA, corpus, frame, labels
from .test_operators import plain_components, plain_fingerprint, plain_hits, plain_spans


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = f"file://{tmp_path_factory.mktemp('tables')}"
    rows = corpus(7)
    rows.append((500, "write to a.b@c.de or +1 (212) 555-0199 soon, " + "plain words here " * 20, "en", "s0", 1, "x", 1, "y"))
    frame(spark, rows).write.parquet(f"{base}/documents.parquet")
    labels(spark, rows).write.parquet(f"{base}/labels.parquet")
    items = [(1, next(r[1] for r in rows if r[1] and len(r[1]) > 10_000)[300:500]), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, rows, items


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "redact", "mix"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_takes_awkward_and_empty_tables(spark, tables, name):
    base, rows, _ = tables
    docs = spark.read.parquet(f"{base}/documents.parquet")
    got = stage(name)(spark, docs, base)
    kept = got.collect()
    assert 0 < len(kept) <= len(rows)
    if name != "mix":
        assert got.columns == docs.columns
    assert stage(name)(spark, docs.limit(0), base).count() == 0
    nulls = spark.createDataFrame([(None,) * 8, (None,) * 8, (1, *(None,) * 7)], SCHEMA)
    assert stage(name)(spark, nulls, base).count() <= 3


def test_near_dedup_keeps_one_of_each_group(spark, tables):
    base, rows, _ = tables
    kept = [tuple(r) for r in stage("near_dedup")(spark, frame(spark, rows), base).collect()]
    groups = plain_components([r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows])
    assert Counter(r[0] for r in kept) == Counter(set(groups))


def test_decontamination_drops_what_holds_a_window(spark, tables):
    base, rows, items = tables
    kept = [tuple(r) for r in stage("decontaminate")(spark, frame(spark, rows), base).collect()]
    expected = [r for r in rows if not plain_hits(r[1], items)[1]]
    assert len(expected) < len(rows) and Counter(kept) == Counter(expected)


def test_redaction_keeps_rows_and_removes_data(spark, tables):
    base, rows, _ = tables
    got = [tuple(r) for r in stage("redact")(spark, frame(spark, rows), base).collect()]
    private = [r for r in rows if plain_spans(r[1])]
    assert len(private) == 1 and len(got) == len(rows)
    (clean,) = (Counter(got) - Counter(rows)).elements()
    assert clean[0] == private[0][0] and not plain_spans(clean[1]) and "<email>" in clean[1] and clean[4] == len(clean[1])


def test_whole_pipeline_keeps_clean_documents(spark, tmp_path):
    base, rng = f"file://{tmp_path}", random.Random(11)
    good = [(k, " ".join(f"word{int(300 * rng.random() ** 1.5)}" for _ in range(rng.randint(60, 90)))) for k in range(150)]
    bad = [(1000 + k, " ".join(f"junk{int(300 * rng.random())}%" for _ in range(80))) for k in range(30)]
    copies = [(2000 + k, good[3][1]) for k in range(20)]
    leak = (3000, good[0][1][:50] + " the benchmark has just these ten words and some more here " + good[1][1])
    rows = [(i, t, "en", "s", len(t)) for i, t in [*good, *bad, *copies, leak]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, "The benchmark has just these ten words, and some more here.")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, base).collect()}
    assert len(kept & {i for i, _ in good}) >= 0.95 * len(good)
    assert len(kept & {i for i, _ in bad}) <= 2
    assert not kept & {i for i, _ in copies} and 3000 not in kept
