"""Quality rules: plain counts, and a log-likelihood ratio of hashed n-grams.

Word unigrams and bigrams are hashed into a fixed number of buckets. Two smoothed
multinomials over the buckets, one of trusted documents and one of the whole raw corpus,
give each document a log-likelihood ratio, divided by its number of n-grams. A document
is kept if that is at least a threshold read off the trusted documents' own ratios, so
every document gets the same verdict on every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import KEY, exact_quantile, row_key, sampled, trusted_ids, written
from .words import NOT_SPACE, Block, Words, blocks, byte_class, bytes_hashes, combine, per_text, word_ranges, words

BUCKETS = 1 << 16
#: Most labelled documents the trusted multinomial is fitted to.
MAX_TRUSTED = 20_000
#: Share of the trusted documents allowed below the threshold, and a margin below that.
LOW_SHARE, MARGIN = 0.01, 0.1
SYMBOLS = byte_class(*((ord(c), ord(c)) for c in "#*$%&|<>"))
CHAR_START = ~byte_class((0x80, 0xBF))


def buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of each unigram and each bigram within a text."""
    mask = np.uint64(BUCKETS - 1)
    uni = (w.hashes & mask).astype(np.int64)
    if len(uni) < 2:
        return uni, w.doc
    same = w.doc[1:] == w.doc[:-1]
    bi = (combine(w.hashes[:-1], w.hashes[1:])[same] & mask).astype(np.int64)
    return np.concatenate((uni, bi)), np.concatenate((w.doc, w.doc[1:][same]))


def bucket_counts(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Corpus counts (bucket, count) over whole texts, summed within each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for block in blocks(b.column(text)):
                total += np.bincount(buckets(words(block))[0], minlength=BUCKETS)
        (used,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", name])

    return docs.select(text).mapInArrow(run, f"bucket int, {name} long").groupBy("bucket").agg(F.sum(name).alias(name))


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str) -> np.ndarray:
    """log p_trusted - log p_raw of each bucket; a table of fixed size."""
    both = bucket_counts(docs, text, "raw").join(bucket_counts(trusted, text, "good"), "bucket", "full")
    counts = np.zeros((2, BUCKETS))
    for r in both.collect():  # at most BUCKETS rows
        counts[:, r["bucket"]] = r["raw"] or 0, r["good"] or 0
    raw, good = counts
    weight = 1.0
    p_raw = (raw + weight) / (raw.sum() + weight * BUCKETS)
    p_good = (good + weight * BUCKETS * p_raw) / (good.sum() + weight * BUCKETS)  # unseen buckets fall back to the raw corpus
    return np.log(p_good) - np.log(p_raw)


def repeated_words(w: Words) -> np.ndarray:
    """Which words lie in a 3-word window that its text has at least twice."""
    out = np.zeros(len(w.hashes) + 2, dtype=bool)
    if len(w.hashes) >= 3:
        at = np.flatnonzero(w.doc[2:] == w.doc[:-2])
        key = combine(w.hashes[at], w.hashes[at + 1], w.hashes[at + 2], w.doc[at].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            out[at[twice] + k] = True
    return out[: len(w.hashes)]


def duplicate_lines(block: Block) -> np.ndarray:
    """Per text, lines with a word that equal an earlier line of the text."""
    line_byte = ~byte_class((0x0A, 0x0A))
    starts, ends, _ = word_ranges(block.data, block.bounds, line_byte)
    if not len(starts):
        return np.zeros(block.n, dtype=np.int64)
    black = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum(NOT_SPACE[block.data], out=black[1:])
    full = black[ends] > black[starts]
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(block.bounds, starts, side="right") - 1
    key = combine(bytes_hashes(block.data, starts, ends), doc.astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    later = np.ones(len(key), dtype=bool)
    later[first] = False
    return np.bincount(doc[later], minlength=block.n)


def measured(docs: DataFrame, ratios: np.ndarray, text: str) -> DataFrame:
    """Replaces the text by the plain counts, n_grams and llr (the ratio per n-gram, 0 without words)."""
    rest = [c for c in docs.columns if c != text]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams"]
    schema = docs.select(*rest, *(F.lit(0).cast("long").alias(c) for c in counts), F.lit(0.0).alias("llr")).schema
    known = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(text)):
                w = words(block, lower=False)
                inside = NOT_SPACE[block.data] & CHAR_START[block.data]
                grams, doc = buckets(words(block))
                n_grams = np.bincount(doc, minlength=block.n)
                total = np.bincount(doc, weights=known.value[grams], minlength=block.n)
                columns = [
                    w.counts,
                    per_text(inside, block.bounds),
                    per_text(SYMBOLS[block.data], block.bounds),
                    duplicate_lines(block),
                    per_text(repeated_words(w), w.first),
                    n_grams,
                ]
                part = b.slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *(pa.array(x.astype(np.int64)) for x in columns), pa.array(total / np.maximum(n_grams, 1))], names=schema.names)

    return docs.select(*rest, text).mapInArrow(run, schema)


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", max_trusted: int = MAX_TRUSTED, low_share: float = LOW_SHARE, margin: float = MARGIN) -> DataFrame:
    """For each row: id_col, __row_key, the counts, llr, base_failed, kept.

    The trusted multinomial is fitted to at most max_trusted, and at most half, of the rows
    that the label table (the same id column, quality, toxic) trusts. The threshold is the
    low_share quantile of llr of all the other trusted rows, less the margin; without any trusted row the verdict is kept unless base_failed. Null, empty
    and wordless texts have zero counts and fail. Repeated rows each get a row, an empty
    table gives none, and columns not named are ignored.
    """
    rows = docs.select(F.col(id_col), F.col(text).alias("__text")).withColumn(KEY, row_key(id_col, "__text"))
    trusted = written(trusted_ids(labels, id_col), "trusted")
    fitted = F.broadcast(written(sampled(trusted, id_col, min(max_trusted, (trusted.count() + 1) // 2)), "fit"))  # max_trusted ids at most
    ratios = log_ratios(rows, rows.join(fitted, id_col, "left_semi"), "__text")
    found = written(measured(rows, ratios, "__text"), "measured")
    others = trusted.join(fitted, id_col, "left_anti")  # a model likes what it has seen too well
    low = exact_quantile(written(found.where("n_words >= 50").join(others, id_col, "left_semi").select("llr"), "judged"), "llr", low_share)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = F.lit(True) if low is None else F.col("llr") >= F.lit(low - margin)
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict)
