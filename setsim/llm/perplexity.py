"""Quality classifier: perplexity under an interpolated modified Kneser-Ney bigram model.

The model is fitted to half of all trusted documents, without a bound. Its counts are joined
in shards: bigrams by n-gram, their contexts' totals and numbers of continuations, and the
numbers of different words before a word. Documents are scored by sharded joins with these
counts: a chunk of documents asks the shards for its different words and bigrams (see
shards.py), and neither the model nor a text is ever in one place.

A document's surprise is divided by its number of tokens, for its perplexity, and by its
number of different bigrams, for its type perplexity. The first is high in texts of other
words, the second also in texts that say one thing again and again. A document is rejected
if either lies above a quantile of the other half of the trusted documents in its own language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shards import ANSWER, BEGIN, END, REPLY, address, ask, asked, gathered, n_shards, packed_counts, replies, texts, xor
from .shared import KEY, discard, exact_quantiles, halved, row_key, trusted_ids, written
from .words import U64, blocks, words

#: Quantile of the trusted perplexities of either kind, and the factor above it, beyond which a text is rejected.
HIGH_QUANTILE, SLACK = 0.995, 1.1
#: Passes over the documents, each of which asks for an equal part of the chunks.
PASSES = 3
#: Trusted documents of a language from which it has quantiles of its own.
LEAST_JUDGED = 30
#: Texts of fewer words say too little and are kept.
MIN_WORDS = 5


def bigram_counts(docs: DataFrame, text: str) -> DataFrame:
    """Counts (u long, w long, c long) of adjacent tokens, summed within each block before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(text)):
                w = words(block)
                last = np.cumsum(w.counts + 1) - 1
                token = np.empty(len(w.hashes) + block.n, dtype=U64)
                is_end = np.zeros(len(token), dtype=bool)
                is_end[last] = True
                token[is_end], token[~is_end] = END, w.hashes
                u = np.concatenate((token[:1], token[:-1]))
                u[last - w.counts] = BEGIN
                order = np.lexsort((token, u))
                u, t = u[order], token[order]
                head = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (t[1:] != t[:-1]))))
                c = np.diff(np.concatenate((head, [len(u)])))
                yield pa.RecordBatch.from_arrays([pa.array(u[head].view(np.int64)), pa.array(t[head].view(np.int64)), pa.array(c.astype(np.int64))], names=["u", "w", "c"])

    return docs.select(text).mapInArrow(run, "u long, w long, c long").groupBy("u", "w").agg(F.sum("c").alias("c"))


def discounts(n: list[int]) -> list[float]:
    """Chen and Goodman's three discounts from the numbers of n-grams seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (max(x, 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    return [min(max(k + 1 - (k + 1) * y * b / a, 0.05), k + 0.95) for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)))]


ENTRY = "shard int, key long, a long, total long, n1 long, n2 long, n3 long"


def addressed(entries: DataFrame, shards: int, pairs: bool) -> DataFrame:
    """Model entries with the shard and the key that chunks ask for them by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column("w").to_numpy().view(U64)
            shard, key = address(w, shards, b.column("u").to_numpy().view(U64) if pairs else None)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(key.view(np.int64)), *(b.column(c) for c in ("a", "total", "n1", "n2", "n3"))], names=["shard", "key", "a", "total", "n1", "n2", "n3"])

    return entries.mapInArrow(run, ENTRY)


class Model:
    """Discounts and sums of the whole model; its counts stay in `entries`, by shard."""

    def __init__(self, docs: DataFrame, text: str, shards: int) -> None:
        grams = written(bigram_counts(docs, text), "bigrams")
        seen = lambda col: [F.sum((F.col(col) == k).cast("long")) for k in (1, 2, 3, 4)]
        self.high = discounts([x or 0 for x in grams.agg(*seen("c")).first()])
        many = lambda col, low: F.sum((F.col(col) >= low).cast("long") if low > 2 else (F.col(col) == low).cast("long"))
        contexts = grams.groupBy(F.col("u").alias("w")).agg(F.sum("c").alias("total"), *(many("c", k).alias(f"n{k}") for k in (1, 2, 3)))
        before = written(grams.groupBy("w").agg(F.count("*").alias("a")), "before")
        self.low = discounts([x or 0 for x in before.agg(*seen("a")).first()])
        sums = before.agg(F.sum("a"), F.count("*"), *(many("a", k) for k in (1, 2, 3))).first()
        self.all, n_words, freed = max(sums[0] or 0, 1), sums[1], sum(d * (x or 0) for d, x in zip(self.low, sums[2:]))
        self.floor = freed / self.all / (n_words + 1) if n_words else 1.0
        one = contexts.join(before, "w", "full").select("w", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("a", "total", "n1", "n2", "n3")))
        two = grams.select("u", "w", F.col("c").alias("a"), *(F.lit(0).cast("long").alias(c) for c in ("total", "n1", "n2", "n3")))
        self.entries = written(addressed(one, shards, False).union(addressed(two, shards, True)), "model")
        discard(grams, before)

    def numbers(self) -> tuple[list[float], list[float], int, float]:
        return self.high, self.low, self.all, self.floor


def answer(requests: pa.Table, entries: pa.Table) -> pa.Table:
    """A shard's counts for each chunk that asks: one for each key, and four more for each word."""
    if not requests.num_rows:
        return replies([])
    key = entries.column("key").to_numpy().view(U64)
    by = np.argsort(key)
    key, columns = key[by], [entries.column(c).to_numpy()[by] for c in ("a", "total", "n1", "n2", "n3")]
    keys, sizes = asked(requests)
    rows, at, shard = [], 0, requests.column("shard")[0].as_py()
    for number, size in zip(requests.column("chunk").to_pylist(), sizes):
        own = keys[at : at + size]
        k = np.minimum(np.searchsorted(key, own), max(len(key) - 1, 0))
        hit = key[k] == own if len(key) else np.zeros(size, dtype=bool)
        first = np.where(hit, columns[0][k], 0) if len(key) else np.zeros(size, dtype=np.int64)
        word = own & U64(1) == 1
        more = np.stack([np.where(hit[word], c[k[word]], 0) for c in columns[1:]], axis=1) if len(key) else np.zeros((int(word.sum()), 4), dtype=np.int64)
        rows.append((ANSWER, shard, number, xor(own), 0, 0, packed_counts(np.concatenate((first, more.ravel())))))
        at += size
    return replies(rows)


def perplexities(table: pa.Table, shards: int, numbers: tuple) -> pa.Table:
    """A chunk's rows with the number of words, and the perplexities over words and one end token."""
    high, low, total, floor = numbers
    c, (_, pairs), (before, count), more = gathered(table, 2, shards, 4)
    cut = lambda x, d: np.where(x == 0, 0.0, np.array([0.0, *d])[np.minimum(x, 3)])
    p1 = (before - cut(before, low)) / total + floor
    context = np.maximum(more[:, 0], 1)
    back = np.where(more[:, 0] > 0, more[:, 1:] @ np.array(high) / context, 1.0)
    p2 = (count - cut(count, high)) / context[pairs.context] + back[pairs.context] * p1[pairs.word]
    doc = np.repeat(np.arange(len(c.n)), c.n)
    logs = np.bincount(doc, weights=np.log(p2)[pairs.place], minlength=len(c.n))
    types = np.bincount(np.unique(doc * len(p2) + pairs.place) // len(p2), minlength=len(c.n))
    return pa.table({"row": c.rows, "n_words": pa.array(c.n - 1), "perplexity": pa.array(np.exp(-logs / c.n)), "type_perplexity": pa.array(np.exp(np.minimum(-logs / types, 700.0)))})


def scored(docs: DataFrame, model: Model, shards: int, passes: int = PASSES) -> DataFrame:
    """Perplexities of docs (row struct, text): row, n_words, perplexity, type_perplexity.

    Requests are larger than the texts' files, so chunks are handled in passes; each frees
    its requests and answers before the next.
    """
    numbers, row = model.numbers(), docs.schema["row"].dataType.simpleString()
    out: DataFrame | None = None
    for k in range(passes):
        both = ask(docs, 2, shards, part=(k, passes)).groupBy("shard").cogroup(model.entries.groupBy("shard"))
        replied = written(both.applyInArrow(answer, REPLY), "answers")
        every = texts(docs, part=(k, passes)).unionByName(replied.select("kind", "shard", "chunk", "check", "answer"), allowMissingColumns=True)
        done = written(every.groupBy("chunk").applyInArrow(lambda t: perplexities(t, shards, numbers), f"row {row}, n_words long, perplexity double, type_perplexity double"), "scored")
        discard(replied)
        out = done if out is None else out.union(done)
    return out


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", high_quantile: float = HIGH_QUANTILE, slack: float = SLACK, min_words: int = MIN_WORDS, shards: int | None = None) -> DataFrame:
    """For each row: id_col, lang, __row_key, n_words, perplexity, threshold, type_perplexity, type_threshold, kept.

    The model is fitted to half of the trusted rows, chosen by a hash of the id, and judged
    by the other half: a language's thresholds are its high_quantile of either perplexity,
    times the slack. A language of fewer than thirty such rows (null included) takes those
    over all languages, and without any everything is kept. Texts of fewer than min_words words, null and empty ones included,
    are kept: they give no evidence. Repeated rows each get a row; an empty table gives none;
    columns not named are ignored. The input must give the same rows in the same order to
    each read, as files do.
    """
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.col(lang).cast("string").alias("lang"), row_key(id_col, lang, text).alias("key")).alias("row"), F.col(text).alias("text"))
    n = shards or n_shards(rows)
    trusted = written(trusted_ids(labels, id_col).withColumnRenamed(id_col, "trusted_id"), "trusted")
    fitted, judged = halved(trusted, "trusted_id")
    model = Model(rows.join(fitted, F.col("row.id") == F.col("trusted_id"), "left_semi"), "text", n)
    found = scored(rows, model, n)
    discard(model.entries)
    kinds = ["perplexity", "type_perplexity"]
    base = written(found.where(F.col("n_words") >= min_words).join(judged, F.col("row.id") == F.col("trusted_id"), "left_semi").select(F.col("row.lang").alias("lang"), *kinds), "judged")
    enough = base.groupBy("lang").count().where(F.col("lang").isNotNull() & (F.col("count") >= LEAST_JUDGED)).select("lang")
    judged_langs = [r["lang"] for r in enough.collect()]  # languages, some hundreds
    high = [exact_quantiles(base, c, [high_quantile], "lang") for c in kinds]
    discard(base, trusted)
    bands = docs.sparkSession.createDataFrame([(g, *(q[g][0] for q in high)) for g in judged_langs], "lang string, t1 double, t2 double")
    out = found.select(F.col("row.id").alias(id_col), F.col("row.lang").alias("lang"), F.col("row.key").alias(KEY), "n_words", *kinds).join(F.broadcast(bands), "lang", "left")
    limit = [F.coalesce(t, F.lit(q.get(None, [None])[0]).cast("double")) * slack for t, q in zip(("t1", "t2"), high)]
    out = out.select(id_col, "lang", KEY, "n_words", "perplexity", limit[0].alias("threshold"), "type_perplexity", limit[1].alias("type_threshold"))
    fits = (F.col("perplexity") <= F.col("threshold")) & (F.col("type_perplexity") <= F.col("type_threshold"))
    return out.withColumn("kept", F.coalesce(fits, F.lit(True)) | (F.col("n_words") < min_words))
