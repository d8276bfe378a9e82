"""Benchmark decontamination by a distributed positional inverted index.

Documents are dealt into shards of about a megabyte. For each shard and query term the
index stores the term's postings: ascending (document, position) numbers in one row. A
phrase is looked up in each shard by its rarest term there; the other terms' lists, moved
back by their offsets, are intersected with it one by one, from rare to common, until the
list is empty or the phrase is found. Documents never cross shards, so a shard's answer
is complete, and the work is spread by size, whatever terms or passages are common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import KEY, row_key, written
from .words import ALNUM, blocks, hash_words, words

#: Query phrases handled in one pass over the documents; more take more passes.
MAX_PHRASES = 100_000
SHIFT = 32
#: Text of one shard; a longer document is a shard of its own.
SHARD_BYTES = 1 << 20


class Phrases:
    """One block of the query set: phrases as term numbers, and the items each stands for."""

    def __init__(self) -> None:
        self.items: dict[tuple[int, ...], list[str]] = {}
        self.size = 0

    def add(self, item: str, hashes: np.ndarray, window: int) -> None:
        n = len(hashes)
        for k in range(max(1, n - window + 1) if n else 0):
            owners = self.items.setdefault(tuple(hashes[k : k + window].tolist()), [])
            if not owners or owners[-1] != item:
                owners.append(item)
                self.size += 1

    def finish(self) -> "Phrases":
        self.terms = np.unique(np.array([h for p in self.items for h in p], dtype=np.uint64))
        place = {int(h): k for k, h in enumerate(self.terms)}
        by_length: dict[int, tuple[list, list]] = {}
        for p, owners in self.items.items():
            rows, names = by_length.setdefault(len(p), ([], []))
            rows.append([place[h] for h in p])
            names.append(owners)
        self.groups = [(np.array(rows, dtype=np.int64), names) for rows, names in by_length.values()]
        self.items = {}
        return self


def query_blocks(items: DataFrame, id_col: str, text: str, window: int, most: int) -> Iterator[Phrases]:
    """Streams the query set to the driver and cuts it into blocks of a bounded number of phrases."""
    block = Phrases()
    for row in items.select(F.col(id_col).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        (hashes,) = hash_words([row["t"]], ALNUM) or [np.zeros(0, np.uint64)]
        block.add(row["i"] or "", hashes, window)
        if block.size >= most:
            yield block.finish()
            block = Phrases()
    yield block.finish()


def build_index(docs: DataFrame, terms: np.ndarray, text: str = "text") -> DataFrame:
    """Postings of the given terms (sorted 64-bit word hashes) over whole texts, by shard.

    Returns rows (shard, term, n, postings binary) and for each shard one row of term -1
    whose postings are the documents' word counts and whose `docs` holds the other columns.
    """
    rest = [c for c in docs.columns if c != text]
    kept = T.StructType([docs.schema[c] for c in rest])
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("term", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("postings", T.BinaryType()), T.StructField("docs", T.ArrayType(kept))])
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << SHIFT
        terms = known.value
        for b in batches:
            rows = pa.StructArray.from_arrays([b.column(c) for c in rest], names=rest)
            for block in blocks(b.column(text), SHARD_BYTES):
                w = words(block, ALNUM)
                term = np.searchsorted(terms, w.hashes)
                hit = np.zeros(len(term), dtype=bool)
                inside = term < len(terms)
                hit[inside] = terms[term[inside]] == w.hashes[inside]
                at = np.flatnonzero(hit)
                term = term[at]
                posting = (w.doc[at] << SHIFT) | (at - w.first[w.doc[at]])
                order = np.argsort(term, kind="stable")
                term, posting = term[order], posting[order]
                cuts = np.flatnonzero(np.diff(term)) + 1
                lists = [x.tobytes() for x in np.split(posting, cuts)] if len(term) else []
                heads = term[np.concatenate(([0], cuts))].tolist() if len(term) else []
                n = len(lists) + 1
                doc_rows = pa.ListArray.from_arrays(pa.array([0, block.n] + [block.n] * (n - 1), pa.int32()), rows.slice(block.first, block.n))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, shard, dtype=np.int64)),
                        pa.array([-1, *heads], pa.int32()),
                        pa.array([block.n, *(len(x) >> 3 for x in lists)], pa.int32()),
                        pa.array([w.counts.astype(np.int64).tobytes(), *lists], pa.binary()),
                        doc_rows,
                    ],
                    names=schema.names,
                )
                shard += 1

    return docs.mapInArrow(run, schema)


def near_sorted(sorted_values: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Which wanted numbers have a value within slop of them."""
    k = np.searchsorted(sorted_values, wanted - slop)
    found = np.zeros(len(wanted), dtype=bool)
    inside = k < len(sorted_values)
    found[inside] = sorted_values[k[inside]] <= wanted[inside] + slop
    return found


def occurrences(phrase: np.ndarray, lists: dict[int, np.ndarray], slop: int) -> np.ndarray:
    """Starts from which each term lies within slop words of its place, from the rarest term on."""
    order = sorted(range(len(phrase)), key=lambda k: len(lists[phrase[k]]))
    starts = lists[phrase[order[0]]] - order[0]
    if slop:
        starts = np.unique(starts[:, None] + np.arange(-slop, slop + 1))
    for k in order[1:]:
        starts = starts[near_sorted(lists[phrase[k]] - k, starts, slop)]
        if not len(starts):
            break
    return starts


def match(index: DataFrame, phrases: Phrases, slop: int = 0) -> DataFrame:
    """Looks all phrases of a block up in every shard.

    Returns the documents' columns with n_words, spans (merged word ranges covered by exact
    occurrences), items (ids with an exact occurrence) and, where slop is positive,
    near_items (ids with a window whose words all lie within slop words of their places).
    """
    kept = index.schema["docs"].dataType.elementType
    names = kept.names
    span = pa.struct([("s", pa.int64()), ("e", pa.int64())])
    schema = T.StructType([*kept.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("near_items", T.ArrayType(T.StringType()))])
    asked = index.sparkSession.sparkContext.broadcast((len(phrases.terms), phrases.groups))

    def run(table: pa.Table) -> pa.Table:
        n_terms, groups = asked.value
        terms, postings = table.column("term").to_numpy(), table.column("postings")
        head = int(np.flatnonzero(terms == -1)[0])
        rows = table.column("docs")[head].values
        n_words = np.frombuffer(postings[head].as_py(), dtype=np.int64)
        lists = {int(t): np.frombuffer(postings[k].as_py(), dtype=np.int64) for k, t in enumerate(terms) if t >= 0}
        present = np.zeros(n_terms, dtype=bool)
        present[list(lists)] = True
        starts, ends = [], []
        exact: list[set[str]] = [set() for _ in range(len(n_words))]
        near: list[set[str]] = [set() for _ in range(len(n_words))]
        for matrix, owners in groups:
            for p in np.flatnonzero(present[matrix].all(axis=1)).tolist():
                found = occurrences(matrix[p], lists, 0)
                if len(found):
                    starts.append(found)
                    ends.append(found + matrix.shape[1])
                    for d in np.unique(found >> SHIFT).tolist():
                        exact[d].update(owners[p])
                if slop:
                    near_starts = occurrences(matrix[p], lists, slop) + slop + matrix.shape[1]  # a start may lie before its document
                    for d in np.unique(near_starts >> SHIFT).tolist():
                        near[d].update(owners[p])
        covered: list[list[dict]] = [[] for _ in range(len(n_words))]
        if starts:
            s, e = np.concatenate(starts), np.concatenate(ends)
            order = np.argsort(s, kind="stable")
            s, reach = s[order], np.maximum.accumulate(e[order])
            first = np.concatenate(([True], s[1:] > reach[:-1]))
            last = np.concatenate((np.flatnonzero(first)[1:] - 1, [len(s) - 1]))
            low = (1 << SHIFT) - 1
            for a, b in zip(s[first].tolist(), reach[last].tolist()):
                covered[a >> SHIFT].append({"s": a & low, "e": b & low})
        return pa.Table.from_arrays(
            [*(rows.field(c) for c in names), pa.array(n_words), pa.array(covered, pa.list_(span)), pa.array([sorted(x) for x in exact], pa.list_(pa.string())), pa.array([sorted(x) for x in near], pa.list_(pa.string()))],
            names=[*names, "n_words", "spans", "items", "near_items"],
        )

    return index.groupBy("shard").applyInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, slop: int = 0, most: int = MAX_PHRASES) -> DataFrame:
    """For each row: id_col, __row_key, n_words, n_hit, spans, items, near_items.

    spans are ranges of word numbers, ends exclusive, that occurrences cover.

    A null or wordless text has no words and no hits; null or wordless items have no
    windows, and a null item id counts as the empty string. Repeated documents each get a
    row; repeated items with one id count once. Columns besides those named are ignored.
    An empty benchmark leaves every document clean; empty documents give no rows.
    """
    rows = docs.select(F.col(id_col), F.col(text).alias("__text")).withColumn(KEY, row_key(id_col, "__text"))
    passes = []
    for block in query_blocks(benchmark, item_col, item_text, window, most):
        index = written(build_index(rows, block.terms, "__text"), "postings")
        passes.append(match(index, block, slop))
    found = passes[0]
    if len(passes) > 1:
        for x in passes[1:]:
            found = found.unionByName(x)
        flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
        found = found.groupBy(id_col, KEY, "n_words").agg((F.count("*") / len(passes)).cast("int").alias("times"), *(flat(c) for c in ("spans", "items", "near_items")))
        found = found.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")
    walk = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["to"], x["e"]).alias("to"), (acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(acc["to"], x["s"]))).alias("n")),
        lambda acc: acc["n"],
    )
    ordered = lambda c: F.array_sort(F.array_distinct(c)).alias(c)
    return found.select(id_col, KEY, "n_words", walk.alias("n_hit"), F.array_sort("spans").alias("spans"), ordered("items"), ordered("near_items"))
