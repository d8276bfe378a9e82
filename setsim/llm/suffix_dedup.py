"""Exact removal of long repeated byte strings by suffix arrays.

Every string of `length` bytes picks an anchor, the 32-byte gram in it with the least
hash, so equal strings pick the same gram at the same place. Neighbouring strings with the
same anchor form a segment. Strings can only be equal if their segments share the anchor's
hash, which deals the work out and drops text whose anchors occur once:

1. Segments that are equal as a whole are repeats; counting them needs no comparison.
2. Different segments around one anchor go to a shard. A suffix array of the shard's
   segments (Larsson-Sadakane refinement: ranks of prefixes double in length, only groups
   that are still tied are sorted again) and Kasai's common prefixes give the strings that
   occur twice.
3. An anchor with very many different segments is dealt to several shards. They are merged
   by binary search: each sends the sorted digests of its different strings, cut by
   digest, and each range's lists are looked up in one another.

No step holds more than a shard or a document; equal segments are combined before any
shuffle, so a passage found in a third of all documents costs one comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import KEY, MAX_BROADCAST_KEYS, row_key, written
from .words import U64, blocks, prefix_sums, range_hashes

LENGTH = 400
GRAM = 32
POSITION_BITS = 31
SHARD_SEGMENTS = 4000
#: Different segments of one anchor beyond which they are dealt to several shards.
HOT_SEGMENTS = 1000
SEPARATOR = 0xFF


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from running minima within blocks of w."""
    n = len(x)
    padded = np.concatenate((x, np.full(-n % w, np.iinfo(x.dtype).max, dtype=x.dtype))).reshape(-1, w)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def segments(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Segments of a block of texts: text number, first and last string start, anchor and digest."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
    if len(data) < length:
        return none
    gram = min(GRAM, length)
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    hashes = range_hashes(sums, at, at + gram)
    top = U64((1 << POSITION_BITS) - 1)
    key = ((hashes >> U64(POSITION_BITS)) << U64(POSITION_BITS)) | (top - at.astype(U64))  # of equal grams the last wins
    least = sliding_min(key, length - gram + 1)
    anchor = (top - (least & top)).astype(np.int64)
    doc = np.searchsorted(bounds, np.arange(len(anchor)), side="right") - 1
    whole = np.arange(len(anchor)) + length <= bounds[doc + 1]
    change = np.ones(len(anchor), dtype=bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(change & whole)
    if not len(first):
        return none
    ends = np.flatnonzero(whole & np.append(change[1:] | ~whole[1:], True))
    raw = data.tobytes()
    digest = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:z]) for a, z in zip(first.tolist(), (ends + length).tolist())), dtype=U64, count=len(first))
    return doc[first], first, ends, hashes[anchor[first]], digest


def segment_table(rows: DataFrame, text: str, length: int) -> DataFrame:
    """All segments (__row_key, first, last, anchor, digest); starts count bytes from the text's own."""
    names = [KEY, "first", "last", "anchor", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(KEY)
            for block in blocks(b.column(text)):
                doc, first, last, anchor, digest = segments(block.data, block.bounds, length)
                base = block.bounds[doc]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(block.first + doc)), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64))], names=names
                )

    return rows.select(KEY, text).mapInArrow(run, f"{KEY} struct<a:long,b:long>, first int, last int, anchor long, digest long")


def suffix_array(data: np.ndarray, depth: int = 1 << 62) -> np.ndarray:
    """Suffix order by Larsson-Sadakane refinement, up to `depth` leading bytes."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(U64)
    key = np.zeros(n, dtype=U64)
    for k in range(8):
        key = (key << U64(8)) | padded[k : k + n]
    # An end sorts before any byte: the ranks of doubled prefixes tell short suffixes apart.
    order = np.argsort(key, kind="stable")
    head = np.ones(n, dtype=bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.zeros(n + 1, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    h = 8
    while h < depth:
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)
        if not len(at) or h >= n:
            break
        suffix = order[at]
        second = rank[np.minimum(suffix + h, n)]
        both = rank[suffix] * (n + 1) + second
        by = np.argsort(both, kind="stable")
        order[at] = suffix[by]
        both = both[by]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = both[1:] != both[:-1]
        head[at] = fresh
        rank[order[at]] = np.maximum.accumulate(np.where(fresh, at, 0)) + 1
        h *= 2
    if h >= n and not head.all():  # only zero bytes at the very end can still tie with the padding
        at = np.flatnonzero(~head | np.append(~head[1:], False))
        order[at] = order[at][np.lexsort((-order[at], rank[order[at]]))]
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai's lengths: for each place in the order, the prefix shared with the suffix before it.

    In text order a length is at least the one before less one, and exactly that where both
    suffixes follow equal bytes. So bytes are only compared where they do not, eight at a
    time for all such suffixes at once, and the others follow from a running maximum.
    """
    n = len(data)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    start = (before <= 0) | (i == 0)
    rest = np.flatnonzero(~start)
    start[rest] = data[rest - 1] != data[before[rest] - 1]
    start &= before >= 0
    at = np.flatnonzero(start)
    shared = np.zeros(n, dtype=np.int64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words8 = np.ndarray((n + 1,), dtype="<u8", buffer=padded.tobytes(), strides=(1,))
    live, reach = at, np.zeros(len(at), dtype=np.int64)
    while len(live):
        a, b = live + reach, before[live] + reach
        left = n - np.maximum(a, b)
        diff = words8[np.minimum(a, n)] ^ words8[np.minimum(b, n)]
        same = np.where(diff == 0, 8, 0)
        unequal = diff != 0
        low = diff[unequal] & (~diff[unequal] + U64(1))
        same[unequal] = np.bitwise_count(low - U64(1)) // 8
        step = np.minimum(same, left)
        reach = reach + step
        shared[live] = reach
        on = (step == 8) & (left > 8)
        live, reach = live[on], reach[on]
    out = np.maximum.accumulate(np.where(start, shared + i, 0)) - i
    out = np.where(before >= 0, np.maximum(out, 0), 0)
    lcp = np.zeros(n, dtype=np.int64)
    lcp[1:] = out[order[1:]]
    return lcp


def runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def shard_strings(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All strings of a shard's segments: segment number, start in it, class, size of the class, joined bytes.

    Classes are numbered; strings are equal exactly if their classes are.
    """
    joined = np.frombuffer(bytes([SEPARATOR]).join(pieces), dtype=np.uint8)
    order = suffix_array(joined)
    classes = np.empty(len(joined), dtype=np.int64)
    classes[order] = np.cumsum(common_prefixes(joined, order) < length)
    sizes = np.array([len(p) for p in pieces])
    starts = np.concatenate(([0], np.cumsum(sizes[:-1] + 1)))
    n = sizes - length + 1
    piece = np.repeat(np.arange(len(pieces)), n)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    found = classes[starts[piece] + offset]
    _, inverse, count = np.unique(found, return_inverse=True, return_counts=True)
    return piece, offset, inverse, count, joined


SHARD_SCHEMA = "shard long, anchor long, digest long, runs array<struct<a:int,b:int>>, part int, w1 binary, w2 binary, members binary"


def look_within(pieces: pa.Table, length: int, n_parts: int) -> Iterator[dict]:
    """Repeats within a shard, and of hot anchors the digests to be looked for in others."""
    seen: dict[tuple[int, int], int] = {}
    rows = pieces.to_pylist()
    rows = [r for k, r in enumerate(rows) if seen.setdefault((r["anchor"], r["digest"]), k) == k]
    piece, offset, kind, count, joined = shard_strings([r["bytes"] for r in rows], length)
    marked = count[kind] > 1
    cuts = np.searchsorted(piece, np.arange(len(rows) + 1))
    for k, r in enumerate(rows):
        if not r["whole"]:
            found = runs(marked[cuts[k] : cuts[k + 1]])
            if found:
                yield {"shard": r["shard"], "anchor": r["anchor"], "digest": r["digest"], "runs": [{"a": a, "b": b} for a, b in found]}
    hot = np.array([r["hot"] for r in rows], dtype=bool)[piece]
    if not hot.any():
        return
    # One member of each class goes to the others; of a class that is marked it only stands for itself.
    at = np.flatnonzero(hot)
    at = at[np.unique(kind[at], return_index=True)[1]]
    sums = prefix_sums(joined)
    sizes = np.array([len(r["bytes"]) for r in rows])
    start = np.concatenate(([0], np.cumsum(sizes[:-1] + 1)))[piece[at]] + offset[at]
    w1 = range_hashes(sums, start, start + length)
    raw = joined.tobytes()
    w2 = np.fromiter((xxhash.xxh3_64_intdigest(raw[s : s + length]) for s in start.tolist()), dtype=U64, count=len(start))
    whole = np.array([r["whole"] for r in rows], dtype=bool)[piece[at]] | marked[at]
    anchor, digest = (np.array([r[c] for r in rows], dtype=np.int64)[piece[at]] for c in ("anchor", "digest"))
    members = np.stack((anchor, digest, np.where(whole, -1, offset[at])), axis=1)
    part = (w1 % U64(n_parts)).astype(np.int64)
    by_part = np.lexsort((w1, part))
    for mine in np.split(by_part, np.flatnonzero(np.diff(part[by_part])) + 1):
        p = int(part[mine[0]])
        yield {"shard": rows[0]["shard"], "part": p, "w1": w1[mine].tobytes(), "w2": w2[mine].tobytes(), "members": members[mine].tobytes()}


def look_across(lists: pa.Table) -> Iterator[dict]:
    """Merges the shards' sorted digests of one range: a string is a repeat if any other shard's list has it."""
    got = [(np.frombuffer(r["w1"], U64), np.frombuffer(r["w2"], U64), np.frombuffer(r["members"], np.int64).reshape(-1, 3)) for r in lists.to_pylist()]
    w1, w2 = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    merged = np.lexsort((w2, w1))
    a, b = w1[merged], w2[merged]
    out: dict[tuple[int, int], list[int]] = {}
    for x, y, members in got:
        lo, hi = np.searchsorted(a, x, side="left"), np.searchsorted(a, x, side="right")
        twice = np.flatnonzero(hi - lo > 1)
        for k in twice[members[twice, 2] >= 0].tolist():
            if np.count_nonzero(b[lo[k] : hi[k]] == y[k]) > 1:
                out.setdefault((int(members[k, 0]), int(members[k, 1])), []).append(int(members[k, 2]))
    for (anchor, digest), offsets in out.items():
        yield {"anchor": anchor, "digest": digest, "runs": [{"a": o, "b": o} for o in offsets]}


def as_table(rows: Iterator[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(list(rows), schema=schema)


RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
FOUND = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("runs", RUNS)])
SHARD = pa.schema([("shard", pa.int64()), *FOUND, ("part", pa.int32()), ("w1", pa.binary()), ("w2", pa.binary()), ("members", pa.binary())])


def only_keys(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows with (left_semi) or without (left_anti) the keys; a small set spares the text a shuffle."""
    small = keys.count() <= MAX_BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if small else keys.hint("shuffle_hash"), KEY, how)


def repeated_strings(rows: DataFrame, text: str, length: int) -> DataFrame:
    """Starts of repeated strings by row key: __row_key, starts (an array of closed ranges a..b)."""
    table = written(segment_table(rows, text, length), "segments")
    shared = written(table.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "shared")  # apart, so that a hot anchor's rows can be split in the join
    table = written(table.join(shared, "anchor", "left_semi"), "candidates")
    different = table.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct(KEY, "first", "last")).alias("one"))
    different = written(different.select("anchor", "digest", (F.col("n") > 1).alias("whole"), "one.*"), "different")
    per_anchor = written(different.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1"), "anchors")
    open_ = different.join(per_anchor, "anchor").select("anchor", "digest", "whole", KEY, "first", "last", (F.col("m") > HOT_SEGMENTS).alias("hot"), F.ceil(F.col("m") / HOT_SEGMENTS).alias("salts"))
    open_ = written(open_, "open")
    n_shards = max(1, 2 * open_.count() // SHARD_SEGMENTS)
    salt = F.when(F.col("hot"), F.pmod("digest", F.col("salts"))).otherwise(0)
    wanted = open_.select(KEY, F.struct("anchor", "digest", "whole", "hot", "first", "last", F.pmod(F.xxhash64("anchor", salt), F.lit(n_shards)).alias("shard")).alias("s"))
    wanted = wanted.groupBy(KEY).agg(F.collect_list("s").alias("wanted"))  # as many as a text has segments
    holders = only_keys(rows.select(KEY, text), written(open_.select(KEY).distinct(), "holders"), "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, segs in zip(b.column(text), b.column("wanted")):
                raw = t.as_py().encode()
                out += [{k: s[k] for k in ("shard", "anchor", "digest", "whole", "hot")} | {"bytes": raw[s["first"] : s["last"] + length]} for s in segs.as_py()]
            schema = pa.schema([("shard", pa.int64()), ("anchor", pa.int64()), ("digest", pa.int64()), ("whole", pa.bool_()), ("hot", pa.bool_()), ("bytes", pa.binary())])
            yield from pa.Table.from_pylist(out, schema=schema).to_batches()

    pieces = holders.join(wanted, KEY).select(text, "wanted").mapInArrow(cut, "shard long, anchor long, digest long, whole boolean, hot boolean, bytes binary")
    n_parts = n_shards
    looked = pieces.groupBy("shard").applyInArrow(lambda t: as_table(look_within(t, length, n_parts), SHARD), SHARD_SCHEMA)
    looked = written(looked, "looked")
    found = looked.where("runs is not null").select("anchor", "digest", "runs")
    lists = looked.where("part is not null").select("part", "w1", "w2", "members")
    found = found.union(lists.groupBy("part").applyInArrow(lambda t: as_table(look_across(t), FOUND), "anchor long, digest long, runs array<struct<a:int,b:int>>"))
    found = found.groupBy("anchor", "digest").agg(F.flatten(F.collect_list("runs")).alias("runs"))  # within one segment
    verdicts = different.select("anchor", "digest", "whole").join(found, ["anchor", "digest"], "left").where("whole or runs is not null")
    verdicts = written(verdicts, "verdicts")  # apart, as above
    hits = table.join(verdicts, ["anchor", "digest"])
    whole = F.array(F.struct(F.col("first").alias("a"), F.col("last").alias("b")))
    some = F.transform("runs", lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"]).alias("b")))
    return hits.select(KEY, F.when(F.col("whole"), whole).otherwise(some).alias("starts")).groupBy(KEY).agg(F.flatten(F.collect_list("starts")).alias("starts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """Removes each byte of a string of `length` bytes that also starts elsewhere in the table.

    Returns id_col, __row_key, n_bytes, n_removed, n_spans, kept_sha256 and, where keep_text
    is set, kept (binary: a cut may fall within a character). Null counts as empty; texts
    shorter than `length` lose nothing. Repeated rows are each other's copies; all of them
    lose their repeats. An empty table gives none; other columns are ignored.
    """
    rows = docs.select(F.col(id_col), F.col(text).alias("__text")).withColumn(KEY, row_key(id_col, "__text"))
    starts = written(repeated_strings(rows, "__text", length), "starts")
    fields = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), *([("kept", "binary")] if keep_text else [])]
    schema = rows.select(F.col(id_col), KEY, *(F.lit(None).cast(t).alias(n) for n, t in fields)).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in fields]
            for t, ranges in zip(b.column("__text"), b.column("starts")):
                raw = (t.as_py() or "").encode()
                spans: list[list[int]] = []
                for r in sorted(ranges.as_py() or [], key=lambda r: r["a"]):
                    if spans and r["a"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["b"] + length)
                    else:
                        spans.append([r["a"], r["b"] + length])
                edges = [0, *(x for s in spans for x in s), len(raw)]
                left = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2]))
                for column, x in zip(out, (len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left)):
                    column.append(x)
            types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column(KEY), *(pa.array(x, types[t]) for x, (_, t) in zip(out, fields))], names=schema.names)

    marked = written(starts.select(KEY), "marked")
    clean = only_keys(rows, marked, "left_anti").withColumn("starts", F.lit(None).cast(starts.schema["starts"].dataType))
    cut_ones = only_keys(rows, marked, "left_semi").join(starts, KEY)
    both = clean.select(id_col, KEY, "__text", "starts").mapInArrow(cut, schema)
    return both.union(cut_ones.select(id_col, KEY, "__text", "starts").mapInArrow(cut, schema))
