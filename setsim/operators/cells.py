"""Joins of collections of large sets, in cells: pairs of chunks of sets of adjoining sizes.

A set of hundreds of tokens is too long to travel with each entry of its prefix or with each
of its candidates, and candidates grow with the square of the sets. Here sets are packed, some
2 bytes a token, and travel once for each cell that they belong to; a cell finds its candidates
and verifies them where it is, so no candidate is ever shuffled or written. Chunks are cut from
the counts of sizes, and cells whose sizes exclude each other are never made. Cells are joined
in rounds of bounded bytes, each staged before the next, so disk does not grow with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Jaccard
from ..plans.stages import stage

#: Tokens and sets of a chunk at most; a set with more tokens than that is a chunk alone.
CHUNK_TOKENS, CHUNK_SETS = 3 << 20, 12 << 10
#: Bytes of packed sets that the cells of a round shuffle.
ROUND_BYTES = 1 << 30
#: Bits per token of the signatures that bound overlaps before tokens are compared, and most words of one.
BITS_PER_TOKEN, MOST_WORDS = 6, 64
#: Probes and visited entries that are held at once, and candidates where all pairs are.
PROBES, VISITS, CANDIDATES = 32, 1 << 21, 1 << 15
#: Universes beyond this have a cell's tokens numbered anew.
MOST_MARKS = 1 << 26


class Method(NamedTuple):
    """How a cell finds candidates: by prefixes or all pairs, with the position filter, with signatures of so many bits; and how many of a probe's are listed at once."""

    prefixes: bool = True
    positional: bool = False
    bits: int = 0
    entries: int = 1 << 20


class Sets(NamedTuple):
    """Sets in the order of (size, id), with their tokens behind one another."""

    ids: np.ndarray
    flags: np.ndarray
    n: np.ndarray
    starts: np.ndarray
    tokens: np.ndarray


# bounds, in the same order of operations as functions.similarity.Jaccard


def min_size(t: float, n: np.ndarray) -> np.ndarray:
    return np.ceil(t * n.astype(np.float64)).astype(np.int64)


def min_overlap(t: float, a: np.ndarray | np.int64, b: np.ndarray) -> np.ndarray:
    raw = np.ceil((a.astype(np.float64) + b.astype(np.float64)) * t / (1.0 + t)).astype(np.int64)
    return np.minimum(np.minimum(a, b), raw)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all spans behind one another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


# packing


def pack(ids: np.ndarray, flags: np.ndarray, n: np.ndarray, tokens: np.ndarray) -> tuple[bytes, int]:
    """Sets as compressed bytes, tokens as steps within a set, byte by byte; and how many bytes they were."""
    steps = np.diff(tokens, prepend=0)
    at = np.cumsum(n) - n
    steps[at] = tokens[at]
    parts = [np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T) for x in (ids, n, steps)]
    raw = b"".join([flags.astype(np.uint8).tobytes(), *(p.tobytes() for p in parts)])
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def unpack(sets: int, size: int, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(packed, size, codec="zstd", asbytes=True), np.uint8)
    number = lambda part: np.ascontiguousarray(part.reshape(8, -1).T).view("<i8").ravel()
    ids, n, steps = number(raw[sets : 9 * sets]), number(raw[9 * sets : 17 * sets]), number(raw[17 * sets :])
    sums, at = np.cumsum(steps), np.cumsum(n) - n
    return ids, raw[:sets], n, sums - np.repeat(sums[at] - steps[at], n)


def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, sets, size, packed) of a batch's sets, one for each chunk."""
    for b in batches:
        if not b.num_rows:
            continue
        chunk, ids, flags, n = (b.column(k).to_numpy(zero_copy_only=False) for k in ("chunk", "set_id", "flags", "n"))
        starts, tokens = np.cumsum(n.astype(np.int64)) - n, b.column("tokens").flatten().to_numpy(zero_copy_only=False)
        out = []
        for c in np.unique(chunk):
            at = np.flatnonzero(chunk == c)
            out.append((int(c), len(at), *pack(ids[at], flags[at], n[at], tokens[spans(starts[at], n[at])])[::-1]))
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["chunk", "sets", "size", "packed"])


def gathered(rows: list[tuple[int, int, bytes]]) -> Sets:
    ids, flags, n, tokens = (np.concatenate(x) for x in zip(*(unpack(*r) for r in rows), strict=True))
    starts, order = np.cumsum(n) - n, np.lexsort((ids, n))
    return Sets(ids[order], flags[order], n[order], np.cumsum(n[order]) - n[order], tokens[spans(starts[order], n[order])])


# within a cell


def signatures(sets: Sets, words: int) -> np.ndarray:
    """Parity signatures, a column of words for each set."""
    bit = sets.tokens % (64 * words)
    out = np.zeros(len(sets.n) * words, np.uint64)
    np.bitwise_xor.at(out, np.repeat(np.arange(len(sets.n)) * words, sets.n) + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
    return np.ascontiguousarray(out.reshape(-1, words).T)


def apart(a: np.ndarray, b: np.ndarray, p: int, c: np.ndarray | slice) -> np.ndarray:
    """Differing bits of one set's signature and others'."""
    return np.bitwise_count(a[:, p, None] ^ b[:, c]).sum(0, dtype=np.uint16)


def prefixes(sets: Sets, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, positions and tokens of the leading tokens of all sets."""
    row = np.repeat(np.arange(len(length)), length)
    pos = spans(np.zeros(len(length), np.int64), length)
    return row, pos, sets.tokens[sets.starts[row] + pos]


class Cell:
    """A pair of chunks: each probe is compared with the sets from its least size on, up to itself where both chunks are one."""

    def __init__(self, one: Sets, two: Sets, same: bool, t: float, how: Method) -> None:
        most = max(one.tokens.max(initial=0), two.tokens.max(initial=0))
        if most >= MOST_MARKS or min(one.tokens.min(initial=0), two.tokens.min(initial=0)) < 0:
            known, number = np.unique(np.concatenate([one.tokens, two.tokens]), return_inverse=True)
            one, two, most = one._replace(tokens=number[: len(one.tokens)]), two._replace(tokens=number[len(one.tokens) :]), len(known) - 1
        self.one, self.two, self.universe, self.t, self.how = one, two, int(most) + 1, t, how
        self.first = np.searchsorted(two.n, min_size(t, one.n))
        self.last = np.arange(len(one.n)) if same else np.full(len(one.n), len(two.n))
        mean = (len(one.tokens) + len(two.tokens)) / (len(one.n) + len(two.n))
        self.wide = int(min(MOST_WORDS, max(1, -(-mean * BITS_PER_TOKEN // 64))))
        half = -(-self.wide * 5 // 9)
        a, b = signatures(one, self.wide), signatures(two, self.wide)
        # most pairs are too far apart by a little more than half of the words
        self.bounds = [(a[:half], b[:half]), (a[half:], b[half:])]
        self.asked = [signatures(sets, -(-how.bits // 64)) for sets in (one, two)] if how.bits else None

    def within(self, p: int, c: np.ndarray | slice) -> np.ndarray:
        """The candidates of a probe that may share enough tokens by their signatures."""
        n1, n2 = self.one.n[p], self.two.n[c]
        most = n1 + n2 - 2 * min_overlap(self.t, n1, n2)
        rows = np.arange(c.start, c.stop) if isinstance(c, slice) else c
        if self.asked:
            near = np.flatnonzero(apart(*self.asked, p, c) <= most)
            if len(near) < len(rows):
                c, rows, most = rows[near], rows[near], most[near]
        so_far: np.ndarray | int = 0
        for bound in self.bounds:
            so_far = so_far + apart(*bound, p, c)
            near = np.flatnonzero(so_far <= most)
            c, rows, most, so_far = rows[near], rows[near], most[near], so_far[near]
        return rows

    def all_pairs(self) -> Iterator[tuple[int, slice]]:
        """Every pair that the length filter leaves."""
        for p in np.flatnonzero(self.last > self.first):
            for at in range(self.first[p], self.last[p], CANDIDATES):
                yield p, slice(at, min(at + CANDIDATES, self.last[p]))

    def meetings(self) -> Iterator[tuple[int, np.ndarray]]:
        """Distinct pairs whose prefixes meet, by an inverted index of the indexed sets' prefixes."""
        one, two, t = self.one, self.two, self.t
        width = len(two.n)
        row, pos, token = prefixes(two, np.minimum(two.n, two.n - min_overlap(t, two.n, two.n) + 1))
        known, number = np.unique(token, return_inverse=True)
        numbers = np.full(self.universe, -1, np.int64)
        numbers[known] = np.arange(len(known))
        order = np.argsort(number * width + row, kind="stable")
        lists, row, pos = (number * width + row)[order], row[order], pos[order]
        length = np.where(self.last > self.first, np.minimum(one.n, one.n - min_size(t, one.n) + 1), 0)
        for begin in range(0, len(one.n), PROBES):
            here = length.copy()
            here[:begin] = 0
            here[begin + PROBES :] = 0
            p, p_pos, p_token = prefixes(one, here)
            k = numbers[p_token]
            found = k >= 0
            p, p_pos, k = p[found], p_pos[found], k[found]
            start, end = np.searchsorted(lists, k * width + self.first[p]), np.searchsorted(lists, k * width + self.last[p])
            met = np.zeros(PROBES * width, bool)
            size = np.maximum(end - start, 0)
            cuts = np.searchsorted(np.cumsum(size), np.arange(VISITS, size.sum() + VISITS, VISITS), side="right")
            for a, z in zip([0, *cuts], [*cuts, len(size)], strict=True):
                if a == z:
                    continue
                at, whose = spans(start[a:z], size[a:z]), np.repeat(np.arange(a, z), size[a:z])
                if self.how.positional:
                    n1, n2 = one.n[p[whose]], two.n[row[at]]
                    kept = min_overlap(t, n1, n2) <= np.minimum(n1 - p_pos[whose], n2 - pos[at])
                    at, whose = at[kept], whose[kept]
                met[(p[whose] - begin) * width + row[at]] = True
            for p, found in enumerate(met.reshape(PROBES, width)):
                if found.any():
                    yield begin + p, np.flatnonzero(found)

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """Rows of similar sets; a probe's candidates are verified in lists of bounded length."""
        one, two = self.one, self.two
        if not len(one.n) or not len(two.n):
            return
        mark = np.zeros(self.universe, bool)
        for p, c in self.meetings() if self.how.prefixes else self.all_pairs():
            c = self.within(p, c)
            if not len(c):
                continue
            own = one.tokens[one.starts[p] : one.starts[p] + one.n[p]]
            mark[own] = True
            for at in range(0, len(c), self.how.entries):
                yield p, self.verified(p, c[at : at + self.how.entries], mark)
            mark[own] = False

    def verified(self, probe: int, c: np.ndarray, mark: np.ndarray) -> np.ndarray:
        n = self.two.n[c]
        shared = np.add.reduceat(mark[self.two.tokens[spans(self.two.starts[c], n)]], np.cumsum(n) - n, dtype=np.int64)
        return c[shared >= min_overlap(self.t, self.one.n[probe], n)]


def joined(group: pa.Table, t: float, how: Method) -> pa.Table:
    """The similar pairs of one cell, from its packed rows."""
    chunk, probing, sets, size, packed = (group.column(k).to_pylist() for k in ("chunk", "probing", "sets", "size", "packed"))
    one = gathered([r for r, side in zip(zip(sets, size, packed, strict=True), probing, strict=True) if side])
    two = gathered([r for r, side in zip(zip(sets, size, packed, strict=True), probing, strict=True) if not side])
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for p, c in Cell(one, two, len(set(chunk)) == 1, t, how).pairs():
        # of equal sizes the larger id is the probe, whichever chunk it is in
        swapped = (one.n[p] == two.n[c]) & (one.ids[p] < two.ids[c])
        asks = np.where(swapped, two.flags[c], one.flags[p]) & 1 > 0
        answers = np.where(swapped, one.flags[p], two.flags[c]) & 2 > 0
        found, x, y = asks & answers, np.where(swapped, two.ids[c], one.ids[p]), np.where(swapped, one.ids[p], two.ids[c])
        out.append((x[found], y[found]))
    return pa.table({"id1": np.concatenate([x for x, _ in out]), "id2": np.concatenate([y for _, y in out])})


# chunks and rounds


class Chunk(NamedTuple):
    """Sets of sizes from least to most; of one size with very many sets, one slice of them."""

    least: int
    most: int


def cut(sizes: list[tuple[int, int]]) -> tuple[list[Chunk], list[tuple[int, int, int]]]:
    """Chunks of (size, sets) in ascending order, and for each size its first chunk and the number of its slices."""
    chunks: list[Chunk] = []
    of: list[tuple[int, int, int]] = []
    tokens = sets = 0
    for n, k in sizes:
        slices = max(-(-n * k // CHUNK_TOKENS), -(-k // CHUNK_SETS))
        if slices > 1:
            slices = min(slices, k)
            of.append((n, len(chunks), slices))
            chunks += [Chunk(n, n)] * slices
            tokens = CHUNK_TOKENS + 1
        elif chunks and tokens + n * k <= CHUNK_TOKENS and sets + k <= CHUNK_SETS:
            chunks[-1] = Chunk(chunks[-1].least, n)
            of.append((n, len(chunks) - 1, 1))
            tokens, sets = tokens + n * k, sets + k
        else:
            of.append((n, len(chunks), 1))
            chunks.append(Chunk(n, n))
            tokens, sets = n * k, k
    return chunks, of


def rounds(chunks: list[Chunk], size: dict[int, int], t: float) -> Iterator[list[tuple[int, int]]]:
    """Cells (probes' chunk, indexed chunk) that may hold similar sets, as many together as may be shuffled at once."""
    here: list[tuple[int, int]] = []
    total = 0
    for p, one in enumerate(chunks):
        least = int(min_size(t, np.array([one.least]))[0])
        for i in range(p, -1, -1):
            if chunks[i].most < least:
                break
            took = size.get(p, 0) + size.get(i, 0)
            if here and total + took > ROUND_BYTES:
                yield here
                here, total = [], 0
            here.append((p, i))
            total += took
    if here:
        yield here


def cell_join(collection: DataFrame, measure: Jaccard, how: Method) -> DataFrame:
    """The similar pairs (id1, id2) of a collection; columns `probing` and `indexed` say which sets do so, as for other joins."""
    spark, t = collection.sparkSession, float(measure.threshold)
    sizes = sorted((int(n), k) for n, k in collection.groupBy("n").agg(F.count("*")).collect())  # different sizes, not sets
    chunks, of = cut(sizes)
    if not chunks:
        return collection.select(F.col("set_id").alias("id1"), F.col("set_id").alias("id2"))
    side = lambda c, bit: F.when(F.col(c), F.lit(bit)).otherwise(F.lit(0)) if c in collection.columns else F.lit(bit)
    dealt = collection.join(F.broadcast(spark.createDataFrame(of, "n int, first_chunk long, slices long")), "n")
    chunk = F.col("first_chunk") + F.pmod(F.xxhash64("set_id"), F.col("slices"))
    rows = dealt.select(chunk.alias("chunk"), "set_id", (side("probing", 1) + side("indexed", 2)).cast("tinyint").alias("flags"), F.col("n").cast("long").alias("n"), "tokens")
    packed = stage(rows.mapInArrow(packed_rows, "chunk long, sets long, size long, packed binary"), "packed")
    size = {c: b for c, b in packed.groupBy("chunk").agg(F.sum(F.length("packed"))).collect()}

    def join_cell(group: pa.Table) -> pa.Table:
        return joined(group, t, how)

    out: DataFrame | None = None
    every = list(rounds(chunks, size, t))
    for cells in every:
        places = [(k, c, role == 0) for k, pair in enumerate(cells) for role, c in enumerate(pair)]
        sent = packed.join(F.broadcast(spark.createDataFrame(places, "cell long, chunk long, probing boolean")), "chunk").repartition(min(len(cells), 2048), "cell")
        pairs = sent.groupBy("cell").applyInArrow(join_cell, "id1 long, id2 long")
        if len(every) > 1:
            pairs = stage(pairs, "cell-pairs")
        out = pairs if out is None else out.unionByName(pairs)
    return out
