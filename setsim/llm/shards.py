"""Chunks of documents, their n-grams, and count shards that answer for them.

A chunk is some whole documents of one task, about 3 MB. It names each different n-gram by
56 bits of a hash and asks the shard that a second, independent hash picks. Only n-grams of
one shard, a few million, could be confused, so the chance of that is some 1e-10 for an
n-gram, whatever the size of the corpus; and no word, however frequent, makes a shard large.
A chunk has one row for each shard it asks, with its keys sorted and coded as differences,
and a shard answers each in the order asked. Every n-gram of a chunk is asked for once,
whatever its number of occurrences.

Chunks are cut anew from the input whenever they are needed, so the input must give the
same rows in the same order to each read, as files do. Answers carry a checksum of what was
asked, so an input that changed is an error, never a wrong result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, blocks, combine, mix, words

BEGIN, END = U64(0x0123456789ABCDEF), U64(0xFEDCBA9876543210)
CHUNK_BYTES = 3 << 20
#: Input bytes of text for each shard.
SHARD_BYTES = 4 << 20
ANSWER, TOTAL, TEXTS = range(3)


def packed(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpacked(b: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype=dtype)


def packed_counts(x: np.ndarray) -> bytes:
    """Counts as a byte each; those of 255 and more follow in full."""
    large = x >= 255
    return packed(np.concatenate((np.where(large, 255, x).astype(np.uint8), x[large].astype("<i8").view(np.uint8))))


def unpacked_counts(b: bytes, n: int) -> np.ndarray:
    raw = unpacked(b, np.uint8)
    out = raw[:n].astype(np.int64)
    out[out == 255] = raw[n:].copy().view("<i8")
    return out


LOW = 5
KEY_BITS = 56


def packed_keys(x: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending keys as differences: their low bytes as they are, and the high ones, nearly all zero, compressed."""
    raw = np.diff(x, prepend=U64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return raw[:, :LOW].tobytes(), packed(raw[:, LOW : KEY_BITS // 8])


def unpacked_keys(low: bytes, high: bytes) -> np.ndarray:
    n = len(low) // LOW
    raw = np.zeros((n, 8), dtype=np.uint8)
    raw[:, :LOW] = np.frombuffer(low, np.uint8).reshape(n, LOW)
    raw[:, LOW : KEY_BITS // 8] = unpacked(high, np.uint8).reshape(n, KEY_BITS // 8 - LOW)
    return np.cumsum(raw.view("<u8").ravel(), dtype=U64)


@dataclass
class Chunk:
    """Whole documents: their rows (a struct array), tokens as numbers of distinct hashes, tokens of each document."""

    rows: pa.Array
    hashes: np.ndarray
    token: np.ndarray
    n: np.ndarray

    @property
    def begin(self) -> int:
        return int(np.searchsorted(self.hashes, BEGIN))

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.n) - self.n


def numbered(pieces: list[tuple[pa.Array, pa.Array]]) -> Chunk:
    """A chunk of pieces (rows, texts): words and one end token a document; the begin token has a number but no place."""
    found = [words(block) for _, t in pieces for block in blocks(t)]
    n = np.concatenate([w.counts for w in found]) + 1
    token = np.empty(int(n.sum()), dtype=U64)
    is_end = np.zeros(len(token), dtype=bool)
    is_end[np.cumsum(n) - 1] = True
    token[is_end], token[~is_end] = END, np.concatenate([w.hashes for w in found])
    distinct, inverse = np.unique(np.append(token, BEGIN), return_inverse=True)
    return Chunk(pa.concat_arrays([r for r, _ in pieces]), distinct, inverse[:-1].astype(np.int32), n)


#: One pass over all chunks; (k, n) stands for every n-th from k on.
ALL = (0, 1)


def chunks(batches: Iterator[pa.RecordBatch], size: int, part: tuple[int, int] = ALL) -> Iterator[tuple[int, Chunk]]:
    """Cuts a task's documents (row, text) into numbered chunks, the same ones whenever the task runs and however it is fed.

    A chunk ends with the document that brings it to `size` bytes; those of other parts are only counted.
    """
    task = TaskContext.get().partitionId()
    number, held = task << 32, 0
    pieces: list[tuple[pa.Array, pa.Array]] = []
    wanted = lambda: (number + task) % part[1] == part[0]
    for b in batches:
        row, text = b.column("row"), b.column("text")
        lengths = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(lengths):
            reach = held + np.cumsum(lengths[at:])
            to = min(at + int(np.searchsorted(reach, size)) + 1, len(lengths))
            if wanted():
                pieces.append((row.slice(at, to - at), text.slice(at, to - at)))
            held, at = int(reach[to - at - 1]), to
            if held >= size:
                if wanted():
                    yield number, numbered(pieces)
                number, held, pieces = number + 1, 0, []
    if pieces:
        yield number, numbered(pieces)


@dataclass
class Level:
    """A chunk's different n-grams of one order, by number.

    context is the number of the n-gram without its last word (one order below), word that
    word, tail the number of the n-gram without its first word; place gives the n-gram that
    ends at each token, -1 where the document is too short for one.
    """

    key: np.ndarray
    route: np.ndarray
    context: np.ndarray
    word: np.ndarray
    tail: np.ndarray
    place: np.ndarray


def levels(c: Chunk, order: int) -> list[Level]:
    """N-grams of orders 1 to `order`; a begin token stands before each document."""
    m = len(c.hashes)
    every = np.arange(m)
    nothing = np.zeros(m, dtype=np.int64)
    out = [Level(c.hashes, mix(c.hashes), nothing, every, nothing, c.token.astype(np.int64))]
    before = np.empty(len(c.token), dtype=np.int64)  # the n-gram of one order less that ends at the token before
    before[1:] = c.token[:-1]
    before[c.starts] = c.begin
    for _ in range(1, order):
        low = out[-1]
        at = np.flatnonzero(before >= 0)
        distinct, inverse = np.unique(before[at] * m + c.token[at], return_inverse=True)
        context, word = distinct // m, distinct % m
        tail = np.empty(len(distinct), dtype=np.int64)
        tail[inverse] = low.place[at]
        place = np.full(len(c.token), -1, dtype=np.int64)
        place[at] = inverse
        hashes = c.hashes[word]
        out.append(Level(combine(low.key[context], hashes), combine(hashes, low.route[context]), context, word, tail, place))
        before = np.full(len(c.token), -1, dtype=np.int64)
        before[1:] = place[:-1]
        before[c.starts] = -1
    return out


def dealt(found: list[Level], shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams sorted by shard and key: their numbers, order by order, keys, shards, and the cuts between shards.

    A key's lowest bit tells words from longer n-grams.
    """
    shard = (np.concatenate([x.route for x in found]) >> U64(40)) * U64(shards) >> U64(24)
    key = np.concatenate([x.key for x in found]) >> U64(64 - KEY_BITS) & ~U64(1)
    key[: len(found[0].key)] |= U64(1)
    by = np.argsort(key)
    shard = shard.astype(np.uint16 if shards <= 1 << 16 else np.int64)[by]
    again = np.argsort(shard, kind="stable")
    by, shard = by[again], shard[again].astype(np.int64)
    return by, key[by], shard, np.flatnonzero(np.diff(shard, prepend=-1, append=-1))


def address(hashes: np.ndarray, shards: int, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shard and key of words, or of the pairs of words `after` and `hashes`; as dealt() gives them."""
    key, route = (hashes, mix(hashes)) if after is None else (combine(after, hashes), combine(hashes, mix(after)))
    key = key >> U64(64 - KEY_BITS) & ~U64(1) | U64(after is None)
    return ((route >> U64(40)) * U64(shards) >> U64(24)).astype(np.int32), key


def xor(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(keys).view(np.int64)) if len(keys) else 0


#: The key of the begin token.
BEGIN_KEY = BEGIN >> U64(64 - KEY_BITS) | U64(1)
ASK = "shard int, chunk long, low binary, high binary, counts binary"
ASK_NAMES = ["shard", "chunk", "low", "high", "counts"]
REPLY = "kind int, shard int, chunk long, check long, n long, distinct long, answer binary"
REPLY_ARROW = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("chunk", pa.int64()), ("check", pa.int64()), ("n", pa.int64()), ("distinct", pa.int64()), ("answer", pa.binary())])


def replies(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(REPLY_ARROW)], schema=REPLY_ARROW)


def ask(docs: DataFrame, order: int, shards: int, count: Callable[[Chunk, list[Level]], list[np.ndarray]] | None = None, size: int = CHUNK_BYTES, part: tuple[int, int] = ALL) -> DataFrame:
    """Requests of a part of the chunks of docs (row struct, text): keys, and what `count` gives for each n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, c in chunks(batches, size, part):
            found = levels(c, order)
            by, keys, shard, cuts = dealt(found, shards)
            counts = np.concatenate(count(c, found))[by] if count else None
            rows = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                rows.append((int(shard[lo]), number, *packed_keys(keys[lo:hi]), None if counts is None else packed_counts(counts[lo:hi])))
            types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=ASK_NAMES)

    return docs.mapInArrow(run, ASK)


def asked(table: pa.Table) -> tuple[np.ndarray, list[int]]:
    """A shard's keys of all chunks, and how many each has asked for."""
    keys = [unpacked_keys(low.as_py(), high.as_py()) for low, high in zip(table.column("low"), table.column("high"))]
    return np.concatenate([*keys, np.zeros(0, U64)]), [len(k) for k in keys]


def texts(docs: DataFrame, size: int = CHUNK_BYTES, part: tuple[int, int] = ALL) -> DataFrame:
    """Each chunk's documents as token numbers; cut anew instead of kept, since only the last step needs them."""
    row = docs.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, c in chunks(batches, size, part):
            rows = pa.ListArray.from_arrays(pa.array([0, len(c.rows)], pa.int32()), c.rows)
            yield pa.RecordBatch.from_arrays([pa.array([TEXTS], pa.int32()), pa.array([number], pa.int64()), rows, *(pa.array([x], pa.binary()) for x in (c.hashes.tobytes(), packed(c.token), packed(c.n)))], names=["kind", "chunk", "rows", "hashes", "token", "n_tokens"])

    return docs.mapInArrow(run, f"kind int, chunk long, rows array<{row}>, hashes binary, token binary, n_tokens binary")


def gathered(table: pa.Table, order: int, shards: int, extra: int = 0) -> tuple[Chunk, list[Level], list[np.ndarray], np.ndarray]:
    """A chunk from its row of texts and the shards' replies: the chunk, its n-grams, for each order the answers, and the words' extra ones.

    A reply has a number for each key and then `extra` more for each word among them.
    """
    rows = table.select(["kind", "shard", "check", "answer", "hashes", "token", "n_tokens"]).to_pylist()
    at, head = next((k, r) for k, r in enumerate(rows) if r["kind"] == TEXTS)
    c = Chunk(table.column("rows")[at].values, np.frombuffer(head["hashes"], U64), unpacked(head["token"], np.int32), unpacked(head["n_tokens"], np.int64))
    found = levels(c, order)
    by, keys, shard, cuts = dealt(found, shards)
    given = sorted((r for r in rows if r["kind"] == ANSWER), key=lambda r: r["shard"])
    ranges = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    if [(int(shard[lo]), xor(keys[lo:hi])) for lo, hi in ranges] != [(r["shard"], r["check"]) for r in given]:
        raise RuntimeError("a chunk's answers do not fit its requests: the input changed between two reads")
    answers, more = np.empty(len(by), dtype=np.int64), np.zeros((len(c.hashes), extra), dtype=np.int64)
    for r, (lo, hi) in zip(given, ranges):
        word = by[lo:hi][keys[lo:hi] & U64(1) == 1]
        got = unpacked_counts(r["answer"], hi - lo + extra * len(word))
        answers[by[lo:hi]] = got[: hi - lo]
        more[word] = got[hi - lo :].reshape(len(word), extra)
    return c, found, np.split(answers, np.cumsum([len(x.key) for x in found])[:-1]), more


def n_shards(docs: DataFrame, text: str = "text") -> int:
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-size // SHARD_BYTES))
