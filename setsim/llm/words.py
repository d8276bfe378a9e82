"""Vectorised tokenising and hashing of whole Arrow text columns.

A column's UTF-8 bytes are taken as one numpy array, so words, lines and
n-grams of many texts are found and hashed without a Python loop over words.
A word's hash takes eight bytes a step through a mixing function, so words of at most
eight bytes and one length never share one, and no structure of longer ones makes them
meet; ranges over 64 bytes are hashed by XXH3. Equal words have equal hashes in every
task and every run. Only rolling hashes, which pick anchors, are polynomials modulo 2**64:
nothing is taken to be equal by them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK_BYTES = 1 << 18
U64 = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true within the closed byte ranges."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Bytes of words that are anything but ASCII white space.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words that are ASCII letters, digits and everything beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept between calls."""
    if len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        for k, b in enumerate((BASE, INVERSE)):
            x = np.full(n, b, dtype=U64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def combine(*parts: np.ndarray) -> np.ndarray:
    """One hash of several hashes in their order."""
    out = np.zeros(len(parts[0]), dtype=U64)
    for p in parts:
        out = mix(out * U64(0xD6E8FEB86659FD93) + p + U64(0x632BE59BD9B4E019))
    return out


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte times power; any range's hash follows from two of them."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * p[: len(data)], out=out[1:])
    return out


#: Bytes that the first k of an eight-byte step take up.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)
#: Ranges of more bytes are hashed one by one.
LONG_RANGE = 64


def bytes_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges by their bytes alone."""
    size = ends - starts
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    out = mix(size.astype(U64) + U64(0x632BE59BD9B4E019))
    at = np.flatnonzero((size > 0) & (size <= LONG_RANGE))
    pos, left = starts[at], size[at]
    while len(at):
        chunk = eights[pos] & MASKS[np.minimum(left, 8)]
        out[at] = mix(out[at] * U64(0xD6E8FEB86659FD93) + chunk)
        more = left > 8
        at, pos, left = at[more], pos[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_RANGE).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rolling hashes of byte ranges of the data that the sums are of."""
    _, inv = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inv[starts])


@dataclass
class Block:
    """Some whole texts: rows first..last of a batch, their bytes and bounds."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return self.last - self.first


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a column into blocks of whole texts, about `size` bytes each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield Block(at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """Words of a block: byte ranges, hashes, the text of each, and each text's first word."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(block: Block, kind: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    """Finds and hashes the words of a block; a word never crosses two texts."""
    data = LOWER[block.data] if lower else block.data
    starts, ends, first = word_ranges(data, block.bounds, kind)
    hashes = bytes_hashes(data, starts, ends)
    return Words(starts, ends, hashes, np.repeat(np.arange(block.n), np.diff(first)), first)


def word_ranges(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, and for each text the index of its first word."""
    inside = kind[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] |= inside[cuts]
    end[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds)


def hash_words(texts: list[str], kind: np.ndarray = NOT_SPACE) -> list[np.ndarray]:
    """Word hashes of each text, for small lists."""
    out: list[np.ndarray] = []
    for b in blocks(pa.array(texts, pa.string())):
        w = words(b, kind)
        out += [w.hashes[w.first[k] : w.first[k + 1]] for k in range(b.n)]
    return out


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set within each text."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
