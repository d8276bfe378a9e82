"""Parity signatures of token sets, and the bounds on overlap that they give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 64


def bitmap_words(bits: int) -> int:
    """Words that a signature of at least this many bits takes."""
    if bits < 1:
        raise ValueError("a signature has at least one bit")
    return -(-bits // WORD_BITS)


def signature(tokens: Column, bits: int) -> Column:
    """Words of the signature as an array: token k toggles bit k modulo the size, a multiple of 64."""
    words = bitmap_words(bits)
    size = F.lit(words * WORD_BITS)

    def word(w: int) -> Column:
        def toggle(acc: Column, t: Column) -> Column:
            at = F.pmod(t, size)
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(WORD_BITS)).cast("int"))
            return acc.bitwiseXOR(F.when(F.floor(at / WORD_BITS) == w, bit).otherwise(F.lit(0).cast("long")))

        return F.aggregate(tokens, F.lit(0).cast("long"), toggle)

    return F.array(*(word(w) for w in range(words)))


def hamming(a: Column, b: Column, bits: int) -> Column:
    """Differing bits of two signatures of this many bits."""
    out: Column = F.lit(0).cast("long")
    for w in range(bitmap_words(bits)):
        out = out + F.bit_count(a[w].bitwiseXOR(b[w])).cast("long")
    return out


def overlap_bound(n1: Column, n2: Column, distance: Column) -> Column:
    """Most tokens that sets of these sizes can share at this distance of their signatures."""
    return (n1.cast("double") + n2.cast("double") - distance.cast("double")) / 2.0


#: Universes up to this size have their sets as bits.
MAX_UNIVERSE = 256


def exact_bits(tokens: Column, universe: int) -> list[Column]:
    """A set of tokens from 0 to below universe as words, bit for bit."""
    words = signature(tokens, max(1, universe))
    return [words[w] for w in range(bitmap_words(max(1, universe)))]


def bits_below(word: Column, w: int, token: Column) -> Column:
    """Of a set's word w, the bits of tokens below a token."""
    at = token - F.lit(w * WORD_BITS)
    mask = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), at.cast("int")))
    return F.when(at >= WORD_BITS, word).when(at <= 0, F.lit(0).cast("long")).otherwise(word.bitwiseAND(mask))


def shared_bits(a: list[Column], b: list[Column]) -> Column:
    """Tokens that two sets of bits share."""
    out: Column = F.lit(0).cast("long")
    for x, y in zip(a, b, strict=True):
        out = out + F.bit_count(x.bitwiseAND(y)).cast("long")
    return out
