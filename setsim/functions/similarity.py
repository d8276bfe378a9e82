"""Bounds that a similarity threshold puts on set sizes, overlaps and prefixes.

All arithmetic is in IEEE doubles, in a fixed order of operations, so that every strategy
and an SQL engine that follows the same order agree at float edges. Sizes may be Columns
or whole numbers; a threshold is a Python float and never becomes a decimal literal.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Size = Column | int


def _double(x: Size) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def _size(x: Size) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


@dataclass(frozen=True)
class Jaccard:
    """Similar sets: the smaller has at least minsize tokens, and minoverlap of them are shared."""

    threshold: float

    def __post_init__(self) -> None:
        if not 0.0 < self.threshold <= 1.0:
            raise ValueError(f"a threshold lies above 0 and at most at 1, not at {self.threshold}")

    @property
    def t(self) -> Column:
        return F.lit(float(self.threshold))

    def raw_minoverlap(self, a: Size, b: Size) -> Column:
        return F.ceil((_double(a) + _double(b)) * self.t / (F.lit(1.0) + self.t))

    def minoverlap(self, a: Size, b: Size) -> Column:
        """Tokens two sets of these sizes must share, never more than either has."""
        return F.least(_size(a), _size(b), self.raw_minoverlap(a, b))

    def minsize(self, n: Size) -> Column:
        """Size below which no set is similar to one of size n."""
        return F.ceil(self.t * _double(n))

    def maxsize(self, n: Size) -> Column:
        """Size above which no set is similar to one of size n."""
        return F.floor(_double(n) / self.t)

    def positional_maxsize(self, n: Size, position: Size) -> Column:
        """As maxsize, for a set whose first shared token is at this 0-based position."""
        return F.floor((_double(n) - (F.lit(1.0 - 1e-10) + self.t) * _double(position)) / self.t)

    def maxprefix(self, n: Size) -> Column:
        """Leading tokens of a probe among which a similar, smaller set has one."""
        return F.least(_size(n), _size(n) - self.minsize(n) + 1)

    def midprefix(self, n: Size) -> Column:
        """Leading tokens of an indexed set among which a similar, larger set has one."""
        return F.least(_size(n), _size(n) - self.minoverlap(n, n) + 1)

    def position_filter(self, n1: Size, n2: Size, p1: Size, p2: Size) -> Column:
        """Whether tokens from these 0-based positions on still suffice for the overlap."""
        return self.minoverlap(n1, n2) <= F.least(_size(n1) - _size(p1), _size(n2) - _size(p2))

    def long_enough(self, n_probe: Size, n_indexed: Size) -> Column:
        return _size(n_indexed) >= self.minsize(n_probe)

    def size_range(self, n: Size) -> Column:
        """Number of a range of sizes; similar sets lie in one range or in two adjacent ones.

        Ranges grow by the factor 1/threshold, so an equi-join on the range, with probes in
        their own and in lower ranges, replaces most of a comparison of all sizes.
        """
        step = 2.0 if self.threshold <= 0.5 else 1.0 / min(self.threshold, 0.9)
        return F.floor(F.log(_double(n)) / F.lit(math.log(step))).cast("int")


#: Measures by name; others are added by giving them the same bounds.
MEASURES = {"jaccard": Jaccard}
