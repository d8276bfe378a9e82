"""Gradient boosted trees over small-integer features, in DataFrame operations only.

Each level of a tree takes one aggregate: gradients and hessians of the log loss summed by
node, feature and value. Only those sums, a few hundred rows, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features are whole numbers from 0 to this.
TOP = 31


@dataclass
class Node:
    value: float = 0.0
    feature: str = ""
    at: int = 0
    low: "Node | None" = None
    high: "Node | None" = None

    def expr(self) -> Column:
        """The tree as one CASE expression: low holds values up to `at`."""
        if self.low is None or self.high is None:
            return F.lit(self.value)
        return F.when(F.col(self.feature) <= self.at, self.low.expr()).otherwise(self.high.expr())

    def leaf_number(self, leaves: list["Node"]) -> Column:
        if self.low is None or self.high is None:
            leaves.append(self)
            return F.lit(len(leaves) - 1)
        low = self.low.leaf_number(leaves)
        return F.when(F.col(self.feature) <= self.at, low).otherwise(self.high.leaf_number(leaves))


def clipped(c: Column) -> Column:
    return F.least(F.greatest(F.coalesce(c.cast("int"), F.lit(0)), F.lit(0)), F.lit(TOP))


def margin(trees: list[Node]) -> Column:
    out = F.lit(0.0)
    for t in trees:
        out = out + t.expr()
    return out


def probability(trees: list[Node]) -> Column:
    return 1 / (1 + F.exp(-margin(trees)))


def best_split(sums: dict[tuple[str, int], tuple[float, float]], features: list[str], ridge: float) -> tuple[float, str, int, tuple[float, float], tuple[float, float]]:
    best = (1e-6, "", 0, (0.0, 0.0), (0.0, 0.0))
    score = lambda g, h: g * g / (h + ridge)
    for f in features:
        cells = [sums.get((f, v), (0.0, 0.0)) for v in range(TOP + 1)]
        all_g, all_h = sum(c[0] for c in cells), sum(c[1] for c in cells)
        g = h = 0.0
        for v in range(TOP):
            g, h = g + cells[v][0], h + cells[v][1]
            gain = score(g, h) + score(all_g - g, all_h - h) - score(all_g, all_h)
            if gain > best[0]:
                best = (gain, f, v, (g, h), (all_g - g, all_h - h))
    return best


def fit(rows: DataFrame, features: list[str], label: str, rounds: int = 10, depth: int = 2, rate: float = 0.5, ridge: float = 1.0) -> list[Node]:
    """Boosts trees on rows of clipped features and a 0/1 label; rows should be a written table."""
    trees: list[Node] = []
    for _ in range(rounds):
        root, p = Node(), probability(trees)
        cells = F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in features))
        for _ in range(depth):
            leaves: list[Node] = []
            number = root.leaf_number(leaves)
            got = rows.select(number.alias("node"), (p - F.col(label)).alias("g"), (p * (1 - p)).alias("h"), F.explode(cells).alias("c")).groupBy("node", "c.f", "c.v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            for k, leaf in enumerate(leaves):
                sums = {(r["f"], r["v"]): (r["g"], r["h"]) for r in got if r["node"] == k}
                _, f, at, low, high = best_split(sums, features, ridge)
                if f:
                    leaf.feature, leaf.at = f, at
                    leaf.low, leaf.high = (Node(-rate * g / (h + ridge)) for g, h in (low, high))
        trees.append(root)
        if not root.feature:
            break
    return trees
