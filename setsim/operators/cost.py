"""Choice of a technique for each pair of partitions by estimated cost."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Techniques in the order in which equally cheap ones are preferred.
TECHNIQUES = ("bitmap", "cpu", "prefix", "hybrid")
FEATURES = ("set_size_std", "avg_set_size", "token_freq", "dataset_size", "dataset_size_square", "universe_size", "index_size", "bitmap")


def coefficients_of(text: str, threshold: float, names: dict[str, str] | None = None) -> dict[str, dict[str, float]]:
    """Coefficients by technique from a JSON object of techniques, thresholds at two significant digits, and features.

    names translates what a file calls its techniques, where that differs.
    """
    key = f"{threshold:.2g}"
    out = {}
    for called, by_threshold in json.loads(text).items():
        name = (names or {}).get(called, called)
        if name not in TECHNIQUES:
            raise ValueError(f"no technique is named {name!r}")
        if key not in by_threshold:
            raise ValueError(f"{name} has no coefficients for {key}")
        out[name] = {k: float(v) for k, v in by_threshold[key].items()}
    return out


def read_coefficients(spark: SparkSession, path: str, threshold: float, names: dict[str, str] | None = None) -> dict[str, dict[str, float]]:
    (row,) = spark.read.text(path, wholetext=True).collect()  # one small file
    return coefficients_of(row["value"], threshold, names)


def cost(coefficients: dict[str, float], bits: int = 0) -> Column:
    """The absolute value of the weighted sum of a row's features, squares in doubles."""
    values = {f: F.col(f).cast("double") for f in FEATURES if f not in ("bitmap", "dataset_size_square")}
    values |= {"bitmap": F.lit(float(bits)), "dataset_size_square": F.col("dataset_size").cast("double") * F.col("dataset_size").cast("double")}
    total: Column = F.lit(coefficients.get("Intercept", 0.0))
    for name in FEATURES:
        total = total + F.lit(coefficients.get(name, 0.0)) * values[name]
    return F.abs(total)


def choose(pair_features: DataFrame, coefficients: dict[str, dict[str, float]], bits: int = 0) -> DataFrame:
    """The cheapest technique of each pair (left, right, technique, cost), of equals the first in TECHNIQUES.

    Without signature bits there is no bitmap technique.
    """
    names = [n for n in TECHNIQUES if n in coefficients and (n != "bitmap" or bits > 0)]
    if not names:
        raise ValueError("no technique to choose from")
    costs = F.array(*(F.struct(cost(coefficients[n], bits).alias("cost"), F.lit(k).alias("k"), F.lit(n).alias("technique")) for k, n in enumerate(names)))
    return pair_features.select("left", "right", F.array_min(costs).alias("best")).select("left", "right", "best.technique", "best.cost")


def indexed_partitions(runs: DataFrame) -> DataFrame:
    """Left partitions for which an index in the host's memory is wanted."""
    return runs.where(F.col("technique").isin("cpu", "hybrid")).select(F.col("left").alias("part")).distinct()
