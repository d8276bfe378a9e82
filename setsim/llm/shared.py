"""What the operators share: row keys, tables in the shared folder, labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import discard, stage as written, stage_dir as shared_dir  # noqa: F401

#: Names of the row key that operators add and of a row's own columns, kept in one struct so that no name clashes.
KEY, ROW = "__row_key", "__row"


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row's values, two hashes of different seeds; equal rows share it, and nulls count as values of their own."""
    values = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(F.lit(1), *values).alias("a"), F.xxhash64(F.lit(2), *values).alias("b"))


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Rows as (__row, __row_key): all columns in a struct, and the key over those named."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(ROW), row_key(*columns).alias(KEY))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Row keys are broadcast only up to this number, 16 bytes each; larger sets are joined by a shuffle.
MAX_BROADCAST_KEYS = 500_000


def without_keys(docs: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows of docs whose column `name` is not among the keys; the set's size picks the join."""
    keys = written(keys.select(name).distinct(), "keys")
    small = keys.count() <= MAX_BROADCAST_KEYS
    return docs.join(F.broadcast(keys) if small else keys.hint("shuffle_hash"), name, "left_anti")


def sampled(df: DataFrame, id_col: str, limit: int) -> DataFrame:
    """At most `limit` rows, those whose ids have the least hashes: a bounded sample, the same on every run."""
    n = df.count()
    if n <= limit:
        return df
    hashed = df.withColumn("__h", F.shiftrightunsigned(F.xxhash64(id_col), 1))
    near = hashed.where(F.col("__h") < int(2**63 * min(1.0, 1.5 * limit / n)))
    return near.orderBy("__h", id_col).limit(limit).drop("__h")


#: A quantile narrows its column by counts of this many ranges until so few rows are left, which the driver sorts.
QUANTILE_RANGES, QUANTILE_ROWS = 512, 5_000


def exact_quantiles(df: DataFrame, column: str, shares: list[float], by: str | None = None) -> dict[object, list[float]]:
    """For each group the least values of a double column that at least the given shares of its values reach no higher than.

    Groups are those of `by`, null left out, and None stands for all rows. Each round counts
    ranges of equal width between the least and the greatest value left of every group and
    share, in one aggregate, and keeps the range that holds the wanted rank; so values are
    exact, whatever the order of rows. Groups without values are absent.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("x"), (F.col(by).cast("string") if by else F.lit(None).cast("string")).alias("g"))
    if by:
        rows = rows.select("x", F.explode(F.array_distinct(F.array("g", F.lit(None).cast("string")))).alias("g"))
    left = {(r["g"], k): [max(math.ceil(s * r["n"]), 1), r["low"], r["high"], r["n"]] for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect() for k, s in enumerate(shares)}
    spark, found = df.sparkSession, {}

    def within(targets: list[tuple]) -> DataFrame:
        wanted = spark.createDataFrame([(g, k, *left[g, k][1:3]) for g, k in targets], "g string, k int, low double, high double")
        return rows.join(F.broadcast(wanted.withColumnRenamed("g", "h")), F.col("g").eqNullSafe(F.col("h")) & F.col("x").between(F.col("low"), F.col("high")))

    while wide := [t for t, (_, low, high, n) in left.items() if n > QUANTILE_ROWS and low < high]:
        part = F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * QUANTILE_RANGES), F.lit(QUANTILE_RANGES - 1))
        counted = within(wide).groupBy("g", "k", part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        for r in sorted(counted.collect(), key=lambda r: r["part"]):  # at most QUANTILE_RANGES rows a group and share
            target = left[r["g"], r["k"]]
            if (r["g"], r["k"]) in wide:
                if target[0] <= r["n"]:
                    target[1:] = r["low"], r["high"], r["n"]
                    wide.remove((r["g"], r["k"]))
                else:
                    target[0] -= r["n"]
    near = [t for t, (_, low, high, _) in left.items() if low < high]
    for t, (_, low, high, _) in left.items():
        if low == high:
            found[t] = low
    values: dict[tuple, list[float]] = {}
    for r in within(near).select("g", "k", "x").collect() if near else []:  # at most QUANTILE_ROWS a group and share
        values.setdefault((r["g"], r["k"]), []).append(r["x"])
    for t, xs in values.items():
        found[t] = sorted(xs)[left[t][0] - 1]
    return {g: [found[g, k] for k in range(len(shares))] for g, _ in left}


def exact_quantile(df: DataFrame, column: str, share: float) -> float | None:
    """The quantile over all rows; None without values."""
    return exact_quantiles(df, column, [share]).get(None, [None])[0]


def halved(ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Two halves by a hash of the id: one to fit a model to, one to judge it by."""
    first = F.pmod(F.xxhash64(id_col, F.lit("half")), F.lit(2)) == 0
    return ids.where(first), ids.where(~first)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids that some label calls good and none calls bad or toxic; null labels don't vouch for a row."""
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    good = F.max(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0))
    return labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(bad.alias("bad"), good.alias("good")).where("bad = 0 and good = 1").select(id_col)
