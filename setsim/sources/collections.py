"""Collections of sets: from rows, arrays, words of a text, or text files.

A collection has one row per set: set_id (long), tokens (array of distinct longs, rare ones
first) and n (their number). Prefix filters need the order; everything else only needs the
tokens to be distinct. Rows with a null id or token are dropped, and sets without tokens with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from ..plans.stages import discard, stage

WORD = "[^a-z0-9]+"
#: Tokens of a universe whose ranks are broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST_TOKENS = 500_000


def text_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), WORD), lambda w: w != "")


def from_rows(rows: DataFrame, id_col: str = "id", token_col: str = "token") -> DataFrame:
    """A collection of (id, token) rows; repeated rows count once.

    Tokens of any orderable type become their rank by (number of sets, token), so a token's
    number says how rare it is. Counts are combined before the shuffle and joined back: by
    broadcast up to a checked number of tokens, beyond it by a join whose skewed keys are split.
    """
    pairs = rows.where(F.col(id_col).isNotNull() & F.col(token_col).isNotNull())
    raw = pairs.groupBy(F.col(id_col).cast("long").alias("set_id")).agg(F.collect_set(token_col).alias("raw"))
    return _encoded(stage(raw, "raw-sets"))


def _encoded(raw: DataFrame) -> DataFrame:
    """Sets of distinct tokens as they are (set_id, raw) to a collection."""
    tokens = raw.select("set_id", F.explode("raw").alias("token"))
    at_most = raw.agg(F.sum(F.size("raw"))).first()[0] or 0
    ranks = ranked(tokens.groupBy("token").agg(F.count("*").alias("df")), ["df", "token"], "rank", at_most=at_most).select("token", F.col("rank").alias("tok"))
    ranks = stage(ranks, "ranks")
    if ranks.count() <= MAX_BROADCAST_TOKENS:
        done = [raw, ranks]
        numbered = tokens.join(F.broadcast(ranks), "token")
    else:  # on their own, so that the files of this shuffle and the words go before the next one
        numbered = stage(tokens.join(ranks, "token").select("set_id", "tok"), "numbered")
        discard(raw, ranks)
        done = [numbered]
    sets = numbered.groupBy("set_id").agg(F.sort_array(F.collect_list("tok")).alias("tokens"))
    collection = stage(sets.select("set_id", "tokens", F.size("tokens").alias("n")), "collection")
    discard(*done)
    return collection


def from_arrays(df: DataFrame, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """A collection of rows that each hold a whole set as an array."""
    return from_rows(df.select(F.col(id_col).alias("id"), F.explode(tokens_col).alias("token")))


def from_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A collection of the words of texts."""
    return from_rows(df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(text_words(F.col(text_col)))).alias("token")))


def parse_line(line: Column, mode: str = "strict") -> Column:
    """Fields of a line as whole numbers; doubled blanks make no field.

    strict: a field that is no whole number is an error. lenient: its leading digits count,
    and none count as 0.
    """
    fields = F.filter(F.split(line, r"\s+"), lambda f: f != "")
    if mode == "strict":
        number = lambda f: f.try_cast("long")
        return F.transform(fields, lambda f: F.when(number(f).isNotNull(), number(f)).otherwise(F.raise_error(F.concat(F.lit("no whole number: "), f)).cast("long")))
    if mode == "lenient":
        number = lambda f: F.regexp_extract(f, r"^([+-]?\d+)", 1)
        return F.transform(fields, lambda f: F.coalesce(F.when(number(f) == "", F.lit(0)).otherwise(number(f).try_cast("long")), F.lit(0)).cast("long"))
    raise ValueError(f"mode is strict or lenient, not {mode!r}")


def read_lines(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """Text files of one set a line as (set_id, tokens, n), tokens as they stand.

    A set's id is its line's place among the non-blank lines, from 0, files in the order of
    their names. Lines are numbered within splits, which start at known offsets, and each
    split's first number is a sum over the splits before it; no task reads all lines.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    lines = stage(lines.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != ""), "lines")
    numbered = ranked(lines, ["file", "block", "place"], "set_id")
    tokens = parse_line(F.col("value"), mode)
    return numbered.select(F.col("set_id"), tokens.alias("tokens")).select("set_id", "tokens", F.size("tokens").alias("n"))


def from_text(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """A collection of text files of one set a line; nothing about their order is presumed."""
    return from_arrays(read_lines(spark, path, mode), "set_id", "tokens")


def with_dense_ids(collection: DataFrame) -> DataFrame:
    """Numbers the sets from 0 by (n, set_id) as `dense_id`, as blocks and partitions need."""
    return stage(ranked(collection, ["n", "set_id"], "dense_id"), "dense")


def universe_size(collection: DataFrame) -> DataFrame:
    """One row: the largest token plus one."""
    return collection.agg((F.coalesce(F.max(F.array_max("tokens")), F.lit(-1)) + 1).alias("universe"))
