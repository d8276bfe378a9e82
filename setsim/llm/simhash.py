"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64 majority bits over the XXH64 hashes of a text's word shingles. Two
fingerprints within 3 bits have a 32-bit half in which they differ in at most one bit, so
each half is a table, and probing it with the 33 values of the radius-1 Hamming ball finds
every link; full distances are then verified. A half shared by very many different
fingerprints would give the square of their number in pairs. Such hot entries are linked
through points of the other half's Hamming space instead: x within 2 bits and y within 1
bit of the same point are within 3 bits of each other, and every such pair has that point,
so a star around each point loses no link and costs rows in proportion to the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import KEY, ROW, keyed, written
from .words import LOWER, blocks

SEED = 42
MAX_BITS = 3
#: A half with more different fingerprints than this is linked through points.
HOT_ENTRY = 48
BALL_1 = [0, *(1 << i for i in range(32))]
BALL_2 = [*BALL_1, *((1 << i) | (1 << j) for i, j in combinations(range(32), 2))]


def fingerprint_texts(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """Fingerprints of a column of texts, as unsigned 64-bit numbers; null and wordless texts get zero."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for block in blocks(texts):
        lowered = LOWER[block.data].tobytes()
        hashes: list[int] = []
        sizes = np.zeros(block.n, dtype=np.int64)
        for k in range(block.n):
            line = b" ".join(lowered[block.bounds[k] : block.bounds[k + 1]].split())
            if not line:
                continue
            gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
            starts = np.concatenate(([0], gaps + 1))
            ends = np.concatenate((gaps, [len(line)]))
            if len(starts) > shingle:
                starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
            else:
                starts, ends = starts[:1], ends[-1:]
            sizes[k] = len(starts)
            hashes += map(xxhash.xxh64_intdigest, map(line.__getitem__, map(slice, starts.tolist(), ends.tolist())), repeat(SEED))
        if not hashes:
            continue
        full = np.flatnonzero(sizes)
        firsts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        raw = np.array(hashes, dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
        bits = np.empty((len(full), 64), dtype=bool)
        for byte in range(8):
            votes = np.add.reduceat(np.unpackbits(raw[:, byte : byte + 1], axis=1), firsts, axis=0, dtype=np.int64)
            bits[:, 8 * byte : 8 * byte + 8] = 2 * votes > sizes[full][:, None]
        out[block.first + full] = np.packbits(bits, axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """Replaces the text column by `fp`, the fingerprint as a signed 64-bit number."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array(fingerprint_texts(b.column(text), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), fp], names=[*rest, "fp"])

    return docs.select(*rest, text).mapInArrow(run, schema)


def links(fps: DataFrame, hot_entry: int = HOT_ENTRY) -> DataFrame:
    """Links (a, b) between different fingerprints within 3 bits.

    Expects one row per fingerprint (fp long). Pairs under hot entries are joined by stars
    that reach the same fingerprints; all other pairs are given one by one.
    """
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    halves = F.array(F.struct(F.lit(0).alias("half"), low.alias("key"), high.alias("other")), F.struct(F.lit(1).alias("half"), high.alias("key"), low.alias("other")))
    entries = written(fps.select("fp", F.inline(halves)), "halves")
    hot = written(entries.groupBy("half", "key").count().where(F.col("count") > hot_entry).select("half", F.col("key")), "hot")
    table = entries.select("half", "key", F.col("fp").alias("b"), F.col("other").alias("b_other"))
    ball = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    probes = entries.select("half", "fp", "other", F.explode(F.transform(ball(BALL_1), lambda m: F.struct(F.col("key").bitwiseXOR(m).alias("key"), (m != 0).alias("moved")))).alias("p")).select(
        "half", "p.key", "p.moved", F.col("fp").alias("a"), "other"
    )
    any_hot = hot.limit(1).count() > 0
    cold = table.join(hot, ["half", "key"], "left_anti") if any_hot else table
    pairs = probes.join(cold, ["half", "key"]).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).where("a <> b").select("a", "b")
    if not any_hot:
        return pairs
    # Around a hot entry: members have the key itself; visitors come from one bit beside it.
    members = table.join(hot, ["half", "key"], "left_semi")
    visitors = probes.join(hot, ["half", "key"], "left_semi")
    one = members.select("half", "key", F.col("b").alias("fp"), F.explode(F.transform(ball(BALL_1), lambda m: F.col("b_other").bitwiseXOR(m))).alias("point"))
    centres = one.groupBy("half", "key", "point").agg(F.min("fp").alias("centre"))
    wide = visitors.where("not moved").select("half", "key", F.col("a").alias("fp"), F.explode(F.transform(ball(BALL_2), lambda m: F.col("other").bitwiseXOR(m))).alias("point"))
    near = visitors.where("moved").select("half", "key", F.col("a").alias("fp"), F.explode(F.transform(ball(BALL_1), lambda m: F.col("other").bitwiseXOR(m))).alias("point"))
    stars = wide.union(near).join(centres, ["half", "key", "point"]).where("fp <> centre").select(F.col("fp").alias("a"), F.col("centre").alias("b"))
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Gives each row its fingerprint and the least id among the rows its links reach.

    Returns id_col, the columns named in keep, fp, component_id; one row per input row.
    Null, empty and wordless texts have fingerprint zero and link like any other. A null id
    never is a component's least id unless all its ids are null. Repeated rows each get a
    row. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    rows = written(fingerprints(docs.select(F.col(id_col), *keep, F.col(text).alias("__text")), "__text", shingle), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    roots = components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    placed = classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(id_col, *keep, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Keeps one row of each component, that of its least id; columns stay as they are.

    Of rows with that id, the one with the least row key stays, and of equal rows one. Null,
    empty and wordless texts are one component; an empty table gives no rows.
    """
    rows = keyed(docs, id_col, text)
    found = near_duplicates(rows.select(F.col(ROW)[id_col].alias("id"), F.col(ROW)[text].alias("text"), KEY), "id", "text", keep=(KEY,))
    best = F.min(F.struct(F.col("id").isNull().alias("n"), F.col(KEY).alias("k"))).alias("best")
    chosen = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(best).select(F.col("best.k").alias(KEY))
    chosen = written(chosen.distinct(), "chosen")
    repeated = found.join(chosen, KEY, "left_semi").groupBy(KEY).count().where("count > 1").select(KEY)
    kept = rows.join(chosen.hint("shuffle_hash"), KEY, "left_semi")
    if not repeated.limit(1).count():
        return kept.select(f"{ROW}.*")
    repeated = written(repeated, "repeated")
    once = kept.join(repeated, KEY, "left_anti")
    return once.union(kept.join(repeated, KEY, "left_semi").dropDuplicates([KEY])).select(f"{ROW}.*")
