"""Small corpora with the awkward cases every operator must take: nulls, empty and long texts, ties, repeated rows."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, count long, rate string"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    parts = []
    for _ in range(n):
        parts.append(f"w{int(vocabulary * rng.random() ** 2)}")
        parts.append(rng.choice([" ", " ", " ", "  ", "\n", ", ", ". ", "\t"]))
    return "".join(parts)


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """Rows of documents with extra columns whose names operators also use."""
    rng = random.Random(seed)
    texts: list[str | None] = [words(rng, rng.randint(1, 200)) for _ in range(n)]
    texts += [None, "", " \n\t ", "one", "Ünïcödé wörds ñandú " * 30, words(rng, 4000), "a " * 3000]
    shared = words(rng, 120)
    for k in range(12):  # a passage in many documents, and near copies
        texts.append(words(rng, rng.randint(0, 60)) + shared + words(rng, rng.randint(0, 60)))
        near = texts[3].split(" ")
        near[k % len(near)] = f"changed{k}"
        texts.append(" ".join(near))
    texts += [texts[5]] * 4
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), None if t is None else len(t), "x", 1, "y") for k, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, texts[7], "en", None, None, None, None, None), (None, None, None, None, None, None, None, None)]


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Good labels for most ids, with nulls, repeats and contradictions."""
    out = [(r[0], 1 if (r[0] or 0) % 5 else 0, 1 if (r[0] or 0) % 7 == 3 else 0) for r in rows if (r[0] or 0) % 3]
    return spark.createDataFrame([*out, out[0], (None, 1, 0), (4, None, None), (8, 1, None)], "doc_id long, quality int, toxic int")
