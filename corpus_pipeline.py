"""Corpus preparation as a chain of stages; each reads what its predecessor kept.

All stages take null texts, ids and languages, empty texts, repeated rows and empty tables:
null and empty texts have nothing to be judged by and pass quality, decontamination and
redaction as they are; of them, as of any group of near copies, one stays; repeated rows are
judged alike, and an empty table stays empty. Columns of any name are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from setsim.llm import mixing, perplexity, personal_data, phrase_index, simhash
from setsim.llm.queries import EPOCHS, TARGETS
from setsim.llm.shared import KEY, ROW, discard, keyed, table, without_keys, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents whose perplexity the classifier rejects."""
    judged = perplexity.classify(docs, table(spark, sf_dir, "labels"))
    return without_keys(keyed(docs, "doc_id", "lang", "text"), judged.where("not kept"), KEY).select(f"{ROW}.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents that hold a window of a benchmark item."""
    found = phrase_index.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return without_keys(keyed(docs, "doc_id", "text"), found.where("n_hit > 0"), KEY).select(f"{ROW}.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; no document goes. n_chars follows the text."""
    return personal_data.redact(docs, length="n_chars" if "n_chars" in docs.columns else None)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds rates that bring the domains to the mixing query's target shares; documents of no copy go.

    The low-quality domain, which the first stage has removed, has no target: nothing could supply it.
    """
    targets = {d: share for d, share in TARGETS.items() if d != "low"}
    return mixing.mix_rows(docs, mixing.label_domains(table(spark, sf_dir, "labels")), targets, epochs=EPOCHS)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact", redact), ("mix", mix)]

#: SQL cannot express fingerprints, trained models or fitted rates; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over the written result of the one before."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{k}-{name}")
            if before is not None:
                discard(before)
            before = docs
    return docs
