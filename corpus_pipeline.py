"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftworks.llm import decontaminate, mixing, quality
from siftworks.llm._stage import clear, stage
from siftworks.llm.shingle_dedup import keep_one_of_each
from siftworks.llm.substring_dedup import deduplicated


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; one without words is judged by its zero statistics."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit_quality(docs, labels))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word similarity 0.8 or more stays, the one with the smallest doc_id.

    Candidates are the documents whose SimHash fingerprints differ in at most 3 bits (covering masks, as in op4).
    That radius loses most such pairs, so those by shared shingles follow, and all are checked exactly
    (siftworks/llm/shingle_dedup.py). Texts without words are copies of each other.
    """
    return keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also stand in an earlier document are cut; n_chars follows the text. All rows stay, null texts null."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, also re-parameterised, go; null and empty texts stay."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, numbered in ``copy``; sources come to their target weights."""
    return mixing.mix_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_filter", quality_filter),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: The classifier's scores and the XXH64 fingerprints have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table.

    Every stage works whole texts of any length, keeps null doc_ids, takes repeated rows for copies of one
    document, and returns an empty table for one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
            clear(spark, keep=docs)  # what the stages before have staged is in ``docs`` now
    return docs
