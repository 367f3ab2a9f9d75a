"""From raw documents to packed sequences: the stages, in order, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import mixing, packing, quality, simhash
from kinfold.runtime import discard, settle, table, tidy


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not reject stay."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.expand(mixing.mix(docs, mixing.ranked_weights(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Training, fingerprints and tokenization have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each result is written and read again. What a stage has written besides, and
    what it has read, is deleted once its result is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with tidy(spark) as keep:
            then = keep(settle(stage(spark, docs, sf_dir), f"stage-{name}"))
        discard(docs)
        docs = then
    return STAGES[-1][1](spark, docs, sf_dir)
