"""The training-corpus pipeline: documents to packed sequences.

Each stage reads the Parquet that its predecessor wrote, works on every row
of it, and its decisions take effect.  All but the last return the columns
of ``documents``; the last returns where every piece of every document
(replica) goes: span, bin, offset and the bin's final length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm.common import table
from shelfwise.llm.langid import language_filter
from shelfwise.llm.mixing import mix_sources
from shelfwise.llm.near_dup import drop_near_duplicates
from shelfwise.llm.packing import pack_documents
from shelfwise.llm.quality import quality_filter
from shelfwise.plans.materialize import materialize, remove_written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the models reject."""
    return language_filter(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a rule of the threshold table."""
    return quality_filter(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by their source's rate, in shuffled order; columns stay by position, whatever their names."""
    mixed = mix_sources(docs)
    places = mixed.toDF(*[f"c{i}" for i in range(len(mixed.columns))])
    return places.select(*places.columns[: len(docs.columns)]).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document and replica into sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", remove_near_duplicates),
    ("source_mixing", mix_to_weights),
    ("best_fit_packing", pack_sequences),
]

# Language models and greedy packing have no SQL form; tests/llm holds run() against a plain version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    return run_stages(spark, table(spark, sf_dir, "documents"), sf_dir)


def run_stages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages over ``docs``; stage tables hold the columns by position, so names may clash in any case."""
    names = docs.columns
    places = [f"c{i}" for i in range(len(names))]
    read: list[str] = []
    for name, stage in STAGES[:-1]:
        written: list[str] = []
        docs = materialize(stage(spark, docs, sf_dir).toDF(*places), f"pipeline_{name}", written).toDF(*names)
        remove_written(spark, read)  # its only reader is done
        read = written
    return STAGES[-1][1](spark, docs, sf_dir)
