"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, mixing, packing; each stage on what the last kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphsift.llm import line_dedup, minhash_dedup, mixing, packing, quality_rules
from glyphsift.llm.common import discard, stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that every quality rule lets pass."""
    return quality_rules.quality_rules(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; one that consisted of such copies alone goes."""
    return line_dedup.line_dedup(docs, drop_emptied=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; its source names those of the whole group, see mixing.SEPARATOR."""
    return minhash_dedup.drop_duplicates(docs, gather="source", separator=mixing.SEPARATOR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mixture takes, with the source that it is taken for."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]
#: Near-duplicate groups by ProbMinHash have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
