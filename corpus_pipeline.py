"""A corpus pipeline in four stages, each written as Parquet and read again by the next one.

quality rules -> n-gram Jaccard join (one document of each group stays) -> substring dedup -> packing.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftrank.llm import jaccard, packing, quality, spans
from driftrank.llm.queries import BYTES
from driftrank.tables import park, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spans.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, BYTES)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("substring dedup", substring_dedup), ("packing", pack)]

#: Sketches, sentence cuts and token ids are not SQL; tests/llm holds every stage against a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = park(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
