"""The sealed holdout: membership, drift, and one evaluation that is on record before its result is seen."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank.operators.metrics import average_precision, ndcg_at, precision_at
from driftrank.operators.relational import set_digest, symmetric_difference
from driftrank.operators.store import Refused, append_rows, exists

LEDGER = ("run_id", "at", "fingerprint", "rows", "note")


def parts(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(development, holdout): exhaustive and disjoint. changes: with the boolean holdout."""
    return changes.where(~F.col("holdout")), changes.where("holdout")


def assert_disjoint(a: DataFrame, b: DataFrame, key: Sequence[str]) -> None:
    if not a.select(*key).distinct().join(b.select(*key).distinct(), list(key)).isEmpty():
        raise Refused("overlap", f"both sides hold the same {', '.join(key)}")


def assert_none_held_out(df: DataFrame, when: str, start: Column) -> None:
    if not df.where(F.col(when) >= start).limit(1).isEmpty():
        raise Refused("holdout", "rows on or after the holdout's first day")


def membership(holdout: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows, groups and fingerprint of the holdout."""
    counts = holdout.agg(F.count("*").alias("rows"), F.count_distinct(*key).alias("groups"))
    return counts.join(F.broadcast(set_digest(holdout, key)))  # one row each


def freeze(holdout: DataFrame, key: Sequence[str], path: str) -> bool:
    """Writes the holdout's keys once; says whether it wrote."""
    if exists(holdout.sparkSession, path):
        return False
    holdout.select(*key).distinct().write.mode("errorifexists").parquet(path)
    return True


def drift(holdout: DataFrame, key: Sequence[str], path: str) -> DataFrame:
    """side, groups: how many of the frozen keys are kept and gone, and how many were added."""
    frozen = holdout.sparkSession.read.parquet(path)
    return symmetric_difference(frozen, holdout, key).groupBy("side").agg(F.count("*").alias("groups"))


def evaluate_once(dev: DataFrame, holdout: DataFrame, key: Sequence[str], order: Sequence[Column], score: str, label: str, ledger: str, run_id: str, note: str = "") -> dict:
    """Metrics of a scored holdout. The ledger's row is written first, so a look that fails half-way is on record too; a run id is used once."""
    spark = holdout.sparkSession
    assert_disjoint(dev, holdout, key)
    if exists(spark, ledger) and not spark.read.parquet(ledger).where(F.col("run_id") == run_id).isEmpty():
        raise Refused("spent", f"run {run_id} has been evaluated")
    held = membership(holdout, key).first()
    row = spark.range(1).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("at"), F.lit(held.fingerprint).alias("fingerprint"), F.lit(held.rows).alias("rows"), F.lit(note).alias("note"))
    append_rows(row, ledger, LEDGER)
    out = average_precision(holdout, score, label).first().asDict()
    out |= precision_at(holdout, key, label, order, 10).first().asDict() | ndcg_at(holdout, key, label, order, 20).first().asDict()
    return out | {"rows": held.rows, "upgrades": held.groups}


def write_metrics(spark: SparkSession, values: dict, path: str) -> None:
    """A metrics document as one JSON file."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metrics(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)
