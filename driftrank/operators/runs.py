"""Long runs of independent units: resumed from what is stored, isolated, bounded in time, all of a unit or nothing."""

from __future__ import annotations

import multiprocessing
import queue
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftrank.operators.store import exists


def left_to_do(units: DataFrame, done: str, key: Sequence[str]) -> DataFrame:
    """Units of which the sink at path `done` has no row; all of them before its first write."""
    spark = units.sparkSession
    return units.join(spark.read.parquet(done).select(*key).distinct(), list(key), "left_anti") if exists(spark, done) else units


def _child(work: Callable, unit: dict, out) -> None:
    try:
        out.put((list(work(unit)), None))
    except Exception as e:  # whatever a unit raises is its own failure, told as a row
        out.put((None, f"{type(e).__name__}: {e}"[:200]))


def _one(work: Callable, unit: dict, seconds: float) -> tuple[list | None, str | None]:
    """Runs a unit in a process of its own: one that hangs is ended, one that dies takes nobody with it."""
    ctx = multiprocessing.get_context("fork")
    out = ctx.Queue()
    p = ctx.Process(target=_child, args=(work, unit, out), daemon=False)
    p.start()
    waited = 0.0
    try:
        while True:
            try:
                return out.get(timeout=0.2)
            except queue.Empty:
                waited += 0.2
                if not p.is_alive() and out.empty():
                    return None, f"the process ended with {p.exitcode}"
                if waited >= seconds:
                    return None, f"took more than {seconds:g} seconds"
    finally:
        if p.is_alive():
            p.join(0.5)
        if p.is_alive():
            p.kill()
        p.join()


def isolated(units: DataFrame, work: Callable[[dict], Iterator[tuple]], schema: str, seconds: float = 1800.0) -> DataFrame:
    """The rows that `work` gives for each unit (a dict of its columns), with the unit's columns and `error`.

    A unit that raises, dies or takes longer is one row with its error and nulls; none of its rows stay.
    """
    fields = T._parse_datatype_string(schema).fields
    names = units.columns + [f.name for f in fields] + ["error"]
    kind = T.StructType([*units.schema.fields, *[T.StructField(f.name, f.dataType) for f in fields], T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for unit in batch.to_dict("records"):
                rows, error = _one(work, unit, seconds)
                own = tuple(unit.values())
                yield pd.DataFrame([(*own, *r, None) for r in rows] if error is None else [(*own, *[None] * len(fields), error)], columns=names)

    return units.mapInPandas(run, kind)


def restart(spark, folder: str) -> bool:
    """Deletes a run's outputs; says whether there were any."""
    if not exists(spark, folder):
        return False
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def in_batches(df: DataFrame, key: Sequence[str], rows: int = 2000) -> DataFrame:
    """df with `batch`: by a hash of the key, as many batches as keep one near `rows` rows; equal keys share one."""
    n = -(-df.count() // rows) or 1
    return df.withColumn("batch", F.pmod(F.xxhash64(*key), F.lit(n)).cast("bigint"))
