"""Writes without MERGE: upserts as union and keep-last, replacement by partition, guarded deletes, append-only ledgers.

Functions that return a DataFrame are plans of the table's next state; `publish` writes one beside the old and swaps the
pointer, so a reader sees either state whole and a failed job leaves the old one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(ValueError):
    """A guard that keeps a write from losing data; carries a code for the caller."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], coalesced: Sequence[str] = (), kept: Sequence[str] = ()) -> DataFrame:
    """Rows of both by key. Columns take the new value; `coalesced` ones keep the old where the new is null; `kept` ones never move once set."""
    a, b = old.alias("a"), new.alias("b")
    match = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    on = match[0]
    for m in match[1:]:
        on = on & m
    here, there = F.col("a.__here"), F.col("b.__here")
    joined = a.withColumn("__here", F.lit(True)).alias("a").join(b.withColumn("__here", F.lit(True)).alias("b"), on, "full_outer")

    def column(c: str):
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in kept:
            return F.when(here, x).otherwise(y)
        if c in coalesced:
            return F.coalesce(y, x)
        return F.when(there, y).otherwise(x)

    return joined.select(*[column(c).alias(c) for c in old.columns])


def insert_missing(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old, list(key), "left_anti").select(*old.columns))


def replace_partition(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """The rows of the new table's values of `column` replaced whole."""
    return old.join(new.select(column).distinct(), column, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def guard_replacement(before: int, after: int) -> None:
    if not after:
        raise Refused("empty", "nothing to write")
    if 2 * after < before:
        raise Refused("shrunk", f"{after} rows would replace {before}")


def delete(old: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*key).distinct(), list(key), "left_anti")


def guard_delete(total: int, gone: int, most_percent: int = 5, yes: bool = False) -> None:
    """Without `yes` nothing is deleted; with it, no more than a share of the table."""
    if not yes:
        raise Refused("dry_run", f"would delete {gone} of {total} rows")
    if 100 * gone > most_percent * total:
        raise Refused("too_many", f"{gone} of {total} rows is more than {most_percent} percent")


def append_rows(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Appends the pinned columns; a stored schema that differs is refused, an empty frame adds nothing."""
    spark = df.sparkSession
    if exists(spark, path):
        stored = spark.read.parquet(path).schema.fieldNames()
        if stored != list(columns):
            raise Refused("drift", f"{path} holds {stored}")
    if not df.isEmpty():
        df.select(*columns).write.mode("append").parquet(path)


def write_once(df: DataFrame, path: str) -> bool:
    """Writes where nothing is yet; says whether it wrote."""
    if exists(df.sparkSession, path):
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _files(spark: SparkSession, folder: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def claim(spark: SparkSession, path: str, text: str = "") -> None:
    """Creates a file that must not exist; of several that try, one succeeds and the others are refused."""
    where, fs = _files(spark, path)
    try:
        stream = fs.create(where, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception.getClass().getName()) or fs.exists(where):
            raise Refused("taken", f"{path} exists") from e
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _pointers(spark: SparkSession, folder: str) -> list[str]:
    where, fs = _files(spark, f"{folder}/pointers")
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def published(spark: SparkSession, folder: str) -> bool:
    return bool(_pointers(spark, folder))


def publish(df: DataFrame, folder: str) -> str:
    """Writes df as a new version under folder and makes it the current one; returns its path.

    A pointer is an empty folder named by number and version; it appears by one call, no pointer is ever changed, and readers take
    the highest, so at any time they find the old or the new version whole. Its number is claimed before: a writer that began at
    the same state as another one is refused, and its version is no one's.
    """
    spark = df.sparkSession
    last = max([int(p.split("-")[0]) for p in _pointers(spark, folder)], default=0)
    version = uuid.uuid4().hex
    df.write.parquet(f"{folder}/v-{version}")
    claim(spark, f"{folder}/claims/{last + 1:012d}")
    where, fs = _files(spark, f"{folder}/pointers/{last + 1:012d}-{version}")
    fs.mkdirs(where)
    return f"{folder}/v-{version}"


def current(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/v-{_pointers(spark, folder)[-1].split('-')[1]}")


def query(spark: SparkSession, sql: str, params: dict, tables: dict[str, DataFrame]) -> DataFrame:
    """A SQL text with named parameters over the given tables; values are bound, never pasted into the text."""
    return spark.sql(sql, args=params, **tables)


def columns_of(spark: SparkSession, name: str) -> list[str]:
    """The columns that a stored table has, for a writer that adapts to them."""
    return [c.name for c in spark.catalog.listColumns(name)]


def delete_script(ids: DataFrame, table: str, column: str, least: int = 40) -> DataFrame:
    """statement: deletes as text in batches of 500 ids, where there are more than `least` to look through by hand."""
    if ids.count() <= least:
        return ids.sparkSession.createDataFrame([], "statement string")
    batch = F.floor(F.col(column) / 500)
    listed = F.array_join(F.array_sort(F.collect_set(F.col(column).cast("bigint"))), ", ")
    return ids.groupBy(batch.alias("batch")).agg(F.concat(F.lit(f"DELETE FROM {table} WHERE {column} IN ("), listed, F.lit(");")).alias("statement")).select("statement")


def dry_run(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """What an upsert would do, without writing: rows inserted, updated and left."""
    a, b = old.select(*key).withColumn("__a", F.lit(1)), new.select(*key).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, list(key), "full_outer")
    return both.agg(F.count_if(F.col("__a").isNull()).alias("inserted"), F.count_if((F.col("__a") == 1) & (F.col("__b") == 1)).alias("updated"), F.count_if(F.col("__b").isNull()).alias("left"))
