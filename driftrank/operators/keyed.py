"""Keyed tables in hash buckets: an upsert reads and writes only the buckets that its keys fall into.

A table is a folder of data folders, each written once, and of numbered manifests. A manifest names the folder of each
bucket, so a new state shares all untouched buckets with the one before. A writer claims the next number by creating a file
that must not exist: of two writers that began at the same state one is refused and loses nothing. Readers take the highest
manifest that is whole.

Rules of a table (unique keys, checks, references) are data. They are told apart in one pass over the rows that are to be written
and, where a rule is broken, nothing is published and the rule is named.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftrank.operators.relational import in_ranges, keep_last
from driftrank.operators.store import Refused, claim, exists, upsert
from driftrank.tables import park, release


@dataclass(frozen=True)
class Rule:
    """kind `unique`: no two rows agree in all `columns` (rows with a null in one are not compared); `check`: the SQL condition
    `says` is not false; `present`: no null in `columns`; `reference`: `columns` are found in those of the table named `says`."""

    name: str
    kind: str
    columns: tuple[str, ...] = ()
    says: str = ""


def broken(df: DataFrame, rules: Sequence[Rule], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """rule, rows: the rows that break each rule; rules that hold are left out.

    Checks of single rows share one aggregate. A reference is looked up by its distinct keys, counted before the join.
    """
    single = [r for r in rules if r.kind in ("check", "present")]
    fails = {r.name: ~F.coalesce(F.expr(r.says), F.lit(True)) if r.kind == "check" else F.exists(F.array(*[F.col(c).isNull() for c in r.columns]), lambda x: x) for r in single}
    parts = []
    if single:
        counted = df.agg(*[F.count_if(x).alias(n) for n, x in fails.items()])
        parts.append(counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in fails])).alias("x")).select("x.*"))
    for r in rules:
        cols = list(r.columns)
        if r.kind == "unique":
            again = df.na.drop(subset=cols).groupBy(*cols).agg(F.count("*").alias("__n")).where("__n > 1")
            parts.append(again.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows")).select(F.lit(r.name).alias("rule"), "rows"))
        elif r.kind == "reference":
            keys = df.na.drop(subset=cols).groupBy(*cols).agg(F.count("*").alias("__n"))
            lost = keys.join((tables or {})[r.says].select(*cols).distinct(), cols, "left_anti")
            parts.append(lost.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows")).select(F.lit(r.name).alias("rule"), "rows"))
        elif r not in single:
            raise ValueError(f"no rule of kind {r.kind}")
    out = parts[0] if parts else df.sparkSession.createDataFrame([], "rule string, rows long")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("rows > 0")


def enforce(df: DataFrame, rules: Sequence[Rule], tables: dict[str, DataFrame] | None = None) -> None:
    found = sorted((r.rule, r.rows) for r in broken(df, rules, tables).collect())  # a row a rule
    if found:
        raise Refused("constraint", "; ".join(f"{name} is broken by {n} rows" for name, n in found))


@dataclass
class Manifest:
    schema: str
    key: list[str]
    buckets: int
    folders: dict[str, str] = field(default_factory=dict)  # bucket -> its folder, below the table's
    rules: list[dict] = field(default_factory=list)
    number: int = 0

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    where, fs = _fs(spark, f"{folder}/manifests")
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(where)) if fs.exists(where) else []


def manifest(spark: SparkSession, folder: str) -> Manifest:
    """The latest whole one; one that a writer left unfinished is passed over."""
    for number in reversed(_numbers(spark, folder)):
        where, fs = _fs(spark, f"{folder}/manifests/{number:012d}")
        stream = fs.open(where)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return Manifest(**json.loads(text), number=number)
        except ValueError:
            continue
    raise LookupError(f"no table in {folder}")


def _publish(spark: SparkSession, folder: str, m: Manifest) -> None:
    """The manifest as the number after the one it was read at; refused if that is taken by a whole one."""
    later = [n for n in _numbers(spark, folder) if n > m.number]
    if later and manifest(spark, folder).number > m.number:
        raise Refused("taken", f"{folder} has moved on from state {m.number}")
    number = max([m.number, *later]) + 1
    body = {k: v for k, v in asdict(m).items() if k != "number"}
    claim(spark, f"{folder}/manifests/{number:012d}", json.dumps(body))


def create(spark: SparkSession, folder: str, schema: T.StructType, key: Sequence[str], buckets: int = 64, rules: Sequence[Rule] = ()) -> None:
    """An empty table. `buckets` is fixed: choose it so that a bucket stays within some hundreds of MB."""
    _publish(spark, folder, Manifest(schema.json(), list(key), buckets, rules=[asdict(r) for r in rules]))


def read(spark: SparkSession, folder: str, only: Sequence[int] | None = None) -> DataFrame:
    """The table, or some of its buckets."""
    m = manifest(spark, folder)
    paths = [f"{folder}/{p}" for b, p in m.folders.items() if only is None or int(b) in set(only)]
    return spark.read.schema(m.struct).parquet(*paths) if paths else spark.createDataFrame([], m.struct)


def merge(rows: DataFrame, folder: str, coalesced: Sequence[str] = (), kept: Sequence[str] = (), stamp: str | None = None, tables: dict[str, DataFrame] | None = None) -> int:
    """Upserts rows, one for each key; returns how many buckets were written. Columns behave as in `store.upsert`; `stamp` is set
    to the time of the write."""
    spark = rows.sparkSession
    m = manifest(spark, folder)
    if stamp:
        rows = rows.withColumn(stamp, F.current_timestamp())
    at = F.pmod(F.xxhash64(*m.key), F.lit(m.buckets)).cast("int")
    new = park(rows.select(*m.struct.fieldNames()).withColumn("__bucket", at), "upsert")
    touched = [r[0] for r in new.select("__bucket").distinct().collect()]  # numbers of buckets
    if touched:
        old = read(spark, folder, touched).withColumn("__bucket", at)
        state = upsert(old, new, [*m.key, "__bucket"], coalesced, kept)
        data = f"data/{uuid.uuid4().hex}"
        state.repartition(len(touched), "__bucket").write.option("compression", "zstd").partitionBy("__bucket").parquet(f"{folder}/{data}")
        written = spark.read.schema(m.struct).parquet(*[f"{folder}/{data}/__bucket={b}" for b in touched])
        try:
            enforce(written, [Rule(r["name"], r["kind"], tuple(r["columns"]), r["says"]) for r in m.rules], tables)
            m.folders |= {str(b): f"{data}/__bucket={b}" for b in touched}
            _publish(spark, folder, m)
        except Refused:
            where, fs = _fs(spark, f"{folder}/{data}")
            fs.delete(where, True)
            raise
        finally:
            release(new)
    else:
        release(new)
    return len(touched)


def batches(rows: DataFrame, order: Sequence[str], most: int = 2000) -> Iterator[DataFrame]:
    """rows in the given order, `most` at a time. Rows are numbered by ranges, so no task orders them all."""
    ranged = in_ranges(rows, [F.col(c) for c in order], "__range")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row a range
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.col("__before") - 1
    dealt = ranged.join(F.broadcast(before), "__range").withColumn("__batch", F.floor(place / most))
    spark, dealt = rows.sparkSession, park(dealt, "batches")
    for i in range(-(-dealt.count() // most)):
        yield spark.read.schema(dealt.schema).parquet(dealt.parked_at).where(F.col("__batch") == i).select(*rows.columns)
    release(dealt)


def merge_in_batches(rows: DataFrame, folder: str, sequence: str, most: int = 2000, **how) -> list[int]:
    """Upserts `most` rows at a time, by key and then by `sequence`, whose last row of a key stays; returns the rows of each batch."""
    m = manifest(rows.sparkSession, folder)
    sizes = []
    for part in batches(rows, [*m.key, sequence], most):
        sizes.append(part.count())
        merge(keep_last(part, m.key, sequence), folder, **how)
    return sizes


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Deletes what none of the last `keep` states names; returns how many data folders went. Not to be run beside writers."""
    numbers = _numbers(spark, folder)
    named: set[str] = set()
    for n in numbers[-keep:]:
        where, fs = _fs(spark, f"{folder}/manifests/{n:012d}")
        stream = fs.open(where)
        try:
            named |= {p.split("/")[1] for p in json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["folders"].values()}
        finally:
            stream.close()
    for n in numbers[:-keep]:
        where, fs = _fs(spark, f"{folder}/manifests/{n:012d}")
        fs.delete(where, False)
    gone = 0
    if exists(spark, f"{folder}/data"):
        where, fs = _fs(spark, f"{folder}/data")
        for x in fs.listStatus(where):
            if x.getPath().getName() not in named:
                gone += bool(fs.delete(x.getPath(), True))
    return gone
