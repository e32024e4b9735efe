"""Reading the driver's tables and cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path goes to Spark's reader untouched."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that setting is absent and the master is local (tests, a laptop) a local folder is made and kept for the
    session; on a cluster, where executors would each write to a disk of their own, its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="driftrank-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def park(df: DataFrame, label: str, clean: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here. With `clean`, the shuffle files of
    the write are deleted after it.

    A lost executor costs at most the running stage, since what is parked is read again from shared storage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftrank/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true" if clean else before)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.parked_at = path
    return out


#: Rows that one task is to sort or group, whatever the size of the table.
ROWS_A_TASK = 1 << 18


def spread(rows: int, *sides: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each (table, key) dealt out by its key, into as many parts as leave ROWS_A_TASK of `rows` in each; as it is where the cores make
    that many parts anyway."""
    spark = sides[0][0].sparkSession
    n = -(-rows // ROWS_A_TASK)
    if n <= spark.sparkContext.defaultParallelism:
        return [df for df, _ in sides]
    n = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a smaller number is dealt out again by what is joined to it
    return [df.repartition(n, key) for df, key in sides]


def release(*parked: DataFrame) -> None:
    """Delete parked tables that nothing reads any more: what was parked after them no longer depends on them."""
    for df in parked:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.parked_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
