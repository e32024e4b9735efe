"""Keys, dedupe, ordered groups, set operations: small relational operators with one plan each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftrank.tables import park, spread


def keep_one(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in `order` (null keys are a key)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keep_last(df: DataFrame, key: Sequence[str], sequence: str) -> DataFrame:
    return keep_one(df, key, [F.col(sequence).desc()])


def keep_first(df: DataFrame, key: Sequence[str], sequence: str) -> DataFrame:
    return keep_one(df, key, [F.col(sequence).asc()])


def top_in_group(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).where(F.col(rank) <= k)


def group_size(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*key)))


def group_max(df: DataFrame, key: Sequence[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.max(value).over(Window.partitionBy(*key)))


def group_nunique(df: DataFrame, key: Sequence[str], value: str, name: str) -> DataFrame:
    """count(distinct) broadcast to the group's rows: one aggregate, joined back."""
    n = df.groupBy(*key).agg(F.count_distinct(value).alias(name))
    return df.join(n, list(key), "left")


def count_before(df: DataFrame, key: Sequence[str], when: str, name: str, rows: int | None = None) -> DataFrame:
    """Rows of the key that are dated strictly earlier; ties share a count, undated rows get 0. `rows`: how many df has, where it is
    known, so that they are dealt into enough parts."""
    if rows is not None:
        (df,) = spread(rows, (df, key[0]))
    dated = Window.partitionBy(*key).orderBy(F.col(when).asc_nulls_last())
    return df.withColumn(name, F.when(F.col(when).isNotNull(), F.rank().over(dated) - 1).otherwise(0).cast("bigint"))


def running_before(df: DataFrame, key: Sequence[str], step: str, name: str) -> DataFrame:
    """For each (key, step), the rows of the key in earlier steps."""
    per = df.groupBy(*key, step).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*key).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn(name, F.coalesce(F.sum("__c").over(w), F.lit(0)).cast("bigint")).drop("__c")


def predecessor(df: DataFrame, key: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(*key).orderBy(*order)))


def islands(df: DataFrame, key: Sequence[str], order: Sequence[Column], gap: Column, name: str = "island") -> DataFrame:
    """Rows that are no gap, with the number of gaps before them and the island's size."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = df.withColumn(name, F.sum(gap.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).where(~gap)
    return marked.withColumn("island_size", F.count("*").over(Window.partitionBy(*key, name)))


def cumulative_share(df: DataFrame, key: Sequence[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(value) / F.sum(value).over(Window.partitionBy(*key)))


def symmetric_difference(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, side: `kept`, `gone` (left only) or `added` (right only)."""
    a = left.select(*key).distinct().withColumn("__a", F.lit(True))
    b = right.select(*key).distinct().withColumn("__b", F.lit(True))
    side = F.when(F.col("__b").isNull(), "gone").when(F.col("__a").isNull(), "added").otherwise("kept")
    return a.join(b, list(key), "full_outer").select(*key, side.alias("side"))


def same_keys(left: DataFrame, right: DataFrame, key: Sequence[str]) -> bool:
    return symmetric_difference(left, right, key).where("side <> 'kept'").isEmpty()


def fingerprint(df: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The first 12 hex digits of the SHA-256 of the sorted distinct keys, joined by `|`, of each group of `by`.

    Meant for key sets of bounded groups: a group's keys meet in one row.
    """
    joined = F.array_join(F.array_sort(F.collect_set(F.concat_ws("|", *key))), "|")
    return df.groupBy(*by).agg(F.left(F.sha2(joined, 256), F.lit(12)).alias("fingerprint"))


def set_digest(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """fingerprint of the set of keys, whatever its size or order: a SHA-256 over the number of distinct keys and sums of two hashes of each."""
    each = df.select(*key).distinct().select(F.xxhash64(*key).alias("a"), F.xxhash64(F.lit(1), *key).alias("b"))
    sums = each.agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "ab"])
    return sums.select(F.left(F.sha2(F.concat_ws("|", "n", "a", "b"), 256), F.lit(12)).alias("fingerprint"))


def in_ranges(df: DataFrame, order: Sequence[Column], name: str = "__range") -> DataFrame:
    """df dealt to ranges of `order` with equally many rows, numbered in that order: what is to be ordered as a whole is ordered
    range by range, and only sums of ranges meet in one task. Equal values share a range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return park(df.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id()), "ranges")


def _placed(df: DataFrame, value: Column, order: Column) -> DataFrame:
    """__v, __c, __before, __n of each value: its rows, the rows of values ahead of it in `order` (of __v), and all rows."""
    counts = in_ranges(df.groupBy(value.alias("__v")).agg(F.count("*").alias("__c")), [order])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = counts.groupBy("__range").agg(F.sum("__c").alias("__s")).select("__range", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__lead"), F.sum("__s").over(every).alias("__n"))  # a row a range
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("__in", F.coalesce(F.sum("__c").over(inside), F.lit(0))).join(F.broadcast(sums), "__range")
    return placed.select("__v", "__c", (F.col("__lead") + F.col("__in")).alias("__before"), "__n")


def ranked(df: DataFrame, value: str, name: str) -> DataFrame:
    """rank() over the whole table by value, largest first (nulls last), without one task that holds it."""
    place = _placed(df, F.col(value), F.col("__v").desc_nulls_last()).select("__v", (F.col("__before") + 1).alias(name))
    return df.join(place, F.col(value).eqNullSafe(F.col("__v")), "left").drop("__v")


def quantiles(df: DataFrame, value: Column, shares: Sequence[float]) -> DataFrame:
    """q: exact quantiles of a number, between two rows by linear interpolation; one row. Nulls are left out; without a value
    each quantile is null. What percentile() gives, but values are ordered in ranges instead of meeting in one task.
    """
    placed = _placed(df.select(value.alias("__x")).where("__x is not null"), F.col("__x"), F.col("__v").asc())

    def at(row: Column) -> Column:
        return F.max(F.when((F.col("__before") <= row) & (row < F.col("__before") + F.col("__c")), F.col("__v")))

    found = []
    for s in shares:
        place, top = F.lit(float(s)) * (F.col("__n") - 1), F.lit(float(s)) * (F.max("__n") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        found.append(F.when(low == high, low).otherwise((F.ceil(top) - top) * low + (top - F.floor(top)) * high))
    return placed.agg(F.array(*found).alias("q"))


def default_column(df: DataFrame, name: str, value: object) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def require_none(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """Fails the plan on a row for which `bad` holds."""
    return df.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))
