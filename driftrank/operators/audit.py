"""Reconciliation and data-quality plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def release_plan(changes: DataFrame, releases: DataFrame) -> DataFrame:
    """package, trusted, n_differ: packages whose two sources agree on which versions were analysed and on their counts.

    changes: package, version_to; releases: package, version, n_changes, analysed.
    """
    seen = changes.groupBy("package", F.col("version_to").alias("version")).agg(F.count("*").alias("n_seen"))
    said = releases.where("analysed and n_changes > 0").select("package", "version", F.col("n_changes").alias("n_said"))
    both = seen.join(said, ["package", "version"], "full_outer")
    return both.groupBy("package").agg(
        F.bool_and(F.coalesce(F.col("n_seen") == F.col("n_said"), F.lit(False))).alias("trusted"),
        F.count_if(~F.col("n_seen").eqNullSafe(F.col("n_said"))).alias("n_differ"),
    )


def complete_dimension(listed: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """The listed rows and, with nulls, keys that only the facts know."""
    missing = facts.select(key).distinct().join(listed, key, "left_anti")
    return listed.unionByName(missing, allowMissingColumns=True)


def rates(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(label).cast("bigint").alias("positives"), F.avg(label).alias("rate"))


def shares(df: DataFrame, by: Sequence[str]) -> DataFrame:
    n = df.groupBy(*by).agg(F.count("*").alias("rows"))
    return n.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))  # a row a value


def dead_groups(df: DataFrame, by: Sequence[str], label: str, least: int) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(label).alias("positives")).where((F.col("rows") >= least) & (F.col("positives") == 0)).drop("positives")


def chain_holes(pairs: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Pairs whose start is not the end of the pair before."""
    before = F.lag("version_to").over(Window.partitionBy(*key).orderBy(*order))
    return pairs.withColumn("before", before).where("before is not null and before <> version_from")


def out_of_order(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Pairs published before the version they start from, whose date is looked up in the same table."""
    dates = pairs.groupBy(*key, F.col("version_to").alias("version_from")).agg(F.min("released_at").alias("from_date"))
    return pairs.join(dates, [*key, "version_from"], "left").where("released_at < from_date")


def boundary(days: DataFrame, need: int, most_share: float) -> DataFrame:
    """The latest day from which on there are `need` positives, with the rows and share held out; none where the share is above most_share. days: day, rows, positives, one row a day."""
    w = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    run = days.withColumns({"held": F.sum("rows").over(w), "found": F.sum("positives").over(w), "all": F.sum("rows").over(Window.partitionBy())})
    first = run.where(F.col("found") >= need).agg(F.max_by(F.struct("day", "held", "found", (F.col("held") / F.col("all")).alias("share")), "day").alias("x"))
    return first.select("x.*").where(F.col("share") <= most_share)


def boundaries(days: DataFrame, gates: dict[str, int], most_share: float, by: Sequence[str] = ()) -> DataFrame:
    """by, day, held, share, each gate's column summed: the latest day from which on every gate is cleared at once; none where the rows
    held from there are more than `most_share` of all.

    days: by, day, rows and a number for each gate (positives of a label, groups that can be ranked), one row a day; gates: the column
    and what it has to reach. One suffix sum carries all of them.
    """
    w = Window.partitionBy(*by)
    back = w.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    run = days.withColumns({"held": F.sum("rows").over(back), "all": F.sum("rows").over(w), **{c: F.sum(c).over(back) for c in gates}})
    for c, need in gates.items():
        run = run.where(F.col(c) >= need)
    found = run.groupBy(*by).agg(F.max_by(F.struct("day", "held", (F.col("held") / F.col("all")).alias("share"), *gates), "day").alias("x"))
    return found.select(*by, "x.*").where(F.col("share") <= most_share)


def compare_runs(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Counts of each key in both runs, for keys in both, and the change."""
    x = a.groupBy(*key).agg(F.count("*").alias("before"))
    y = b.groupBy(*key).agg(F.count("*").alias("after"))
    return x.join(y, list(key)).withColumn("change", F.col("after") - F.col("before"))


def stale_scores(prediction: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """By model: scores, and scores of rows that are gone."""
    known = rows.select(*key).distinct().withColumn("__known", F.lit(1))
    return prediction.join(known, list(key), "left").groupBy("model_version").agg(F.count("*").alias("scores"), F.count_if(F.col("__known").isNull()).alias("stale"))


def window_accounting(held: DataFrame, registry: DataFrame) -> DataFrame:
    """bucket, releases: where every registry release between each package's oldest and newest held version went.

    held: package, version, key; registry: package, version, key, reason, used, failed.
    """
    ends = held.groupBy("package").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    inside = registry.join(ends, "package").where("key between lo and hi")
    bucket = (
        F.when(F.col("used"), "used").when(F.col("failed"), "failed").when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("key") == F.col("lo"), "no_baseline").otherwise("unaccounted")
    )
    return inside.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("releases"), F.count_distinct("package").alias("packages"))


def lookup_gap(changes: DataFrame, usage: DataFrame, leaf: Column, root: Column) -> DataFrame:
    """population, rows: changed symbols found in the usage index exactly, under their root by a name that one changed symbol owns, by one that several own, or not at all."""
    symbols = changes.select("symbol").distinct().withColumns({"l": leaf, "r": root})
    owners = Window.partitionBy("r", "l")
    exact = usage.select("symbol", F.lit(1).alias("exact"))
    by_name = usage.select(leaf.alias("l"), root.alias("r")).distinct().withColumn("named", F.lit(1))
    out = symbols.withColumn("n", F.count("*").over(owners)).join(exact, "symbol", "left").join(by_name, ["r", "l"], "left")
    population = F.when(F.col("exact") == 1, "exact").when((F.col("named") == 1) & (F.col("n") == 1), "unambiguous").when(F.col("named") == 1, "ambiguous").otherwise("absent")
    return out.groupBy(population.alias("population")).agg(F.count("*").alias("rows"))
