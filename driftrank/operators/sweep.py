"""Evaluation over cut dates and shapes, comparisons of sweeps, picks for a story."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftrank.operators.metrics import average_precision, band, weighed_sums
from driftrank.operators.relational import quantiles
from driftrank.operators.store import Refused
from driftrank.tables import park

LEAST_POSITIVES, LEAST_RANKABLE, RESOLUTION = 30, 10, 0.25


def cut_points(changes: DataFrame, group: Sequence[str], when: str, shares: Sequence[float]) -> DataFrame:
    """share, cut: quantiles of the dates of whole groups, each group counted once, however many rows it has."""
    dates = changes.groupBy(*group).agg(F.max(when).alias("d")).where("d is not null")
    q = quantiles(dates, F.unix_micros(F.col("d").cast("timestamp")).cast("double"), shares)
    rows = F.array(*[F.struct(F.lit(s).alias("share"), F.timestamp_micros(F.col("q")[i].cast("bigint")).alias("cut")) for i, s in enumerate(shares)])
    return q.select(F.explode(rows).alias("x")).select("x.*")


def sweep(changes: DataFrame, cuts: DataFrame, group: Sequence[str], when: str, score: str, label: str, k: int = 10) -> DataFrame:
    """For each cut: the rows after it, their positives, floor, both average precisions, groups that can be ranked, and whether it is measured.

    A cut is not measured with too few positives or rankable groups; `repeat_of` names an earlier cut with the same rows.
    """
    own = park(repeats(changes, cuts, when), "cuts")
    once = own.where("repeat_of is null").select("cut")
    after = changes.join(F.broadcast(once), F.col(when) > F.col("cut"))  # a few cuts
    ap = average_precision(after, score, label, ["cut"])
    groups = after.groupBy("cut", *group).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    ranked = groups.groupBy("cut").agg(F.sum("n").alias("rows"), F.sum("p").alias("positives"), F.count_if((F.col("p") > 0) & (F.col("n") > k)).alias("rankable"))
    out = ap.join(ranked, "cut").withColumn("measured", (F.col("positives") >= LEAST_POSITIVES) & (F.col("rankable") >= LEAST_RANKABLE))
    shown = own.select("cut", "repeat_of", F.coalesce("repeat_of", "cut").alias("__of"))
    return shown.join(out.withColumnRenamed("cut", "__of"), "__of").drop("__of").select(*out.columns, "repeat_of")


def repeats(changes: DataFrame, cuts: DataFrame, when: str) -> DataFrame:
    """cut, repeat_of: the first cut after which the same rows stand, null for that one itself.

    Rows are digested once, by date; a cut's digest is made of the dates after it, so no row is compared with every cut.
    """
    dates = changes.where(F.col(when).isNotNull()).groupBy(F.col(when).alias("__d")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*sorted(changes.columns))).alias("x"))
    members = dates.join(F.broadcast(cuts.select("cut").distinct()), F.col("__d") > F.col("cut")).groupBy("cut").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.min("__d").alias("first"))
    first = F.min("cut").over(Window.partitionBy("n", "x", "first"))  # one row a cut
    return members.select("cut", F.when(first < F.col("cut"), first).alias("repeat_of"))


def compare_sweeps(before: DataFrame, after: DataFrame, value: str) -> DataFrame:
    """cut, before, after, moved (by more than RESOLUTION); sweeps over different cuts are refused."""
    a, b = before.select("cut", F.col(value).alias("before")), after.select("cut", F.col(value).alias("after"))
    both = a.join(b, "cut", "full_outer")
    if not both.where("before is null or after is null").isEmpty():
        raise Refused("cuts", "the sweeps differ in their cuts")
    return both.withColumn("moved", F.abs(F.col("after") - F.col("before")) > RESOLUTION)


def stories(changes: DataFrame, group: Sequence[str], order: Sequence[Column], label: str, k: int = 10) -> DataFrame:
    """By group: rows, used, hits among the first k, hits that chance gives, and where the most-used change stands (0 first, 1 last)."""
    w = Window.partitionBy(*group)
    ranked = changes.withColumns({"__r": F.row_number().over(w.orderBy(*order)), "__n": F.count("*").over(w)})
    place = (F.col("__r") - 1) / F.nullif(F.col("__n") - 1, F.lit(0))
    return ranked.groupBy(*group).agg(
        F.count("*").alias("rows"), F.sum(label).cast("bigint").alias("used"), F.sum(F.when(F.col("__r") <= k, F.col(label)).otherwise(0)).cast("bigint").alias("hits"),
        (F.least(F.lit(k), F.count("*")) * F.avg(label)).alias("expected"), F.max(F.when(F.col(label) == 1, place)).alias("deepest"),
    )


def by_shape(changes: DataFrame, shape: Column, score: str, other: str, label: str) -> DataFrame:
    """Both scores' average precision for each shape and their ratio, which is left out where the other one is below the floor."""
    rows = changes.withColumn("shape", shape)
    a = average_precision(rows, score, label, ["shape"]).select("shape", F.col("pr_auc_ties").alias("ap"), "floor")
    b = average_precision(rows, other, label, ["shape"]).select("shape", F.col("pr_auc_ties").alias("other_ap"))
    return a.join(b, "shape").withColumn("lift", F.when(F.col("other_ap") >= F.col("floor"), F.col("ap") / F.col("other_ap")))


def release_window(releases: DataFrame, key: Column, reason: Column, last: int) -> DataFrame:
    """Each package's releases with `reason` (null: kept) and place (1 newest) of the last `last` kept ones.

    A package of which under two stay has its pre-releases let in if that leaves more.
    """
    w = Window.partitionBy("package")
    rows = releases.withColumns({"key": key, "why": reason})
    rows = rows.withColumns({"strict": F.count_if(F.col("why").isNull()).over(w), "loose": F.count_if(F.col("why").isNull() | (F.col("why") == "prerelease")).over(w)})
    widen = (F.col("strict") < 2) & (F.col("loose") > F.col("strict"))
    rows = rows.withColumn("why", F.when(widen & (F.col("why") == "prerelease"), None).otherwise(F.col("why")))
    place = F.row_number().over(Window.partitionBy("package", F.col("why").isNull()).orderBy(F.desc("key"), F.desc("version")))
    rows = rows.withColumn("place", F.when(F.col("why").isNull(), place))
    return rows.withColumn("reason", F.when(F.col("place") > last, "outside_window").otherwise(F.col("why"))).withColumn("place", F.when(F.col("place") <= last, F.col("place"))).select("package", "version", "reason", "place")


def rate_intervals(df: DataFrame, group: Sequence[str], by: str, label: str, draws: int = 200, seed: int = 0, base: str | None = None) -> DataFrame:
    """by, rate, low, high: rates with intervals from whole groups drawn with Poisson weights of a hash; and, each with
    its interval from the same draws, minus_rest and over_rest, the rate's difference from and ratio to that of all other
    categories, and minus_base and over_base, those to the category `base`, if one is given."""
    cells = df.groupBy(by, F.xxhash64(*group).alias("g")).agg(F.count("*").cast("double").alias("n"), F.sum(label).cast("double").alias("k"))

    def compared(sums: DataFrame, over: list[str]) -> DataFrame:
        """Of k and n by category and `over`: the columns of the result without intervals."""
        w = Window.partitionBy(*over)
        rate = F.try_divide("k", "n")
        rest = F.try_divide(F.sum("k").over(w) - F.col("k"), F.sum("n").over(w) - F.col("n"))
        cols = {"rate": rate, "minus_rest": rate - rest, "over_rest": F.try_divide(rate, rest)}
        if base is not None:
            first = F.max(F.when(F.col(by) == base, rate)).over(w)
            cols |= {"minus_base": rate - first, "over_base": F.try_divide(rate, first)}
        return sums.select(by, *over, *[c.alias(x) for x, c in cols.items()])

    value = compared(cells.groupBy(by).agg(F.sum("k").alias("k"), F.sum("n").alias("n")), [])
    weighed = weighed_sums(cells, [by], ["k", "n"], draws, seed)
    each = compared(weighed, ["draw"])
    names = [c for c in value.columns if c != by]
    ends = []
    for c in names:
        low, high = band(c)
        ends += [low.alias("low" if c == "rate" else f"{c}_low"), high.alias("high" if c == "rate" else f"{c}_high")]
    spread = each.groupBy(F.col(by).alias("__by")).agg(*ends)
    out = value.join(spread, F.col(by).eqNullSafe(F.col("__by")))
    return out.select(by, *[x for c in names for x in ((c, "low", "high") if c == "rate" else (c, f"{c}_low", f"{c}_high"))])
