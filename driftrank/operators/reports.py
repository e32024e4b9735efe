"""Small reports: examples, rates, ranks and orders, each one aggregate or one window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftrank.operators.store import Refused


def with_example(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, rows, example: the least value of each group."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.min(value).alias("example"))


def by_day(df: DataFrame, when: str) -> DataFrame:
    """day, rows: rows by the day they are dated; undated rows have a null day."""
    return df.groupBy(F.to_date(when).alias("day")).agg(F.count("*").alias("rows"))


def rate_ends(df: DataFrame, by: str, label: str, least: int, top: int, bottom: int) -> DataFrame:
    """end, place, by, rows, rate: the groups of `least` rows or more with the highest and the lowest rates; equals by name."""
    rates = df.groupBy(by).agg(F.count("*").alias("rows"), F.avg(label).alias("rate")).where(F.col("rows") >= least)
    out = None
    for end, k, order in (("top", top, F.desc("rate")), ("bottom", bottom, F.asc("rate"))):
        few = rates.orderBy(order, by).limit(k)  # a top-k: k rows
        part = few.select(F.lit(end).alias("end"), F.row_number().over(Window.orderBy(order, by)).cast("bigint").alias("place"), by, "rows", "rate")
        out = part if out is None else out.unionAll(part)
    return out


def constant_groups(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Groups in which the value takes one value at most, nulls aside: a score that cannot order them."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), (F.min(value).eqNullSafe(F.max(value))).alias("constant")).where("constant").drop("constant")


def ranked_gains(df: DataFrame, by: Sequence[str], gain: str) -> DataFrame:
    """Rank of each row's gain in its group, largest first; equals share a rank."""
    return df.withColumn("gain_rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(gain))).cast("bigint"))


def newest_each(df: DataFrame, by: str, newest: Sequence[Column], order: Sequence[Column], k: int) -> DataFrame:
    """The newest row of each group, and of those the first k in order."""
    first = df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*newest))).where("__n = 1").drop("__n")
    return first.orderBy(*order).limit(k)


def candidates(df: DataFrame, by: Sequence[str], name: Column, wanted: Column, weight: str) -> DataFrame:
    """place of each candidate: those with the wanted name first, then by weight, then by name."""
    w = Window.partitionBy(*by).orderBy(F.when(name == wanted, 0).otherwise(1), F.desc(weight), name)
    return df.withColumn("place", F.row_number().over(w).cast("bigint"))


def preference(text: Column, words: Sequence[str]) -> Column:
    """The place in the list of the first of its words that the text holds, in the list's order; their number where it holds none."""
    out = F.lit(len(words))
    for i, word in reversed(list(enumerate(words))):
        out = F.when(F.contains(F.lower(text), F.lit(word)), i).otherwise(out)
    return out


def tie_key(key: Sequence[str], seed: int = 0) -> Column:
    """A reproducible order of equals: a hash of the key and a seed."""
    return F.xxhash64(*key, F.lit(seed))


def by_size(df: DataFrame, value: str, k: int, *ties: str) -> DataFrame:
    """The k rows whose value is furthest from 0, whatever its sign."""
    return df.orderBy(F.abs(value).desc(), *ties).limit(k)


def place_in(values: Sequence, c: Column) -> Column:
    """The place of c in a list from 1 on; null where it is not in it."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), c)
    return F.when(at > 0, at)


def _not_in(m: Column):
    return lambda k, _: ~F.map_contains_key(m, k)


def merged(*maps: Column) -> Column:
    """Maps as one; a later map's value wins, and a null map adds nothing."""
    out = F.create_map().cast("map<string,string>")
    for m in maps:
        m = F.coalesce(m, F.create_map().cast("map<string,string>"))
        out = F.map_concat(F.map_filter(out, _not_in(m)), m)
    return out


def decoded(text: Column, schema: str) -> Column:
    """A JSON object, or a JSON text that holds one, as a struct; null where it is neither."""
    inner = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"]
    return F.from_json(F.coalesce(inner, text), schema)


def newest_last(values: Column, k: int) -> tuple[Column, Column]:
    """(the last k of a list, newest first; how many came before them)"""
    n = F.size(values)
    return F.reverse(F.slice(values, F.greatest(n - k, F.lit(0)) + 1, F.lit(k))), F.greatest(n - k, F.lit(0))


def days_from(when: str, days: int) -> Column:
    return F.date_add(F.to_date(when), days)


def weights_checked(df: DataFrame, weight: str) -> DataFrame:
    """df, failing on a weight that is no whole number from 0 on."""
    bad = F.col(weight).isNull() | (F.col(weight) < 0) | (F.col(weight) != F.floor(weight))
    return df.where(F.when(bad, F.raise_error(F.lit(f"{weight} must be a whole number from 0 on")).cast("boolean")).otherwise(F.lit(True)))


def completed_releases(changes: DataFrame) -> DataFrame:
    """package, version, released_at, first_from: every version that changes lead to, with its latest date and the version they were first
    compared with, and those that they only start from, undated. changes: package, version_from, version_to, released_at, seq."""
    to = changes.groupBy("package", F.col("version_to").alias("version")).agg(F.max("released_at").alias("released_at"), F.min_by("version_from", "seq").alias("first_from"))
    start = changes.select("package", F.col("version_from").alias("version")).where("version is not null").distinct()
    return to.unionByName(start.join(to, ["package", "version"], "left_anti"), allowMissingColumns=True)


def extra_rows(stored: DataFrame, source: DataFrame, bad: Column, oldest: DataFrame) -> DataFrame:
    """reason, rows of stored changes that the source no longer has: `bad_root`; `superseded`, where the source has analysed the
    same upgrade again; `aged_out`, where it is older than what the source keeps; else `unexplained`. oldest: package, least."""
    extra = stored.join(source, ["upgrade", "line"], "left_anti")
    again = source.select("upgrade").distinct().withColumn("again", F.lit(True))
    out = extra.join(again, "upgrade", "left").join(oldest, "package", "left")
    reason = F.when(bad, "bad_root").when(F.col("again"), "superseded").when(F.col("released_at") < F.col("least"), "aged_out").otherwise("unexplained")
    return out.groupBy(reason.alias("reason")).agg(F.count("*").alias("rows"))


def why_kept(changes: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """reason, rows: the first of the named conditions that keeps each row, or `other`."""
    out = F.lit("other")
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return changes.groupBy(out.alias("reason")).agg(F.count("*").alias("rows"))


def name_counts(df: DataFrame, name: Column, of: str, example: str) -> DataFrame:
    """name, rows, groups, example: how often each name occurs, in how many groups, and the first example by name."""
    return df.groupBy(name.alias("name")).agg(F.count("*").alias("rows"), F.count_distinct(of).alias("groups"), F.min(example).alias("example"))


def overview(df: DataFrame, kind: str, users: str) -> DataFrame:
    """kind, rows, used, most_used of every kind and, as `all`, of all rows."""
    cols = [F.count("*").alias("rows"), F.count_if(F.col(users) > 0).alias("used"), F.max(users).alias("most_used")]
    return df.groupBy(F.col(kind).alias("kind")).agg(*cols).unionAll(df.agg(F.lit("all").alias("kind"), *cols))


def all_negative(folds: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """by, groups, all_negative: groups of each fold's validation rows, and those without a positive."""
    each = folds.where("role = 'validate'").groupBy("fold", *by).agg(F.sum(label).alias("p"))
    return each.groupBy("fold").agg(F.count("*").alias("groups"), F.count_if(F.col("p") == 0).alias("all_negative"))


def factorial(df: DataFrame, first: Column, second: Column, label: str) -> DataFrame:
    """The rate under each combination of two fixes, and what each adds to the rate without either."""
    cells = df.withColumns({"first": first, "second": second}).groupBy("first", "second").agg(F.count("*").alias("rows"), F.avg(label).alias("rate"))
    none = F.max(F.when(~F.col("first") & ~F.col("second"), F.col("rate"))).over(Window.partitionBy())  # four rows
    return cells.withColumn("effect", F.col("rate") - none)


def factorial_at(df: DataFrame, cuts: DataFrame, when: str, first: Column, second: Column, label: str) -> DataFrame:
    """cut, rows and rate of all four cells (`neither`, `first`, `second`, `both`) after each date, what either fix and both add to the rate
    of neither, and the interaction: what both add beyond the sum of the two. A cell without rows has a null rate."""
    held = df.withColumns({"__a": first, "__b": second}).join(F.broadcast(cuts.select("cut")), F.col(when) > F.col("cut"))  # a few cuts
    cells = {"neither": ~F.col("__a") & ~F.col("__b"), "first": F.col("__a") & ~F.col("__b"), "second": ~F.col("__a") & F.col("__b"), "both": F.col("__a") & F.col("__b")}
    out = held.groupBy("cut").agg(*[F.count_if(c).alias(f"rows_{n}") for n, c in cells.items()], *[F.avg(F.when(c, F.col(label))).alias(f"rate_{n}") for n, c in cells.items()])
    out = out.withColumns({f"{n}_adds": F.col(f"rate_{n}") - F.col("rate_neither") for n in ("first", "second", "both")})
    return out.withColumn("interaction", F.col("both_adds") - F.col("first_adds") - F.col("second_adds"))


def assert_reproduced(cells: DataFrame, known: DataFrame, columns: Sequence[str], digits: int = 6) -> None:
    """Refuses where the recomputed columns differ from those on record at a cut, or a cut of the record is missing."""
    a, b = cells.select("cut", *[F.round(c, digits).alias(f"a_{c}") for c in columns]), known.select("cut", *[F.round(c, digits).alias(f"b_{c}") for c in columns])
    both = b.join(a.withColumn("__here", F.lit(True)), "cut", "left")
    off = F.col("__here").isNull()
    for c in columns:
        off = off | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    wrong = sorted(str(r.cut) for r in both.where(off).select("cut").collect())  # a few cuts
    if wrong:
        raise Refused("not_reproduced", f"differs from the record at {', '.join(wrong)}")


def before_after(before: DataFrame, after: DataFrame, cuts: DataFrame, when: str, label: str) -> DataFrame:
    """cut, rows_before, rows_after, rate_before, rate_after at fixed dates of two data sets; a cut that either lacks is left out."""
    def side(df: DataFrame, name: str) -> DataFrame:
        held = df.join(F.broadcast(cuts.select("cut")), F.col(when) > F.col("cut"))  # a few cuts
        return held.groupBy("cut").agg(F.count("*").alias(f"rows_{name}"), F.avg(label).alias(f"rate_{name}"))

    return side(before, "before").join(side(after, "after"), "cut")


def labels_compared(sweeps: DataFrame, one: str, two: str) -> DataFrame:
    """cuts, worst, better: over the cuts at which both labels are measured, the least ratio of their lifts; the first label is
    better only if it is at its worst cut. sweeps: label, cut, measured, lift."""
    a = sweeps.where((F.col("label") == one) & F.col("measured")).select("cut", F.col("lift").alias("a"))
    b = sweeps.where((F.col("label") == two) & F.col("measured")).select("cut", F.col("lift").alias("b"))
    return a.join(b, "cut").agg(F.count("*").alias("cuts"), F.min(F.col("a") / F.col("b")).alias("worst"), F.coalesce(F.min(F.col("a") / F.col("b")) > 1, F.lit(False)).alias("better"))


def constant_baseline(df: DataFrame, label: str) -> DataFrame:
    """The average precision of one score for all rows, over all orders of them: the share of positives; its step form is the same."""
    return df.agg(F.avg(label).alias("pr_auc"), F.count("*").alias("rows"))
