"""Ranking metrics as plans: per-group precision and nDCG, average precision with ties, bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftrank.operators.relational import in_ranges
from driftrank.tables import park


def rankable(df: DataFrame, group: Sequence[str], label: str, k: int) -> DataFrame:
    """Rows of groups with a positive and more than k rows; null keys are no group."""
    w = Window.partitionBy(*group)
    known = df.dropna(subset=list(group))
    return known.withColumns({"__p": F.sum(label).over(w), "__n": F.count("*").over(w)}).where(f"__p > 0 and __n > {k}").drop("__p", "__n")


def _precisions(df: DataFrame, group: Sequence[str], label: str, order: Sequence[Column], k: int) -> DataFrame:
    """group, v"""
    w = Window.partitionBy(*group).orderBy(*order)
    top = rankable(df, group, label, k).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return top.groupBy(*group).agg((F.sum(label) / F.lit(float(k))).alias("v"))


def precision_at(df: DataFrame, group: Sequence[str], label: str, order: Sequence[Column], k: int) -> DataFrame:
    """The mean over rankable groups of positives among the first k, divided by k; 0 without such a group."""
    return _precisions(df, group, label, order, k).agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias(f"precision_at_{k}"), F.count("*").alias("groups"))


def _ndcgs(df: DataFrame, group: Sequence[str], label: str, order: Sequence[Column], k: int, gain: Column | None = None) -> DataFrame:
    """group, v"""
    rows = rankable(df, group, label, k).withColumn("__g", F.col(label).cast("double") if gain is None else gain)
    by_score, best = Window.partitionBy(*group).orderBy(*order), Window.partitionBy(*group).orderBy(F.desc("__g"))
    rows = rows.withColumns({"__i": F.row_number().over(by_score), "__j": F.row_number().over(best)})
    dcg = lambda at: F.sum(F.when(F.col(at) <= k, F.col("__g") / F.log2(F.col(at) + 1.0)).otherwise(0.0))
    return rows.groupBy(*group).agg((dcg("__i") / dcg("__j")).alias("v"))


def ndcg_at(df: DataFrame, group: Sequence[str], label: str, order: Sequence[Column], k: int, gain: Column | None = None) -> DataFrame:
    """The mean over rankable groups of DCG by `order` over the DCG of the group's own gains in descending order."""
    return _ndcgs(df, group, label, order, k, gain).agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias(f"ndcg_at_{k}"), F.count("*").alias("groups"))


def tie_runs(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """A row for each score: n rows, r positives, above and found before it, and the positives in all.

    Rows are reduced to one for each score before anything is ordered. Scores are ordered in ranges that hold equally many of
    them, of which only the sums meet in one task, so no task orders all scores, of one value of `by` neither.
    """
    runs = df.groupBy(*by, F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(label).cast("bigint").alias("r"))
    runs = in_ranges(runs, [*[F.col(c) for c in by], F.desc("score")], "__band")
    w = Window.partitionBy("__band", *by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"above": F.coalesce(F.sum("n").over(w), F.lit(0)), "found": F.coalesce(F.sum("r").over(w), F.lit(0))})
    sums = runs.groupBy("__band", *by).agg(F.sum("n").alias("__n"), F.sum("r").alias("__r"))
    every = Window.partitionBy(*by)  # a row a range, of each value of `by`
    before = every.orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__band", *[F.col(c).alias(f"__by_{c}") for c in by], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__above"), F.coalesce(F.sum("__r").over(before), F.lit(0)).alias("__found"), F.sum("__r").over(every).alias("positives"))
    on = runs["__band"] == sums["__band"]
    for c in by:
        on = on & runs[c].eqNullSafe(sums[f"__by_{c}"])
    out = runs.join(sums, on)
    return out.select(*[runs[c] for c in by], "score", "n", "r", (F.col("above") + F.col("__above")).alias("above"), (F.col("found") + F.col("__found")).alias("found"), "positives")


def harmonic(k: Column) -> Column:
    """H(k) for counts from 0 on: summed up to 32, by its asymptotic series beyond (off by under 1e-13 there)."""
    x = k.cast("double")
    near = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(k, F.lit(32)), F.lit(1)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1.0 / i.cast("double"))
    far = F.log(x) + F.lit(0.5772156649015329) + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4.0))) - 1 / (252 * F.pow(x, F.lit(6.0)))
    return F.when(k <= 0, 0.0).when(k <= 32, near).otherwise(far)


def _expected(n: Column, r: Column, above: Column, found: Column) -> Column:
    """What a run of n tied rows with r positives adds to average precision, on average over its orders, times all positives."""
    inv = harmonic(above + n) - harmonic(above)
    slope = F.when(n > 1, (r - 1) / (n - 1)).otherwise(0.0)
    return F.when(r > 0, r / n * ((found + 1) * inv + slope * (n - (above + 1) * inv))).otherwise(0.0)


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """pr_auc_step (one threshold a score), pr_auc_ties (mean over all orders of tied rows), floor (share of positives)."""
    runs = tie_runs(df, score, label, by)
    n, r, above, found = (F.col(c) for c in ("n", "r", "above", "found"))
    return runs.groupBy(*by).agg(
        (F.sum(r * (found + r) / (above + n)) / F.max("positives")).alias("pr_auc_step"),
        (F.sum(_expected(n, r, above, found)) / F.max("positives")).alias("pr_auc_ties"),
        (F.sum(r) / F.sum(n)).alias("floor"),
    )


# ---- intervals: whole groups drawn with replacement

#: Cells of one score beyond which their weighted sums are made before scores are ordered.
HOT_CELLS = 1 << 16
_CHUNK = 512
_GATHERED = 1 << 16
#: Bytes of vectors that a task holds before it gives them out.
HELD = 1 << 26


def _poisson_table() -> np.ndarray:
    """The weight that each 16-bit number stands for, by the distribution of Poisson(1)."""
    p, total, steps = math.exp(-1), 0.0, []
    for i in range(12):
        total += p
        steps.append(total)
        p /= i + 1
    return np.searchsorted(np.array(steps), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


_POISSON = _poisson_table()


def weights(g: np.ndarray, draws: int, seed: int = 0) -> np.ndarray:
    """A row for each group hash: its weight in each draw. A group's weights need no other group, so no list of groups is drawn from."""
    u = np.uint64
    quarter = np.arange(-(-draws // 4), dtype=u)
    x = g.astype(np.int64).view(u)[:, None] * u(0x9E3779B97F4A7C15) + (quarter + u(seed * 0x1000003 + 1)) * u(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> u(shift))) * u(factor)
    x ^= x >> u(31)
    return _POISSON[np.ascontiguousarray(x).view(np.uint16)][:, :draws]


def _gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """frames put together to _GATHERED rows or more."""
    held: list[pd.DataFrame] = []
    for f in frames:
        held.append(f)
        if sum(map(len, held)) >= _GATHERED:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def weighed_sums(df: DataFrame, by: Sequence[str], values: Sequence[str], draws: int, seed: int = 0) -> DataFrame:
    """by, draw and, for each value, its sum over the rows times the weight of their group `g` (a hash) in the draw.

    Each task adds up vectors of all draws for the keys it meets, so no row is multiplied by the draws; it gives them out when they
    fill HELD bytes. Rows are gathered to _GATHERED before they are told apart by key, so that a key's rows are added at once.
    """
    most_keys = max(HELD // (8 * draws * len(values)), 1)
    schema = T.StructType([df.schema[c] for c in by] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in values])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def told() -> pd.DataFrame:
            out = pd.DataFrame(list(held), columns=list(by)) if by else pd.DataFrame(index=range(len(held)))
            for i, c in enumerate(values):
                out[c] = [v[i] for v in held.values()]
            held.clear()
            return out

        for f in _gathered(frames):
            parts = f.groupby(list(by), dropna=False, sort=False) if by else [((), f)]
            for key, part in parts:
                key = tuple(None if k != k else k for k in (key if isinstance(key, tuple) else (key,)))
                for at in range(0, len(part), _CHUNK):
                    rows = part.iloc[at : at + _CHUNK]
                    sums = rows[list(values)].to_numpy(np.float64).T @ weights(rows["g"].to_numpy(np.int64), draws, seed).astype(np.float64)
                    held[key] = held[key] + sums if key in held else sums
                if len(held) >= most_keys:
                    yield told()
        if held:
            yield told()

    zipped = F.posexplode(F.arrays_zip(*values))
    each = df.select(*by, "g", *values).mapInPandas(run, schema).select(*by, zipped.alias("draw", "x"))
    return each.groupBy(*by, "draw").agg(*[F.sum(F.col("x")[c]).alias(c) for c in values])


def _harmonic(k: np.ndarray) -> np.ndarray:
    """H(k) of whole numbers from 0 on."""
    x = np.maximum(k, 32.0)
    far = np.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return np.where(k < 32, _FIRST_HARMONIC[np.minimum(k, 31).astype(np.int64)], far)


_FIRST_HARMONIC = np.concatenate([[0.0], np.cumsum(1 / np.arange(1.0, 32))])


def _expected_each(n: np.ndarray, r: np.ndarray, above: np.ndarray, found: np.ndarray) -> np.ndarray:
    """What _expected gives, over arrays."""
    inv = _harmonic(above + n) - _harmonic(above)
    slope = np.where(n > 1, (r - 1) / np.maximum(n - 1, 1), 0.0)
    return np.where(r > 0, r / np.maximum(n, 1) * ((found + 1) * inv + slope * (n - (above + 1) * inv)), 0.0)


class _Runs:
    """Scores of one range in falling order, each a run of weighted rows and positives in every draw."""

    def __init__(self, above: np.ndarray, found: np.ndarray) -> None:
        self.above, self.found, self.score = above.copy(), found.copy(), None
        self.n, self.r, self.total = np.zeros_like(above), np.zeros_like(above), np.zeros_like(above)

    def add(self, scores: np.ndarray, n: np.ndarray, r: np.ndarray) -> None:
        """Weighted rows and positives of distinct falling scores; the first may go on with the last run."""
        if self.score is not None and scores[0] == self.score:
            n[0] += self.n
            r[0] += self.r
        else:
            self.close()
        n_, r_ = n[:-1], r[:-1]
        if len(n_):
            above, found = self.above + np.cumsum(n_, 0) - n_, self.found + np.cumsum(r_, 0) - r_
            self.total += _expected_each(n_, r_, above, found).sum(0)
            self.above, self.found = above[-1] + n_[-1], found[-1] + r_[-1]
        self.score, self.n, self.r = scores[-1], n[-1], r[-1]

    def close(self) -> None:
        if self.score is not None:
            self.total += _expected_each(self.n, self.r, self.above, self.found)
            self.above, self.found, self.score = self.above + self.n, self.found + self.r, None


def _draws_of_precision(df: DataFrame, group: Sequence[str], score: str, label: str, draws: int, seed: int) -> DataFrame:
    """draw, v: tie-averaged average precision of each draw, null without a positive. A missing score comes last.

    Rows are summed to cells of group and score, and cells dealt to ranges of scores. A first pass gives each range's weighted rows
    and positives in every draw, of which the ranges above a range follow; a second one walks each range's scores from there.
    """
    cells = park(df.groupBy(F.xxhash64(*group).alias("g"), F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("score")).agg(F.count("*").cast("double").alias("n"), F.sum(label).cast("double").alias("r")), "cells")
    hot = park(cells.groupBy("score").agg(F.count("*").alias("c")).where(F.col("c") > HOT_CELLS).select("score"), "hot-scores")
    vectors = weighed_sums(cells.join(hot, "score", "left_semi"), ["score"], ["n", "r"], draws, seed)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("draw", c))), lambda x: x[c]).alias(f"{c}s")
    vectors = park(vectors.groupBy("score").agg(listed("n"), listed("r")), "hot-sums")
    cold = cells.join(hot, "score", "left_anti").unionByName(hot.select(F.lit(None).cast("long").alias("g"), "score", F.lit(0.0).alias("n"), F.lit(0.0).alias("r")))
    banded = in_ranges(cold, [F.desc("score")], "band")
    marks = banded.where("g is null").select("band", "score").join(vectors, "score")
    sums = weighed_sums(banded.where("g is not null"), ["band"], ["n", "r"], draws, seed)
    sums = sums.unionByName(marks.select("band", F.posexplode(F.arrays_zip("ns", "rs")).alias("draw", "x")).select("band", "draw", F.col("x.ns").alias("n"), F.col("x.rs").alias("r")))
    sums = park(sums.groupBy("band", "draw").agg(F.sum("n").alias("n"), F.sum("r").alias("r")), "range-sums")
    before = Window.partitionBy("draw").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    heads = sums.select("band", "draw", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in ("n", "r")]).groupBy("band").agg(listed("n"), listed("r"))
    none = F.lit(None).cast("array<double>")
    stream = banded.where("g is not null").select("band", F.lit(1).alias("kind"), "score", "g", "n", "r", none.alias("ns"), none.alias("rs"))
    stream = stream.unionByName(marks.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(heads.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    stream = stream.withColumn("g", F.coalesce("g", F.lit(0)))  # a null would turn hashes into floating-point numbers
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = stream.repartition(parts, "band").sortWithinPartitions("band", "kind", F.desc("score"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, total = None, np.zeros(draws)

        def walk(f: pd.DataFrame) -> None:
            for at in range(0, len(f), _CHUNK):
                c = f.iloc[at : at + _CHUNK]
                s, w = c["score"].to_numpy(np.float64), weights(c["g"].to_numpy(np.int64), draws, seed).astype(np.float64)
                first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                runs.add(s[first], np.add.reduceat(w * c["n"].to_numpy(np.float64)[:, None], first), np.add.reduceat(w * c["r"].to_numpy(np.float64)[:, None], first))

        for f in frames:
            whole = np.flatnonzero(f["ns"].notna().to_numpy())  # heads of ranges, and scores whose sums are made
            at = 0
            for i in [*whole.tolist(), len(f)]:
                if i > at:
                    walk(f.iloc[at:i])
                if i < len(f):
                    x = f.iloc[i]
                    n, r = np.array(x["ns"], np.float64), np.array(x["rs"], np.float64)
                    if x["kind"] == 0:
                        if runs:
                            runs.close()
                            total += runs.total
                        runs = _Runs(n, r)
                    else:
                        runs.add(np.array([x["score"]]), n[None, :], r[None, :])
                at = i + 1
        if runs:
            runs.close()
            yield pd.DataFrame({"draw": np.arange(draws), "v": total + runs.total})

    found = ordered.mapInPandas(run, "draw int, v double").groupBy("draw").agg(F.sum("v").alias("v"))
    positives = sums.groupBy("draw").agg(F.sum("r").alias("r"))
    return found.join(positives, "draw").select("draw", (F.col("v") / F.nullif("r", F.lit(0.0))).alias("v"))


def band(value: str) -> list[Column]:
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return [q[0].alias("low"), q[1].alias("high")]


def bootstrap(df: DataFrame, group: Sequence[str], score: str, label: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """low, high: 2.5 and 97.5 percentiles of tie-averaged average precision when whole groups are drawn with replacement."""
    each = _draws_of_precision(df, group, score, label, draws, seed)
    return each.where("v is not null").agg(*band("v"), F.count("*").alias("draws"))


def intervals(df: DataFrame, group: Sequence[str], score: str, other: str, label: str, order: Sequence[Column], draws: int = 2000, seed: int = 0) -> DataFrame:
    """quantity, low, high, draws: bands of pr_auc, baseline_pr_auc (that of `other`), their lift in the same draw,
    precision_at_10 and ndcg_at_20 by `order`. A draw without a positive, or without a rankable group, is left out."""
    slim = park(df.select(*dict.fromkeys([*group, score, other, label])), "scored-rows")  # read for both scores
    a, b = (_draws_of_precision(slim, group, x, label, draws, seed) for x in (score, other))
    pair = a.withColumnRenamed("v", "a").join(b.withColumnRenamed("v", "b"), "draw")
    named = F.array(*[F.struct(F.lit(x).alias("quantity"), v.alias("v")) for x, v in (("pr_auc", F.col("a")), ("baseline_pr_auc", F.col("b")), ("lift", F.try_divide("a", "b")))])
    out = pair.select(F.explode(named).alias("x")).select("x.*")
    for name, each in (("precision_at_10", _precisions(df, group, label, order, 10)), ("ndcg_at_20", _ndcgs(df, group, label, order, 20))):
        sums = weighed_sums(each.select(F.xxhash64(*group).alias("g"), "v", F.lit(1.0).alias("one")), [], ["v", "one"], draws, seed)
        mean = sums.select("draw", F.try_divide("v", "one").alias("v"))
        out = out.unionAll(mean.select(F.lit(name).alias("quantity"), "v"))
    return out.where("v is not null").groupBy("quantity").agg(*band("v"), F.count("*").alias("draws"))


def bundle(df: DataFrame, scores: dict[str, str], label: str, over: str) -> DataFrame:
    """quantity, value: the tie-averaged average precision of each named score, the floor, and each score's lift over the one named `over`."""
    each = [average_precision(df, column, label).select(F.lit(name).alias("quantity"), F.col("pr_auc_ties").alias("value"), "floor") for name, column in scores.items()]
    out = each[0]
    for x in each[1:]:
        out = out.unionAll(x)
    base = F.max(F.when(F.col("quantity") == over, F.col("value"))).over(Window.partitionBy())  # a row a score
    lifts = out.withColumn("base", base).where(F.col("quantity") != over).select(F.concat("quantity", F.lit(f"_over_{over}")).alias("quantity"), (F.col("value") / F.col("base")).alias("value"))
    return out.select("quantity", "value").unionAll(lifts).unionAll(each[0].select(F.lit("floor"), "floor"))


def lift_bands(df: DataFrame, group: Sequence[str], score: str, others: dict[str, str], label: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """quantity (`lift_over_` each name), low, high, draws: bands of the score's lift over each of the others in the same draws."""
    df = park(df.select(*dict.fromkeys([*group, score, *others.values(), label])), "scored-rows")  # read for each score
    own = _draws_of_precision(df, group, score, label, draws, seed).withColumnRenamed("v", "a")
    for name, column in others.items():
        own = own.join(_draws_of_precision(df, group, column, label, draws, seed).withColumnRenamed("v", f"__{name}"), "draw")
    lifts = F.array(*[F.struct(F.lit(f"lift_over_{n}").alias("quantity"), F.try_divide("a", f"__{n}").alias("v")) for n in others])
    return own.select(F.explode(lifts).alias("x")).select("x.*").where("v is not null").groupBy("quantity").agg(*band("v"), F.count("*").alias("draws"))


def first_places(df: DataFrame, group: Sequence[str], score: str, label: str, ties: Sequence[str]) -> DataFrame:
    """quantity, value: mean precision_at_10 and ndcg_at_20 of the groups by a named score, ties by the given columns."""
    order = [F.desc(score), *[F.asc(c) for c in ties]]
    each = {"precision_at_10": _precisions(df, group, label, order, 10), "ndcg_at_20": _ndcgs(df, group, label, order, 20)}
    out = [x.agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("value")).select(F.lit(f"{score}_{n}").alias("quantity"), "value") for n, x in each.items()]
    return out[0].unionAll(out[1])


# What a version step promises.
STEP_SCORE = {"major": 3.0, "minor": 2.0, "patch": 1.0, "other": 0.0}


def step_score(bump: Column) -> Column:
    out = F.lit(0.0)
    for name, value in STEP_SCORE.items():
        out = F.when(bump == name, value).otherwise(out)
    return out


def popularity(rank: Column, over: Sequence[str] = ()) -> Column:
    """Rank 1 scores highest; a missing rank counts as the worst one seen."""
    return -F.coalesce(rank, F.max(rank).over(Window.partitionBy(*over))).cast("double")


def with_path_score(df: DataFrame, depth: str, name: str = "path") -> DataFrame:
    """Shortest path first; a missing depth counts as the deepest seen."""
    deepest = df.agg(F.coalesce(F.max(depth), F.lit(0)).alias("__deepest"))
    joined = df.join(F.broadcast(deepest))  # one row
    return joined.withColumn(name, -F.coalesce(depth, "__deepest").cast("double")).drop("__deepest")


def kind_prior(train: DataFrame, test: DataFrame, kind: str, label: str) -> DataFrame:
    """The training rate of each row's kind; an unseen kind takes the overall training rate."""
    rates = train.groupBy(F.col(kind).alias("__k")).agg(F.avg(label).alias("__rate"))
    whole = train.agg(F.avg(label).alias("__all"))
    out = test.join(rates, test[kind].eqNullSafe(rates["__k"]), "left").join(F.broadcast(whole))  # one row
    return out.withColumn("kind_prior", F.coalesce("__rate", "__all")).drop("__k", "__rate", "__all")


NEED, MARGIN = 6, 1.25


def verdict(pairs: DataFrame, model: str, other: str) -> DataFrame:
    """outcome: `model` where at least NEED of the ratios are above 1 and their median is MARGIN or more, `path` the other way round, else `none`."""
    ratio = F.round(F.col(model) / F.col(other), 4)
    got = pairs.select(ratio.alias("x")).agg(F.count("*").alias("n"), F.count_if(F.col("x") > 1).alias("wins"), F.count_if(F.col("x") < 1).alias("losses"), F.median("x").alias("median"))
    outcome = (
        F.when((F.col("wins") >= NEED) & (F.col("median") >= MARGIN - 1e-9), "model")
        .when((F.col("losses") >= NEED) & (F.col("median") <= 1 / MARGIN + 1e-9), "path").otherwise("none")
    )
    return got.withColumn("outcome", outcome)
