"""Alias graphs, prefix rewriting, inheritance folding, snapshot diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftrank.functions.names import depth, root
from driftrank.tables import park, release


def alias_closure(edges: DataFrame, hops: int = 10) -> DataFrame:
    """alias, target: where each alias ends within `hops` steps. edges: alias, target, one target an alias.

    Aliases that run into a cycle or need more steps give nothing; an alias of itself is dropped. Each round squares the
    distance covered, so ten hops take four joins, and fewer where a round lengthens none; what went further than `hops` by then is left out.
    """
    edges = edges.where("alias <> target").select("alias", "target")
    now = edges.withColumn("steps", F.lit(1))
    last, most = None, hops
    while hops > 1:
        nxt = now.select(F.col("alias").alias("target"), F.col("target").alias("far"), F.col("steps").alias("more"))
        joined = now.join(nxt, "target", "left")
        now = park(joined.select("alias", F.coalesce("far", "target").alias("target"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("far").isNotNull().alias("longer")), "closure")
        if last:
            release(last)
        last = now
        if now.where("longer").isEmpty():
            break
        hops = -(-hops // 2)
    ends = now.join(edges.select(F.col("alias").alias("target")), "target", "left_anti")
    return ends.where(F.col("steps") <= most).select("alias", "target")


def reversed_aliases(closure: DataFrame, roots: Sequence[str]) -> DataFrame:
    """target, aliases (sorted) of targets under the given roots."""
    return closure.where(root(F.col("target")).isin(*roots)).groupBy("target").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def other_paths(symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """symbol, paths: shorter names, or names as long under another root, that an alias of some prefix gives.

    Each symbol's prefixes are joined with alias targets by equality; no pair of rows is compared.
    """
    parts = F.split("symbol", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    each = symbols.select("symbol").distinct().select("symbol", F.explode(prefixes).alias("target"))
    hit = each.join(aliases.select("target", "alias"), "target").select("symbol", F.concat("alias", F.substr("symbol", F.length("target") + 1)).alias("path"))
    less = depth(F.col("path")) < depth(F.col("symbol"))
    level = (depth(F.col("path")) == depth(F.col("symbol"))) & (root(F.col("path")) != root(F.col("symbol")))
    return hit.where(less | level).groupBy("symbol").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def fold_inherited(rows: DataFrame) -> DataFrame:
    """Rows with `defined_at` (the member they inherit, null for a member itself) folded onto that member.

    The defining member's row gets inherited_by, the number of rows folded into it; where it has no row, the shallowest,
    then first by name, of the inheritors stands for it and counts the others.
    """
    target = F.coalesce("defined_at", "symbol")
    keyed = rows.withColumns({"target": target, "own": F.col("defined_at").isNull()})
    best = F.min_by("symbol", F.struct(~F.col("own"), depth(F.col("symbol")).alias("d"), "symbol"))
    return keyed.groupBy("package", "target", "kind", "sub_target").agg(best.alias("symbol"), (F.count("*") - 1).alias("inherited_by"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """key, change: `removed`, `added` or `changed` between two snapshots."""
    a = old.select(*key, F.struct(*values).alias("__a"))
    b = new.select(*key, F.struct(*values).alias("__b"))
    change = F.when(F.col("__b").isNull(), "removed").when(F.col("__a").isNull(), "added").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return a.join(b, list(key), "full_outer").select(*key, change.alias("change")).where("change is not null")


def consecutive(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """value_from, value_to of each pair of neighbours in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumns({"value_from": F.lag(value).over(w), "value_to": F.col(value)}).where("value_from is not null").select(*key, "value_from", "value_to")
