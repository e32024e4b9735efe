"""Views for looking at a table of changes: by package, by kind, what was removed, one package, one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftrank.operators.store import Refused

# The kinds that can plausibly break somebody, and the kind of a removal.
SERIOUS = ("OBJECT_REMOVED", "PARAMETER_REMOVED", "PARAMETER_ADDED_REQUIRED")
REMOVED = "OBJECT_REMOVED"
SHOWN = 60


def by_package(changes: DataFrame) -> DataFrame:
    """package, rows, pairs (of versions), share of all rows."""
    each = changes.groupBy("package", "version_from", "version_to").agg(F.count("*").alias("n")).groupBy("package").agg(F.sum("n").alias("rows"), F.count("*").alias("pairs"))
    return each.join(F.broadcast(changes.agg(F.count("*").alias("__n"))), how="left").withColumn("share", F.col("rows") / F.col("__n")).drop("__n")  # one row


def by_kind(changes: DataFrame) -> DataFrame:
    """kind, rows, share, serious; and a row each for `serious` and `other` kinds together, told by level 1 instead of 0."""
    each = changes.groupBy("kind").agg(F.count("*").alias("rows")).withColumn("serious", F.coalesce(F.col("kind").isin(*SERIOUS), F.lit(False)))
    named = F.when(F.grouping("kind") == 0, F.col("kind")).when(F.col("serious"), "serious").otherwise("other")
    sums = each.rollup("serious", "kind").agg(F.sum("rows").alias("rows"), F.grouping("kind").alias("level"), F.grouping("serious").alias("whole"), named.alias("name"))
    whole = sums.where("whole = 1").select(F.col("rows").alias("__n"))
    return sums.where("whole = 0").join(F.broadcast(whole)).select(F.col("name").alias("kind"), "level", "rows", (F.col("rows") / F.col("__n")).alias("share"), "serious")  # one row


def removed(changes: DataFrame) -> DataFrame:
    """package, flag (`private` or `public`), symbol, version_from, version_to, depth of each removed object."""
    flag = F.when(F.col("is_private"), "private").otherwise("public")
    return changes.where(F.col("kind") == REMOVED).select("package", flag.alias("flag"), "symbol", "version_from", "version_to", "depth")


def of_package(changes: DataFrame, name: str, column: str = "package") -> DataFrame:
    """One package's changes, its name in any case: version_from, version_to, in_pair (changes of the pair), mark (`!` for removals), kind, symbol."""
    rows = changes.where(F.lower(F.col(column)) == name.lower())
    if rows.limit(1).isEmpty():
        raise Refused("no_rows", f"no rows for {name}")
    sizes = rows.groupBy(F.col("version_from").alias("__from"), F.col("version_to").alias("__to")).agg(F.count("*").alias("in_pair"))
    mark = F.when(F.col("kind") == REMOVED, "!").otherwise(" ")
    joined = rows.join(sizes, F.col("version_from").eqNullSafe(F.col("__from")) & F.col("version_to").eqNullSafe(F.col("__to")))
    return joined.select("version_from", "version_to", "in_pair", mark.alias("mark"), "kind", "symbol")


def shown(value: Column) -> Column:
    """A value as text, cut to SHOWN characters with dots."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(F.length(text) > SHOWN, F.concat(F.substring(text, 1, SHOWN - 3), F.lit("..."))).otherwise(text)


def cards(changes: DataFrame, key: Sequence[str], meanings: dict[str, str]) -> DataFrame:
    """Rows column by column: key, place, name, value, meaning, for each column that has a meaning."""
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("name"), shown(F.col(c)).alias("value"), F.lit(m).alias("meaning")) for i, (c, m) in enumerate(meanings.items())])
    return changes.select(*key, F.explode(cells).alias("cell")).select(*key, "cell.*")


def card(changes: DataFrame, at: Column, key: Sequence[str], meanings: dict[str, str]) -> DataFrame:
    """The row at `at`, column by column."""
    one = changes.where(at)
    if one.limit(1).isEmpty():
        raise Refused("no_row", "no such row")
    return cards(one, key, meanings)
