"""PEP 440 versions as an orderable column.

The key is a struct (epoch, release without trailing zeros, pre rank, pre number, post, dev); Spark orders structs and
arrays lexicographically, so it sorts, compares and ranges like the versions. Local labels (`+x`) don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = (
    r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)"
    r"(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?"
    r"(?:[-_.]?(dev)[-_.]?(\d*))?"
    r"(?:\+[a-z0-9]+(?:[-_.][a-z0-9]+)*)?\s*$"
)
NO_DEV = 1 << 31


def _part(v: Column, i: int) -> Column:
    return F.regexp_extract(v, PATTERN, i)


def _number(text: Column, missing: int) -> Column:
    return F.when(text == "", F.lit(missing)).otherwise(text.try_cast("bigint"))


def is_valid(v: Column) -> Column:
    return F.coalesce(v.rlike(PATTERN), F.lit(False))


def release(v: Column) -> Column:
    """The release numbers, null for what is no version."""
    return F.when(is_valid(v), F.transform(F.split(_part(v, 2), r"\."), lambda x: x.try_cast("bigint")))


def key(v: Column) -> Column:
    """The sort key, null for what is no version."""
    numbers = release(v)
    last = F.aggregate(F.sequence(F.lit(1), F.size(numbers)), F.lit(0), lambda acc, i: F.when(F.element_at(numbers, i) != 0, i).otherwise(acc))
    letter = F.lower(_part(v, 3))
    has_post = (_part(v, 5) != "") | (_part(v, 6) != "")
    has_dev = _part(v, 8) != ""
    rank = (
        F.when(letter.isin("a", "alpha"), 1).when(letter.isin("b", "beta"), 2).when(letter != "", 3)
        .when(has_dev & ~has_post, 0).otherwise(4)
    )
    return F.when(
        is_valid(v),
        F.struct(
            _number(_part(v, 1), 0).alias("epoch"),
            F.slice(numbers, F.lit(1), last).alias("release"),
            rank.alias("pre_rank"),
            F.when(letter != "", _number(_part(v, 4), 0)).otherwise(F.lit(0)).alias("pre"),
            F.when(_part(v, 5) != "", _number(_part(v, 5), 0)).when(_part(v, 6) != "", _number(_part(v, 7), 0)).otherwise(F.lit(-1)).alias("post"),
            F.when(has_dev, _number(_part(v, 9), 0)).otherwise(F.lit(NO_DEV)).alias("dev"),
        ),
    )


def is_dev(v: Column) -> Column:
    return is_valid(v) & (_part(v, 8) != "")


def is_pre(v: Column) -> Column:
    return is_valid(v) & ((_part(v, 3) != "") | (_part(v, 8) != ""))


def bump(old: Column, new: Column) -> Column:
    """major, minor or patch by the first of three release numbers that differs, else other."""
    at = lambda v, i: F.coalesce(F.try_element_at(release(v), F.lit(i)), F.lit(0))
    return (
        F.when(~is_valid(old) | ~is_valid(new), "other")
        .when(at(old, 1) != at(new, 1), "major").when(at(old, 2) != at(new, 2), "minor").when(at(old, 3) != at(new, 3), "patch")
        .otherwise("other")
    )


def skip_reason(v: Column, yanked: Column, has_source: Column) -> Column:
    """Why a release is left out, in this order; null for one that is kept."""
    return (
        F.when(~is_valid(v), "unparseable").when(is_dev(v), "dev").when(is_pre(v), "prerelease")
        .when(yanked, "yanked").when(~has_source, "no_source")
    )
