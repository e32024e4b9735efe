"""Requirements files as rows: logical lines, exact pins, and why a line is no pin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftrank.functions.names import canonical
from driftrank.functions.versions import is_valid

_NAME = r"([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)"
_EXTRAS = r"\s*(?:\[[A-Za-z0-9._,\s-]*\])?"
_CLAUSE = r"(?:===|==|~=|!=|<=|>=|<|>)\s*[^\s,;()]+"
REQUIREMENT = rf"^{_NAME}{_EXTRAS}\s*(?:@\s*(\S+)|\(?\s*((?:{_CLAUSE}(?:\s*,\s*{_CLAUSE})*)?)\s*,?\s*\)?)\s*(?:;.*)?$"


# What is said of a line that is no pin.
OPTION = "pip option, not a package"
UNREADABLE = "could not read this line as a requirement"
ELSEWHERE = "installed from a URL or a path, not from PyPI"
UNVERSIONED = "no version given (pin it with == to compare)"
INEXACT = "not pinned to one exact version (use ==)"
INVALID = "the pinned version is not a valid version number"
AGAIN = "%s is already pinned on line %d"


def logical_lines(files: DataFrame) -> DataFrame:
    """file, line_number, line: lines that end in a backslash joined with what follows, numbered by their first. files: file, text."""
    lines = files.select("file", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("i", "raw")).withColumn("raw", F.rtrim("raw"))
    w = Window.partitionBy("file").orderBy("i")
    goes_on = F.col("raw").endswith("\\")
    lines = lines.withColumns({"goes_on": goes_on, "fresh": ~F.coalesce(F.lag(goes_on).over(w), F.lit(False))})
    lines = lines.withColumn("block", F.sum(F.col("fresh").cast("int")).over(w))
    part = F.when(F.col("goes_on"), F.expr("left(raw, length(raw) - 1)")).otherwise(F.col("raw"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", part.alias("p")))), lambda x: x["p"]), " ")
    return lines.groupBy("file", "block").agg((F.min("i") + 1).alias("line_number"), joined.alias("line")).drop("block")


def parse(files: DataFrame, most_shown: int = 200) -> DataFrame:
    """file, line_number, name, version, reason, shown: one row a line that is not blank; reason is null for a pin that counts."""
    line = F.trim(F.split("line", r"(?<!\S)#", 2)[0])
    rows = logical_lines(files).select("file", "line_number", F.left(F.trim("line"), F.lit(most_shown)).alias("shown"), line.alias("line")).where("line <> ''")
    bare = F.rtrim(F.split("line", r"\s--(?=\w)", 2)[0])
    group = lambda i: F.regexp_extract(bare, REQUIREMENT, i)
    spec, pin = group(3), F.regexp_extract(group(3), r"^={2,3}\s*([^\s,*]+)$", 1)
    rows = rows.withColumns({"option": F.col("line").startswith("-"), "reads": bare.rlike(REQUIREMENT), "url": group(2), "spec": spec, "version": pin, "name": canonical(group(1))})
    reason = (
        F.when(F.col("option"), OPTION)
        .when(~F.col("reads"), UNREADABLE)
        .when(F.col("url") != "", ELSEWHERE)
        .when(F.col("spec") == "", UNVERSIONED)
        .when(F.col("version") == "", INEXACT)
        .when(~is_valid(F.col("version")), INVALID)
    )
    rows = rows.withColumn("reason", reason)
    w = Window.partitionBy("file", "name", F.col("reason").isNull()).orderBy("line_number")
    first = F.first("line_number").over(w)
    again = F.col("reason").isNull() & (F.col("line_number") > first)
    rows = rows.withColumn("first", first)
    pinned = F.col("reason").isNull() & ~again
    return rows.select(
        "file", "line_number", F.when(pinned, F.col("name")).alias("name"), F.when(pinned, F.col("version")).alias("version"),
        F.when(again, F.format_string(AGAIN, "name", "first")).otherwise(F.col("reason")).alias("reason"), "shown",
    )


def pins(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is null").select("file", "name", "version", "line_number")
