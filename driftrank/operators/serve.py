"""Served queries: the ranked changes of a release, a requirements file against what came after its pins, sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftrank.functions import versions
from driftrank.functions.names import canonical
from driftrank.operators import requirements
from driftrank.operators.relational import keep_one
from driftrank.tables import park

# The wording of each kind of change; %1$s is the symbol, %2$s the parameter or base.
SENTENCES = {
    "OBJECT_REMOVED": "%1$s was removed.",
    "PARAMETER_REMOVED": "The %2$s parameter was removed from %1$s.",
    "PARAMETER_ADDED_REQUIRED": "%1$s now requires a %2$s argument.",
    "PARAMETER_CHANGED_REQUIRED": "The %2$s parameter of %1$s is now required.",
    "PARAMETER_CHANGED_KIND": "The %2$s parameter of %1$s changed kind.",
    "PARAMETER_MOVED": "Parameters of %1$s were reordered.",
    "RETURN_CHANGED_TYPE": "%1$s now returns a different type.",
    "ATTRIBUTE_CHANGED_TYPE": "The type of %1$s changed.",
    "ATTRIBUTE_CHANGED_VALUE": "The value of %1$s changed.",
    "CLASS_REMOVED_BASE": "%1$s no longer inherits from %2$s.",
    "OBJECT_CHANGED_KIND": "%1$s changed from one kind of object to another.",
}
SCANNED = "~1,500"


def sentence(kind: Column, symbol: Column, sub_target: Column, users: Column, inherited: Column, detail: Column) -> Column:
    """The display sentence. detail: map of strings; a key that is missing falls back to the general sentence."""
    text = F.lit(None).cast("string")
    for k, form in SENTENCES.items():
        text = F.when(kind == k, F.format_string(form, symbol, sub_target)).otherwise(text)
    default = F.concat(F.lit("The default for "), sub_target, F.lit(" in "), symbol, F.lit(" changed from "), detail["old_value"], F.lit(" to "), detail["new_value"], F.lit("."))
    text = F.coalesce(F.when(kind == "PARAMETER_CHANGED_DEFAULT", default).otherwise(text), F.concat(symbol, F.lit(" changed in this release.")))
    used = F.concat(F.lit(" "), F.format_number(users, 0), F.lit(f" of the {SCANNED} scanned packages "), F.when(users == 1, "imports").otherwise("import"), F.lit(" it."))
    heirs = F.concat(F.lit(" It affects "), F.format_number(inherited, 0), F.lit(" inheriting "), F.when(inherited == 1, "class").otherwise("classes"), F.lit("."))
    told = lambda key, words: F.when(F.coalesce(detail[key], F.lit("")) != "", F.concat(F.lit(f" {words} "), detail[key], F.lit("."))).otherwise("")
    return F.concat(
        text, F.when(users > 0, used).otherwise(""), F.when(inherited > 0, heirs).otherwise(""),
        told("was_deprecated_in", "It was already marked deprecated in"), told("moved_to", "It appears to have moved to"),
    )


def hot_order(score: str = "score", users: str = "user_count", ties: Sequence[str] = ("symbol", "sub_target")) -> list[Column]:
    """Scored rows first by score, unscored ones by use, then by name."""
    return [F.col(score).desc_nulls_last(), F.when(F.col(score).isNull(), F.col(users)).desc(), *[F.col(t).asc() for t in ties]]


def with_signals(changes: DataFrame, usage: DataFrame, prediction: DataFrame, key: Sequence[str], model: str) -> DataFrame:
    """changes with user_count and the score of one model; both sides are left joins, the model is part of the join."""
    chosen = prediction.where(F.col("model_version") == model).select(*key, "score")  # so a row that only another model scored stays, unscored
    out = changes.join(chosen, list(key), "left").join(usage.select("symbol", "user_count"), "symbol", "left")
    return out.withColumn("user_count", F.coalesce("user_count", F.lit(0)))


def release_pages(wanted: DataFrame, packages: DataFrame, releases: DataFrame, changes: DataFrame, usage: DataFrame, prediction: DataFrame, model: str, limit: int = 20, include_private: bool = False) -> DataFrame:
    """name, version, status, ranking, total, n_imported and the first `limit` changes (rn, symbol, kind, sub_target, score, user_count) of each wanted release.

    wanted: name, version; packages: package, name; releases: package, version, upgrade, status; changes: upgrade, line, symbol,
    kind, sub_target, is_private; prediction: upgrade, line, model_version, score. What is not known has one row, `not_tracked`; a
    known release without changes has one row with its status and totals of 0.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit is from 1 to 100")
    held = packages.select("package", "name").join(releases.select("package", "version", "upgrade", "status"), "package").drop("package")
    found = wanted.select("name", "version").distinct().join(held, ["name", "version"], "left")
    rows = changes.select("upgrade", "line", "symbol", "kind", "sub_target", "is_private").join(found.select("upgrade").distinct(), "upgrade", "left_semi")
    ranked = rank_releases(with_signals(rows, usage, prediction, ["upgrade", "line"], model), "upgrade", limit, include_private)
    ranked = ranked.select("upgrade", "ranking", "total", "n_imported", "rn", "symbol", "kind", "sub_target", "score", "user_count")
    out = found.join(ranked, "upgrade", "left")
    known = F.col("upgrade").isNotNull()
    return out.select(
        "name", "version", F.when(known, F.col("status")).otherwise("not_tracked").alias("status"), F.when(known, F.when(F.col("ranking") == "model", "model").otherwise("usage_fallback")).alias("ranking"),
        *[F.when(known, F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in ("total", "n_imported")], F.col("rn").cast("bigint").alias("rn"), "symbol", "kind", "sub_target", "score", "user_count",
    )


MOST_PINS = 200


def analyzed(files: DataFrame, packages: DataFrame, releases: DataFrame, changes: DataFrame, usage: DataFrame, prediction: DataFrame, model: str, per_release: int = 5, most: int = 10, most_pins: int | None = MOST_PINS) -> DataFrame:
    """Requirements files, text to result: a row for each shown change of each release above a pin, and one for each release, pin or line without.

    files: file, text; the rest as for release_pages, releases with version texts. status: `too_many_packages` (a file with more than
    `most_pins` pins, where there is a limit), `skipped` (a line, with its reason), `not_tracked`, `up_to_date`, `behind`. A change that several of a pin's
    releases hold stays in the newest one; of the releases the newest `most` are shown (place 1 newest), `hidden` counts the others.
    """
    parsed = park(requirements.parse(files), "parsed")  # read for pins, skipped lines and sizes: files are parsed once
    read = parsed.where("reason is null")
    full = None if most_pins is None else read.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") > most_pins).select("file")
    fine = parsed if full is None else parsed.join(full, "file", "left_anti")
    pins = fine.where("reason is null").select("file", F.col("name").alias("canon"), F.col("version").alias("current"))
    pins = pins.withColumns({"pin_key": versions.key(F.col("current")), "pin_pre": versions.is_pre(F.col("current"))})
    held = releases.select("package", "version", "upgrade", F.col("status").alias("analysis")).withColumns({"key": versions.key(F.col("version")), "pre": versions.is_pre(F.col("version"))}).where("key is not null")
    tracked = packages.select("package", "name", canonical(F.col("name")).alias("canon"))
    each = pins.join(tracked, "canon", "left").join(held, "package", "left")
    counts = (F.col("key").isNotNull()) & (~F.col("pre") | F.col("pin_pre"))
    each = each.where(counts | F.col("key").isNull()).withColumn("above", F.coalesce(F.col("key") > F.col("pin_key"), F.lit(False)))
    of_pin = Window.partitionBy("file", "canon")  # the releases of one package
    each = each.withColumns({
        "known": F.count("key").over(of_pin), "n_above": F.count_if("above").over(of_pin),
        "latest": F.max_by("version", "key").over(of_pin), "place": F.row_number().over(of_pin.orderBy(F.desc("key"), F.desc("version"))),
    })
    status = F.when(F.col("known") == 0, "not_tracked").when(F.col("n_above") == 0, "up_to_date").otherwise("behind")
    each = each.withColumn("status", status).select("file", "canon", "status", "current", "latest", "version", "upgrade", "key", "above", "place", "n_above")
    each = park(each, "pins-and-releases")  # what is behind, what is not, and what is shown each read it
    alone = each.where("status <> 'behind'").select("file", "canon", "status", F.when(F.col("status") == "up_to_date", F.col("current")).alias("current"), F.when(F.col("status") == "up_to_date", F.col("latest")).alias("latest")).distinct()
    shown = each.where(F.col("above") & (F.col("status") == "behind") & (F.col("place") <= most))
    shown = shown.select("file", "canon", "status", "current", "latest", "version", "upgrade", "key", "place", F.greatest(F.col("n_above") - most, F.lit(0)).alias("hidden"))
    rows = changes.where(~F.col("is_private")).select("upgrade", "line", "symbol", "kind", "sub_target").join(shown.select("file", "canon", "upgrade", "key"), "upgrade")
    rows = newest_copies(rows, ["file", "canon", "symbol", "kind", "sub_target"], F.col("key"), [F.desc("line")])
    rows = with_signals(rows, usage, prediction, ["upgrade", "line"], model).withColumns({"release": F.struct("file", "upgrade"), "is_private": F.lit(False)})
    ranked = rank_releases(rows, "release", per_release).select("file", "canon", "upgrade", "total", "n_imported", "ranking", "rn", "symbol", "kind", "sub_target", "score", "user_count")
    behind = shown.join(ranked, ["file", "canon", "upgrade"], "left").withColumns({
        "total": F.coalesce("total", F.lit(0)), "n_imported": F.coalesce("n_imported", F.lit(0)), "ranking": F.when(F.col("ranking") == "model", "model").otherwise("usage_fallback"),
    }).drop("upgrade", "key")
    skipped = fine.where("reason is not null").select("file", F.lit("skipped").alias("status"), F.col("shown").alias("canon"), "reason", "line_number")
    out = behind.unionByName(alone, allowMissingColumns=True)
    if full is not None:
        out = out.unionByName(full.select("file", F.lit("too_many_packages").alias("status")), allowMissingColumns=True)
    return out.unionByName(skipped, allowMissingColumns=True).withColumnRenamed("canon", "name")


def rank_releases(changes: DataFrame, release: str, limit: int, include_private: bool = False) -> DataFrame:
    """Each release's first `limit` changes with rn, and total and n_imported before the limit."""
    rows = changes.where(F.lit(include_private) | ~F.col("is_private"))
    w = Window.partitionBy(release)
    ranked = rows.withColumns({
        "total": F.count("*").over(w), "n_imported": F.count_if(F.col("user_count") > 0).over(w), "n_scored": F.count("score").over(w),
        "rn": F.row_number().over(w.orderBy(*hot_order())),
    })
    return ranked.where(F.col("rn") <= limit).withColumn("ranking", F.when(F.col("n_scored") > 0, "model").otherwise("usage"))


def newest_copies(changes: DataFrame, key: Sequence[str], newest: Column, ties: Sequence[Column] = ()) -> DataFrame:
    """One row for each change of a package: the newest release's."""
    return keep_one(changes, key, [newest.desc(), *ties])


def releases_after(pins: DataFrame, releases: DataFrame, most: int = 10) -> DataFrame:
    """package, version, place (1 newest), hidden: releases above each pin. pins: package, pin_key, pin_pre; releases: package, version, key, pre.

    Pre-releases count only for a pin that is one; of more than `most` releases the newest stay and the rest are counted.
    """
    joined = releases.join(pins, "package").where("key is not null and key > pin_key and (not pre or pin_pre)")
    w = Window.partitionBy("package")
    out = joined.withColumns({"place": F.row_number().over(w.orderBy(F.desc("key"), F.desc("version"))), "held": F.count("*").over(w)})
    return out.where(F.col("place") <= most).withColumn("hidden", F.greatest(F.col("held") - most, F.lit(0))).select("package", "version", "place", "hidden")


def served_model(runs: DataFrame, pinned: str | None = None) -> DataFrame:
    """The model version in use: the pinned one, else the one trained last."""
    return runs.agg(F.lit(pinned).alias("model_version") if pinned else F.max_by("version", "trained_at").alias("model_version"))


def guard_model(prediction: DataFrame, model: str) -> None:
    if prediction.where(F.col("model_version") == model).limit(1).isEmpty():
        raise LookupError(f"model {model} has no scores")
