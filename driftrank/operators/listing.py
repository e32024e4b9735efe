"""Release listings out of a registry's JSON: nested documents of variable keys to rows, then reasons, fallback and window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftrank.functions import names, versions

DOCUMENT = (
    "info struct<home_page: string, project_urls: map<string, string>>, "
    "releases map<string, array<struct<packagetype: string, yanked: boolean, url: string, upload_time_iso_8601: string>>>"
)
# What the link to the code is called, best first.
REPOSITORY_KEYS = ("source", "source code", "repository", "code", "github", "homepage", "home")


def code_repository(links: Column, home: Column) -> Column:
    """owner/repo of the best-named link that leads to a repository; of equally named ones the first."""
    entries = F.concat(F.coalesce(F.map_entries(links), F.array().cast("array<struct<key: string, value: string>>")), F.array(F.struct(F.lit("home_page").alias("key"), home.alias("value"))))

    def judged(entry: Column, place: Column) -> Column:
        name, rank = F.lower(F.trim(entry["key"])), F.lit(len(REPOSITORY_KEYS))
        for i in reversed(range(len(REPOSITORY_KEYS))):
            rank = F.when(F.contains(name, F.lit(REPOSITORY_KEYS[i])), i).otherwise(rank)
        return F.struct(rank.alias("rank"), place.alias("place"), names.repository(entry["value"]).alias("repository"))

    found = F.filter(F.transform(entries, judged), lambda x: x["repository"].isNotNull())
    return F.array_min(found)["repository"]


def documents(bodies: DataFrame) -> DataFrame:
    """package, doc: parsed registry answers; what does not parse has a null doc. bodies: package, body."""
    return bodies.select("package", F.from_json("body", DOCUMENT).alias("doc"))


def packages(docs: DataFrame) -> DataFrame:
    return docs.select("package", code_repository(F.col("doc.info.project_urls"), F.col("doc.info.home_page")).alias("repository"))


def releases(docs: DataFrame) -> DataFrame:
    """package, version, key, is_pre, url, uploaded (of the first source archive that is not yanked), strict, loose: why the release is
    left out when pre-releases are not wanted, and when they are."""
    rows = docs.select("package", F.explode("doc.releases").alias("version", "files")).withColumn("files", F.coalesce("files", F.array().cast("array<struct<packagetype: string, yanked: boolean, url: string, upload_time_iso_8601: string>>")))
    out_of_use = lambda f: F.coalesce(f["yanked"], F.lit(False))
    source = F.get(F.filter("files", lambda f: (f["packagetype"] == "sdist") & ~out_of_use(f)), F.lit(0))
    v = F.col("version")
    rows = rows.withColumns({"source": source, "yanked": (F.size("files") > 0) & F.forall("files", out_of_use)})
    # A yanked release may still hold one archive in use; only where there is none does that count.
    why = F.when(F.col("source").isNull(), F.when(F.col("yanked"), "yanked").otherwise("no_source"))
    early = F.when(~versions.is_valid(v), "unparseable").when(versions.is_dev(v), "dev")
    return rows.select(
        "package", "version", versions.key(v).alias("key"), versions.is_pre(v).alias("is_pre"), F.col("source.url").alias("url"), F.col("source.upload_time_iso_8601").alias("uploaded"),
        F.coalesce(early, F.when(versions.is_pre(v), "prerelease"), why).alias("strict"), F.coalesce(early, why).alias("loose"),
    )


def window(listed: DataFrame, last: int = 15) -> DataFrame:
    """package, version, status, place, url, uploaded, is_pre: each package's newest `last` releases that can be analysed (status
    `kept`, place 1 newest), and those left out between the oldest and the newest of them, with why.

    Pre-releases are let in where under two others are left and that gives more. Where nothing is kept, the newest `last` readable
    releases are told with why.
    """
    own = Window.partitionBy("package")
    rows = listed.withColumns({"n_strict": F.count_if(F.col("strict").isNull()).over(own), "n_loose": F.count_if(F.col("loose").isNull()).over(own)})
    rows = rows.withColumn("why", F.when((F.col("n_strict") < 2) & (F.col("n_loose") > F.col("n_strict")), F.col("loose")).otherwise(F.col("strict")))
    rows = rows.where((F.col("why").isNull()) | F.col("key").isNotNull())
    newest = F.row_number().over(Window.partitionBy("package", F.col("why").isNull()).orderBy(F.desc("key"), F.desc("version")))
    rows = rows.withColumn("place", newest)
    kept = F.col("why").isNull() & (F.col("place") <= last)
    low, high = F.min(F.when(kept, F.col("key"))).over(own), F.max(F.when(kept, F.col("key"))).over(own)
    rows = rows.withColumns({"low": low, "high": high})
    told = kept | (F.col("why").isNotNull() & F.when(F.col("low").isNull(), F.col("place") <= last).otherwise((F.col("key") >= F.col("low")) & (F.col("key") <= F.col("high"))))
    return rows.where(told).select("package", "version", F.coalesce("why", F.lit("kept")).alias("status"), F.when(F.col("why").isNull(), F.col("place")).alias("place"), F.when(F.col("why").isNull(), F.col("url")).alias("url"), F.when(F.col("why").isNull(), F.col("uploaded")).alias("uploaded"), "is_pre")
