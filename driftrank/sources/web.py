"""JSON over HTTP as a batch source: one partition a URL, retried with growing pauses; a URL that stays down is a row with its error."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftrank.operators.store import claim, exists

TRIES, PAUSE_S, TIMEOUT_S = 3, 0.5, 30


def fetch(url: str, tries: int = TRIES, pause_s: float = PAUSE_S) -> str:
    for i in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=TIMEOUT_S) as answer:
                return answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code < 500 or i == tries - 1:
                raise
        except (urllib.error.URLError, TimeoutError):
            if i == tries - 1:
                raise
        time.sleep(pause_s * 2**i)
    raise AssertionError("unreachable")


def json_documents(spark: SparkSession, urls: list[str], tries: int = TRIES, pause_s: float = PAUSE_S) -> DataFrame:
    """url, body, error"""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    rows.append((url, fetch(url, tries, pause_s), None))
                except (OSError, ValueError) as e:
                    rows.append((url, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["url", "body", "error"])

    table = spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, len(urls)))
    return table.mapInPandas(run, "url string, body string, error string")


def fetch_first(urls: Sequence[str], tries: int = TRIES, pause_s: float = PAUSE_S) -> tuple[str, str]:
    """(url, body) of the first of several mirrors that answers; the last one's error where none does."""
    for i, url in enumerate(urls):
        try:
            return url, fetch(url, tries, pause_s)
        except (OSError, ValueError):
            if i == len(urls) - 1:
                raise
    raise ValueError("no address given")


def cached_document(spark: SparkSession, mirrors: Sequence[str], cache: str, use_cache: bool = True, tries: int = TRIES, pause_s: float = PAUSE_S) -> str:
    """The path of one document, a cache file in shared storage: read from the first mirror that answers where the cache lacks it.

    What the path holds is left alone unless `use_cache` is off, in which case the document gets a name of its own beside it.
    """
    if use_cache and exists(spark, cache):
        return cache
    _, body = fetch_first(mirrors, tries, pause_s)
    path = f"{cache}.{time.time_ns()}" if exists(spark, cache) else cache
    claim(spark, path, body)
    return path


class Registry(DataSource):
    """`spark.read.format("registry")`: package, mirror, body, error: one document a package from the first of several mirrors.

    Options: packages (names, one a line), mirrors (address patterns with {} for the name, one a line), per_partition (names a task
    takes, 50), threads (downloads at a time in a task, 8), tries, pause. A package that no mirror has is a row with its error, so a
    task never fails for one; tasks hold as many documents as threads.
    """

    @classmethod
    def name(cls) -> str:
        return "registry"

    def schema(self) -> str:
        return "package string, mirror string, body string, error string"

    def reader(self, schema) -> "RegistryReader":
        return RegistryReader(dict(self.options))


class Names(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class RegistryReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        listed = lambda key: [x.strip() for x in options.get(key, "").splitlines() if x.strip()]
        self.names, self.mirrors = list(dict.fromkeys(listed("packages"))), listed("mirrors")
        if not self.mirrors:
            raise ValueError("give at least one mirror")
        self.per_partition, self.threads = int(options.get("per_partition", 50)), int(options.get("threads", 8))
        self.tries, self.pause = int(options.get("tries", TRIES)), float(options.get("pause", PAUSE_S))

    def partitions(self) -> list[Names]:
        return [Names(self.names[i : i + self.per_partition]) for i in range(0, len(self.names), self.per_partition)] or [Names([])]

    def _one(self, name: str) -> tuple:
        try:
            mirror, body = fetch_first([m.replace("{}", urllib.parse.quote(name, safe="")) for m in self.mirrors], self.tries, self.pause)
            return name, mirror, body, None
        except (OSError, ValueError) as e:
            return name, None, None, f"{type(e).__name__}: {e}"[:200]

    def read(self, partition: Names) -> Iterator[tuple]:
        with ThreadPoolExecutor(self.threads) as pool:
            for i in range(0, len(partition.names), self.threads):
                yield from pool.map(self._one, partition.names[i : i + self.threads])


def registry(spark: SparkSession, packages: Sequence[str], mirrors: Sequence[str], **options) -> DataFrame:
    spark.dataSource.register(Registry)
    return spark.read.format("registry").option("packages", "\n".join(packages)).option("mirrors", "\n".join(mirrors)).options(**options).load()
