"""Scans: typed CSV, optional files, JSON lists, line files, archives and source trees."""

from __future__ import annotations

import ast
import io
import tarfile
import zipfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftrank.operators.store import exists

CHANGES = (
    "package string, package_rank int, version_from string, version_to string, symbol string, kind string, sub_target string, is_private boolean, "
    "in_dunder_all boolean, module_depth int, is_top_level boolean, name_length int, released_at string, explanation string, export_paths string, "
    "inherited_by int, was_deprecated_before boolean, prior_breaks_in_module int"
)
RELEASES = "package string, version string, released_at string, status string, n_changes int"
FAILURES = "package string, stage string, detail string, error_type string, message string"
PACKAGES = "package string, download_rank int, github_repo string"
USAGE = "symbol string, user_count int"


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header and declared types: versions stay text, a bad field is null, the literal NaN is null."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False).csv(path)
    return df.select(*[F.when(F.col(f.name) == "nan", None).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])


def optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The file, or no rows where there is none."""
    return csv(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def ranked_json(spark: SparkSession, path: str, field: str = "rows", name: str = "project", limit: int | None = None) -> DataFrame:
    """A JSON document's list, with the place in it as rank."""
    doc = spark.read.schema(f"{field} array<struct<{name}: string>>").json(path, multiLine=True)
    out = doc.select(F.posexplode(field).alias("i", "row")).select((F.col("i") + 1).alias("rank"), F.col(f"row.{name}").alias("package"))
    return out if limit is None else out.where(F.col("rank") <= limit)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Distinct stripped lines; of a missing file, none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "line string")
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''").distinct()


def _inside(name: str) -> bool:
    """A member that stays below the folder it is unpacked in."""
    return not name.startswith(("/", "\\")) and ".." not in name.replace("\\", "/").split("/")


def members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of the files of a tar or zip archive; links and escaping paths are left out."""
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and _inside(i.filename))
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile() and _inside(m.name))


def archives(spark: SparkSession, path: str, suffix: str = ".py") -> DataFrame:
    """archive, path, text, error: the files of the archives under path; an unreadable archive is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [(where, p, b.decode("utf-8", "replace"), None) for p, b in members(where, content) if p.endswith(suffix)]
                except Exception as e:  # what a damaged archive raises is open-ended; it is reported as a row
                    rows = [(where, None, None, f"{type(e).__name__}: {e}"[:200])]
                yield pd.DataFrame(rows, columns=["archive", "path", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, path string, text string, error string")


class _Imports(ast.NodeVisitor):
    """Dotted names that a module imports or reaches through an imported name."""

    def __init__(self, tracked: set[str] | None) -> None:
        self.tracked, self.names, self.found = tracked, {}, set()

    def _add(self, dotted: str) -> None:
        if self.tracked is None or dotted.split(".", 1)[0] in self.tracked:
            self.found.add(dotted)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self._add(a.name)
            self.names[a.asname or a.name.split(".", 1)[0]] = a.name if a.asname else a.name.split(".", 1)[0]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if node.level or not node.module:
            return
        for a in node.names:
            if a.name == "*":
                self._add(node.module)
            else:
                self._add(f"{node.module}.{a.name}")
                self.names[a.asname or a.name] = f"{node.module}.{a.name}"

    def visit_Attribute(self, node: ast.Attribute) -> None:
        chain, at = [], node
        while isinstance(at, ast.Attribute):
            chain.append(at.attr)
            at = at.value
        if isinstance(at, ast.Name) and at.id in self.names:
            self._add(".".join([self.names[at.id], *reversed(chain)]))
        self.generic_visit(node)  # the inner attribute of a longer chain is used as well


def used_names(source: str, tracked: set[str] | None = None) -> list[str]:
    """What a source text uses; text that doesn't parse uses nothing. It is parsed, never run."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    visitor = _Imports(tracked)
    visitor.visit(tree)
    return sorted(visitor.found)


#: Texts whose names a task remembers: copies of a file are common, and parsing is what a file costs.
MOST_REMEMBERED = 4096


def usage_pairs(files: DataFrame, tracked: list[str] | None = None) -> DataFrame:
    """scanner, symbol of each source file; a scanner's use of its own roots is left out. files: scanner, own_roots, text.

    A text is parsed once in a task while it is among the last MOST_REMEMBERED ones; names are taken out of their lists and held
    against the own roots by Spark.
    """
    known = set(tracked) if tracked is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lru_cache(MOST_REMEMBERED)(lambda text: used_names(text or "", known))
        for batch in batches:
            texts = batch.column("text").dictionary_encode()
            lists = pa.array([named(t) for t in texts.dictionary.to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("scanner"), batch.column("own_roots"), lists.take(texts.indices)], ["scanner", "own_roots", "names"])

    files = files.select(F.col("scanner").cast("string").alias("scanner"), F.col("own_roots").cast("array<string>").alias("own_roots"), "text")
    each = files.mapInArrow(run, "scanner string, own_roots array<string>, names array<string>").select("scanner", "own_roots", F.explode("names").alias("symbol"))
    own = F.coalesce(F.array_contains("own_roots", F.substring_index("symbol", ".", 1)), F.lit(False))
    return each.where(~own).select("scanner", "symbol")


def usage_index(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("symbol").agg(F.count_distinct("scanner").alias("user_count"))
