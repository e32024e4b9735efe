"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below 2^64 / SCALE. Sketches of any two texts are thus samples by one rule:
they merge by union, and the share of one in the other estimates containment however unequal the lengths are.

As a string a sketch is `v1:<k>:<scale>:<number of shingles>:<base64 of the ascending 64-bit hashes>`, the number left
out of a merged one. Likeness is the estimated resemblance |A and B| / |A or B|; where neither text keeps a hash it is 1
for equal numbers of shingles and equal digests of them, else 0.

Neighbours in descending id order are found without a global sort in one task: rows are dealt to ranges of ids that hold
about equally many rows, however the ids are spread; a range reads its rows in order, and the largest row below its lower
bound is sent to it as well. Only the ends of the ranges, one row a range, reach the driver.

Defined results: null and empty texts have no shingle; with fewer words than k the whole sequence is the one shingle;
equal ids are ordered by text; a null id comes last in descending order; an empty table gives an empty result; a single
row is its own next document; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftrank.llm.textkit import distinct, shingles, utf8, words

K, SCALE = 5, 8
U = np.uint64
_SLICE = 1 << 20
#: Ranges are larger than asked for only beyond so many (1.6 TB at 8 MB each).
MOST_RANGES = 200_000


def sketch_all(texts: list[str], k: int = K, scale: int = SCALE) -> list[tuple[int, int, np.ndarray]]:
    """(number of distinct shingles, digest of all of them, hashes kept) of each text."""
    raw, off = utf8(pa.array(texts, pa.large_string()))
    h, owner = shingles(words(raw, off), k)
    h, off = distinct(h, owner, len(texts))
    low = h < U((1 << 64) // scale)
    run = np.concatenate([np.zeros(1, U), np.cumsum(h, dtype=U)])
    return [(int(b - a), (int(run[b]) - int(run[a])) % (1 << 64), h[a:b][low[a:b]]) for a, b in zip(off[:-1], off[1:])]


def to_text(n: int, digest: int, kept: np.ndarray, k: int = K, scale: int = SCALE) -> str:
    return f"v1:{k}:{scale}:{n}.{digest:016x}:{base64.b64encode(kept.astype('<u8').tobytes()).decode()}"


def from_text(text: str) -> tuple[int, int, str, np.ndarray]:
    """(k, scale, head, hashes) of a fingerprint."""
    _, k, scale, head, body = text.split(":")
    return int(k), int(scale), head, np.frombuffer(base64.b64decode(body), "<u8").astype(U)


def merge(a: str, b: str) -> str:
    """The fingerprint of both documents' shingles together."""
    (k, scale, _, x), (k2, scale2, _, y) = from_text(a), from_text(b)
    if (k, scale) != (k2, scale2):
        raise ValueError("fingerprints of different kinds")
    return f"v1:{k}:{scale}::{base64.b64encode(np.union1d(x, y).astype('<u8').tobytes()).decode()}"


def containment(a: str, b: str) -> float:
    """Estimated share of a's shingles that b holds."""
    (_, _, _, x), (_, _, _, y) = from_text(a), from_text(b)
    return float(np.isin(x, y).mean()) if len(x) else 0.0


def likeness(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    x, y = a[2], b[2]
    if not len(x) and not len(y):
        return float(a[:2] == b[:2])
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def _ranges(rows: DataFrame, bytes_each: int) -> list[tuple[int, int, int, int]]:
    """(least id, its text's hash, largest id, its text's hash) of ranges of about equal numbers of rows, ascending.

    Spark's range partitioner deals the ids and hashes alone; what is used of it are the ranges' own least and largest rows.
    """
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0]
    if not size:
        return []
    parts = max(1, min(MOST_RANGES, -(-size // bytes_each)))
    edge = F.struct("i", "c")
    dealt = rows.select("i", "c").repartitionByRange(parts, "i", "c").groupBy(F.spark_partition_id().alias("p")).agg(F.min(edge).alias("a"), F.max(edge).alias("b"))
    return sorted((r.a.i, r.a.c, r.b.i, r.b.c) for r in dealt.collect())  # one row a range


def _destinations(ranges: list[tuple[int, int, int, int]], i: np.ndarray, c: np.ndarray) -> list[list[int]]:
    """Of each row its range; a range's largest row goes, as -1 - range, to the next range too, whose least row it follows."""
    low, low_c, top, top_c = (np.array(x, np.int64) for x in zip(*ranges))
    part = np.searchsorted(low, i, side="right") - 1
    first = np.searchsorted(low, i, side="left")
    for j in np.flatnonzero(first <= part).tolist():  # ids at which ranges begin
        part[j] = first[j] - 1 + np.searchsorted(low_c[first[j] : part[j] + 1], c[j], side="right")
    is_top = (top[part] == i) & (top_c[part] == c)
    return [[p, -1 - (p + 1) % len(low)] if t else [p] for p, t in zip(part.tolist(), is_top.tolist())]


def fingerprints(docs: DataFrame, bytes_each: int = 8 << 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"i": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "c": F.xxhash64("text")})
    ranges = _ranges(rows, bytes_each)
    if not ranges:
        return spark.createDataFrame([], _SCHEMA)
    told = spark.sparkContext.broadcast(ranges)  # MOST_RANGES rows at most

    @F.pandas_udf("array<int>")
    def to(i: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(_destinations(told.value, i.to_numpy(np.int64), c.to_numpy(np.int64)))

    dealt = rows.withColumn("s", F.explode(to("i", "c"))).select("doc_id", "text", "c", F.when(F.col("s") < 0, -1 - F.col("s")).otherwise(F.col("s")).alias("part"), (F.col("s") < 0).alias("ghost"))
    ordered = dealt.repartition(len(ranges), "part").sortWithinPartitions("part", "ghost", F.desc_nulls_last("doc_id"), F.desc("c")).drop("c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []  # rows of one range in order, not yet given out
        size, part, ended = 0, None, False

        def give(last: tuple[int | None, str] | None) -> pa.RecordBatch:
            """Results of the held rows but the last, which is kept back, or of all when the row after them is given."""
            chain = held + ([last] if last else [])
            texts, edited = [t for _, t in chain], []
            for (_, t), (_, nxt) in zip(chain, chain[1:]):
                third = len(t) // 3
                edited.append(t[: len(t) - third] + nxt[:third] if third else t)
            own, other = sketch_all(texts), sketch_all(edited)
            cols = [
                [i for i, _ in chain[:-1]], [len(t) for t in texts[:-1]],
                [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                [to_text(*x) for x in own[:-1]], [to_text(*x) for x in other],
                [likeness(a, b) for a, b in zip(own, other)], [likeness(a, b) for a, b in zip(own, own[1:])],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], _NAMES)

        for batch in batches:
            for i, text, p, g in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "ghost")]):
                if p != part:
                    held, size, part, ended = [], 0, p, False
                if g:
                    if not ended:  # rows equal in id and text are equal tops; one serves
                        yield give((i, text))
                        held, size, ended = [], 0, True
                    continue
                held.append((i, text))
                size += len(text)
                if size >= _SLICE and len(held) > 1:
                    yield give(None)
                    held = held[-1:]
                    size = len(held[0][1])

    return ordered.mapInArrow(run, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
