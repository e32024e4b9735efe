"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after `.`, `!`, `?` and closing quotes before white space, and at line ends), and a sentence
before every word whose hash is the least of some WINDOW consecutive words of it (the last of equal ones), so equal passages
are cut alike wherever they stand: in a shared passage all cuts agree from the first whole window, or sentence end, to the
last one, and no piece has more than WINDOW words. From every piece on, the shortest run of pieces with MIN_WORDS words is
hashed, white space aside; MIN_WORDS + 3 * WINDOW words in common, 48, always hold a common run, and less than WINDOW
words stay at the left end of a passage, at most 2 * WINDOW at the right one. Runs are counted over all documents; the first one, by document id and place,
stays, and every piece that another one covers is removed. In the output, pieces are what counts as sentences.

Only hashes are shuffled to find those that repeat: blocks of documents ask how often their runs occur (tally.py), and runs
that repeat go on as rows with their places; the first place is a minimum over these. A document's removed places are joined with its text once. Nothing is gathered per hash: a run that a third of the
documents hold is a sum and a minimum, and the joins with these are ones that adaptive execution splits.

Defined results: null and empty texts have no sentence and stay as they are; rows with equal id and text are one
document; a null id sorts first; an empty table gives an empty result; extra columns, clashing names too, are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftrank.llm import tally
from driftrank.llm.textkit import plain_names, powers, slices, splitmix
from driftrank.tables import park

MIN_WORDS, WINDOW = 24, 8
_END = re.compile(r"[.!?]+[\"')\]»”]*\s+|\s*\n\s*")
_WORD = re.compile(r"\S+")
U = np.uint64


def _pieces(text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(begin of each word, hash of each word, number of each piece's first word)"""
    starts = [m.start() for m in _WORD.finditer(text)]
    n = len(starts)
    marks = np.fromiter(map(xxhash.xxh3_64_intdigest, text.split()), U, n)
    head = np.zeros(n, bool)
    if n:
        head[0] = True
        after = np.searchsorted(starts, [m.end() for m in _END.finditer(text)])
        head[after[after < n]] = True
    if n >= WINDOW:
        sentence = np.cumsum(head)
        at = np.flatnonzero(sentence[: n - WINDOW + 1] == sentence[WINDOW - 1 :])
        head[at + WINDOW - 1 - np.argmin(sliding_window_view(marks[::-1], WINDOW)[::-1][at], axis=1)] = True
    return starts, marks, np.flatnonzero(head)


def _begins(text: str, starts: list[int], first: np.ndarray) -> tuple[list[int], list[int]]:
    if not text:
        return [], []
    if not len(first):
        return [0], [0]
    return [0] + [starts[i] for i in first[1:].tolist()], np.diff(first, append=len(starts)).tolist()


def _runs(marks: np.ndarray, first: np.ndarray) -> tuple[list[int], list[int]]:
    n = len(marks)
    if n < MIN_WORDS:
        return [], []
    bounds = np.append(first[1:], n)
    last = np.searchsorted(bounds, first + MIN_WORDS)
    start = np.flatnonzero(last < len(bounds))
    power, inverse = powers(n)
    upto = np.zeros(n + 1, U)
    np.cumsum(marks * power[:n], out=upto[1:])
    a, b = first[start], bounds[last[start]]
    hashes = splitmix((upto[b] - upto[a]) * inverse[a] + (b - a).astype(U))
    return hashes.view(np.int64).tolist(), (last[start] + 1 - start).tolist()


def sentences(text: str) -> tuple[list[int], list[int]]:
    """(begin of each piece, words of each); a piece reaches to the next one's begin, the last to the end."""
    starts, _, first = _pieces(text)
    return _begins(text, starts, first)


def runs(text: str | None) -> tuple[list[int], list[int]]:
    """(hash, number of pieces) of the shortest run from each piece on that is long enough."""
    _, marks, first = _pieces(text or "")
    return _runs(marks, first)


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, tag, n, places: of each document, the number of its pieces and the places of its runs that repeat an earlier one. docs: doc_id, tag, text."""

    def make(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        cut_, found = [_pieces(t or "") for t in part.column("text").to_pylist()], []
        for _, marks, first in cut_:
            found.append(_runs(marks, first)[0])
        pieces = [len(first) or int(bool(t)) for (_, _, first), t in zip(cut_, part.column("text").to_pylist())]
        return np.array([len(f) for f in found]), np.array([h for f in found for h in f], np.int64).view(U), [np.array(pieces)]

    def use(ids: list, tags: list, per: np.ndarray, keys: np.ndarray, total: np.ndarray, more: list[np.ndarray]) -> pa.RecordBatch:
        """A row without place for each document, and one for each of its runs that occurs twice or more."""
        at = np.flatnonzero(total > 1)
        doc = np.repeat(np.arange(len(per)), per)
        rows = pa.array(np.concatenate([np.arange(len(per)), doc[at]]))
        none = pa.nulls(len(per), pa.int64())
        place = (np.arange(len(keys)) - np.repeat(np.cumsum(per) - per, per))[at]
        cols = [pa.array(ids, pa.int64()).take(rows), pa.array(tags, pa.int32()).take(rows), pa.array(np.concatenate([more[0], np.zeros(len(at), np.int64)])), pa.concat_arrays([none, pa.array(keys[at].view(np.int64))]), pa.concat_arrays([none, pa.array(place, pa.int64())])]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "tag", "n", "span", "place"])

    found = tally.looked_up(docs, make, use, "doc_id long, tag int, n long, span long, place long", "spans")
    some = found.where("place is not null")
    here = F.struct("doc_id", "tag", "place")
    # Parked, the first places leave the join's own shuffle free to be split where very many documents hold one run.
    first = park(some.groupBy("span").agg(F.min(here).alias("first")), "first-places", clean=True)
    later = some.join(first, "span").where(~here.eqNullSafe(F.col("first")))
    both = found.where("place is null").select("doc_id", "tag", "n", "place").unionAll(later.select("doc_id", "tag", "n", "place"))
    return both.groupBy("doc_id", "tag").agg(F.max("n").alias("n"), F.collect_set("place").alias("places"))  # of one text


def cut(text: str, places: list[int]) -> tuple[str, int, int]:
    """(what stays of text, pieces, removed pieces) when the runs at `places` are taken out."""
    starts, marks, first = _pieces(text)
    begins, sizes = _begins(text, starts, first)[0], _runs(marks, first)[1]
    gone = np.zeros(len(begins) + 1, np.int64)
    for p in places:
        gone[p] += 1
        gone[p + sizes[p]] -= 1
    out = np.cumsum(gone[:-1]) > 0
    bounds = begins[1:] + [len(text)]
    return "".join(text[a:b] for a, b, x in zip(begins, bounds, out.tolist()) if not x), len(begins), int(out.sum())


def tagged(docs: DataFrame) -> DataFrame:
    """docs with __tag, a hash of the text that tells rows with one id apart."""
    return docs.withColumn("__tag", F.hash(F.coalesce("text", F.lit(""))))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with their text cut, and __before, __sentences, __removed: code points before, pieces, removed pieces."""
    rows = tagged(docs)
    dup = repeated(rows.select("doc_id", F.col("__tag").alias("tag"), "text")).select(F.col("doc_id").alias("__id"), F.col("tag").alias("__t"), F.col("places").alias("__places"), F.col("n").alias("__n"))
    joined = rows.join(dup, rows["doc_id"].eqNullSafe(dup["__id"]) & (rows["__tag"] == dup["__t"]), "left").select(*docs.columns, "__places", "__n")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in ("__before", "__sentences", "__removed")]])
    names, kept, at = schema.fieldNames(), docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts, more = [], []
                for text, places, n in zip(*[part.column(c).to_pylist() for c in ("text", "__places", "__n")]):
                    left, gone = text, 0
                    if places:
                        left, n, gone = cut(text, places)
                    texts.append(left)
                    more.append((len(text or ""), n, gone))
                cols = [part.column(c) for c in kept]
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols + [pa.array([m[i] for m in more], pa.int64()) for i in range(3)], names)

    return joined.mapInArrow(run, schema)


@plain_names
def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of text, n_chars following it where that column exists; rows of which nothing but white space stays are dropped."""
    out = dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.where((F.col("__removed") == 0) | F.col("text").rlike(r"\S")).select(*docs.columns)
