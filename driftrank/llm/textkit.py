"""Vectorised word and byte hashing over Arrow string columns.

All functions work on whole texts. A batch is cut into slices of rows by bytes, so that the NumPy temporaries stay
within a few tens of MB whatever the batch; a single row larger than a slice forms a slice of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64 values."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_DEEP = 256
_TABLE = splitmix(np.arange(_DEEP * 256, dtype=U))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = splitmix(np.arange(1, 65, dtype=U)) | U(1)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of batch, each slice holding at most `limit` bytes of the column, or one row."""
    if not batch.num_rows:
        return
    _, off = utf8(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield batch.slice(at, end - at)
        at = end


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text. The offsets start at 0."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


@dataclass
class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a run of texts: byte spans, the text each is in, and 64-bit hashes."""

    raw: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each text's first word; one more entry than texts


def words(raw: np.ndarray, off: np.ndarray, lower: bool = False) -> Words:
    n_docs = len(off) - 1
    if lower and len(raw):
        raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return Words(raw, off, none, none, none, np.zeros(0, U), np.zeros(n_docs + 1, np.int64))
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    head[cut[inside[cut]]] = True
    before = cut - 1
    tail[before[inside[before]]] = True
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    place = np.flatnonzero(inside)
    deep = place - np.repeat(start, end - start)
    idx = (np.minimum(deep, _DEEP - 1) << 8) | raw[place]
    value = _TABLE[idx]
    far = np.flatnonzero(deep >= _DEEP)
    if len(far):
        value[far] = splitmix((deep[far].astype(U) << U(8)) | raw[place[far]].astype(U))
    lead = np.zeros(len(start), np.int64)
    np.cumsum((end - start)[:-1], out=lead[1:])
    hashed = splitmix(np.add.reduceat(value, lead) + (end - start).astype(U))
    first = np.searchsorted(start, off, side="left")
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    return Words(raw, off, start, end, doc, hashed, first)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of k words; a text with fewer words, but one at least, gives its whole sequence."""
    n = np.diff(w.first)
    total = len(w.hash)
    if not total:
        return np.zeros(0, U), np.zeros(0, np.int64)
    acc = np.zeros(max(total - k + 1, 0), U)
    for i in range(k):
        acc += w.hash[i : total - k + 1 + i] * _MULT[i]
    ok = np.flatnonzero(w.doc[: len(acc)] == w.doc[k - 1 : k - 1 + len(acc)]) if len(acc) else np.zeros(0, np.int64)
    out, owner = splitmix(acc[ok]), w.doc[ok]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        tiny = np.zeros(len(short), U)
        for j, d in enumerate(short):
            h = w.hash[w.first[d] : w.first[d + 1]]
            tiny[j] = (h * _MULT[: len(h)]).sum(dtype=U) + U(len(h))
        out = np.concatenate([out, splitmix(tiny ^ U(0x5851F42D4C957F2D))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def distinct(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner, ascending, and n + 1 offsets into them."""
    if not len(values):
        return values, np.zeros(n + 1, np.int64)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(n + 1), side="left")


_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers, at least, of an odd number and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 2 * len(_POWERS[i])), x, U)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS


def plain_names(stage: Callable) -> Callable:
    """A stage over documents whose own working columns start with __: columns of docs that do so too have other names meanwhile."""

    @wraps(stage)
    def run(docs, *args, **more):
        other = {c: f"own_{i}_{c.strip('_')}" for i, c in enumerate(docs.columns) if c.startswith("__")}
        if not other:
            return stage(docs, *args, **more)
        return stage(docs.withColumnsRenamed(other), *args, **more).withColumnsRenamed({v: k for k, v in other.items()})

    return run
