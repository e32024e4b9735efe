"""Packing token streams into sequences: order-preserving dynamic programming over cut points.

The documents of a partition form one stream in the order in which they are read; nothing is shuffled. Cuts may fall at
document ends (free), at sentence ends and, where sentences are long, at fixed steps inside them, at a penalty in tokens.
With f(j) the least padding plus penalties of the stream up to cut j,

    f(j) = penalty(j) + min over cuts i < j with at most `length` tokens between of f(i) + padding(j - i)

and since padding is `length` minus the distance, the minimum is that of f(i) + position(i) over a sliding window: a
monotone queue, so each cut enters and leaves once. Sequences that hold exactly a power of two tokens need no padding and
are further transitions. A stream is solved in windows of WINDOW tokens; the last open sequence moves on to the next one.

Defined results: a null or empty text is its end id alone; a text of any length is split over sequences; repeated rows
are packed each time; an empty table gives an empty result; extra columns are ignored. Sequence ids are unique over all
partitions, not consecutive.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftrank.llm.textkit import slices

LENGTH, END_ID = 2048, 1
WINDOW = 256 * LENGTH
SENTENCE_PENALTY, HARD_PENALTY, LEAST_GAP, STEP = 2.0, 8.0, 24, 128

_GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes: a byte that prints stands for itself, the others follow from code point 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encodes whole texts with a byte-level BPE vocabulary file of the `tokenizers` format.

    Ids are merge ranks in such files, so the faster of the two installed encoders serves; where it gives up on a text, or the
    text holds one of the file's added tokens, the file's own library encodes it.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, self.added = whole["model"], [t["content"] for t in whole.get("added_tokens") or ()]
        alphabet = _byte_alphabet()
        first = 256 + len(model["merges"])
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in model["vocab"].items() if i < first and all(c in alphabet for c in piece)}
        self.fast = tiktoken.Encoding("ranks", pat_str=_GPT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        stop = re.compile(rb"[.!?\n][\"')\]]?$")
        self.ends = np.zeros(max(ranks.values()) + 2, bool)
        self.ends[[i for piece, i in ranks.items() if stop.search(piece)]] = True
        self.own = None

    def _slow(self, text: str) -> list[int]:
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
        return self.own.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if any(a in text for a in self.added) or "  " * 500 in text or len(text) > 1_000_000:
            return np.array(self._slow(text), np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def cut_points(doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties): 0, document ends, sentence ends LEAST_GAP apart or more, and steps inside long gaps."""
    kinds = np.concatenate([np.zeros(len(doc_ends) + 1), np.full(len(sentence_ends), SENTENCE_PENALTY)])
    at = np.concatenate([[0], doc_ends, sentence_ends])
    order = np.lexsort((kinds, at))
    at, kinds = at[order], kinds[order]
    keep = np.ones(len(at), bool)
    keep[1:] = at[1:] != at[:-1]
    at, kinds = at[keep], kinds[keep]
    # Thin sentence ends: one in each stretch of LEAST_GAP tokens, document ends all.
    stretch = at // LEAST_GAP
    keep = kinds == 0
    keep[1:] |= stretch[1:] != stretch[:-1]
    at, kinds = at[keep], kinds[keep]
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > STEP)
    if len(wide):
        more = (gaps[wide] - 1) // STEP
        hard = np.repeat(at[wide], more) + STEP * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
        at, kinds = np.concatenate([at, hard]), np.concatenate([kinds, np.full(len(hard), HARD_PENALTY)])
        order = np.argsort(at, kind="stable")
        at, kinds = at[order], kinds[order]
    return at, kinds


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indices of the cuts that minimise padding plus penalties, from the first to the last position."""
    n = len(at)
    exact: dict[int, list[int]] = {}
    size = 1
    while size < length:
        j = np.flatnonzero(at >= at[0] + size)
        i = np.searchsorted(at, at[j] - size)
        for a, b in zip(j[at[i] == at[j] - size].tolist(), i[at[i] == at[j] - size].tolist()):
            exact.setdefault(a, []).append(b)
        size *= 2
    pos, pen = at.tolist(), penalty.tolist()
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(float(pos[0]), 0)])
    for j in range(1, n):
        p = pos[j]
        least = p - length
        while pos[queue[0][1]] < least:
            queue.popleft()
        key, i = queue[0]
        value = key + length - p
        if j in exact:
            for b in exact[j]:
                if cost[b] < value:
                    value, i = cost[b], b
        value += pen[j]
        cost[j], back[j] = value, i
        key = value + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [n - 1], n - 1
    while j:
        j = back[j]
        out.append(j)
    return out[::-1]


class Packer:
    """Turns a stream of (key, ids) into pieces (key index, start, length, crc, total, sequence, offset)."""

    def __init__(self, ends: np.ndarray, base: int, length: int = LENGTH, window: int = WINDOW) -> None:
        self.ends, self.next, self.length, self.window = ends, base, length, window
        self.segments: list[tuple[object, int, int, np.ndarray]] = []  # key, start in its document, document's ids, ids
        self.held = 0

    def add(self, key: object, ids: np.ndarray) -> list[tuple]:
        self.segments.append((key, 0, len(ids), ids))
        self.held += len(ids)
        return self.flush(False) if self.held >= self.window else []

    def flush(self, last: bool) -> list[tuple]:
        if not self.held:
            return []
        stream = np.concatenate([s[3] for s in self.segments])
        doc_ends = np.cumsum([len(s[3]) for s in self.segments])
        at, penalty = cut_points(doc_ends, np.flatnonzero(self.ends[np.minimum(stream, len(self.ends) - 1)]) + 1)
        cuts = at[best_cuts(at, penalty, self.length)].tolist()
        if not last and len(cuts) > 2:
            cuts.pop()
        out, seq, begin = [], 0, 0
        rest: list[tuple[object, int, int, np.ndarray]] = []
        for (key, start, total, ids), end in zip(self.segments, doc_ends.tolist()):
            at_ = begin
            while at_ < end and seq < len(cuts) - 1:
                stop = min(end, cuts[seq + 1])
                piece = ids[at_ - begin : stop - begin]
                out.append((key, start + at_ - begin, stop - at_, zlib.crc32(piece.astype("<u4").tobytes()), total, self.next + seq, at_ - cuts[seq]))
                at_ = stop
                if stop == cuts[seq + 1]:
                    seq += 1
            if at_ < end:
                rest.append((key, start + at_ - begin, total, ids[at_ - begin :]))
            begin = end
        self.next += len(cuts) - 1
        self.segments, self.held = rest, sum(len(s[3]) for s in rest)
        return out


def pack(docs: DataFrame, tokenizer_path: str, keep: list[str] | None = None) -> DataFrame:
    """A row for each piece: the columns `keep` (doc_id), start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    keep = keep or ["doc_id"]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer_path)
        packer = Packer(model.ends, TaskContext.get().partitionId() << 40)
        kinds = [None] * len(keep)

        def rows(found: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array([f[0][i] for f in found], kinds[i]) for i in range(len(keep))]
            return pa.RecordBatch.from_arrays(cols + [pa.array([f[j] for f in found], pa.int64()) for j in range(1, 7)], schema.fieldNames())

        for batch in batches:
            kinds = [batch.column(c).type for c in keep]
            for part in slices(batch):
                found = []
                for *key, text in zip(*[part.column(c).to_pylist() for c in keep], part.column("text").to_pylist()):
                    found += packer.add(key, np.append(model.encode(text), np.uint32(END_ID)))
                if found:
                    yield rows(found)
        if found := packer.flush(True):
            yield rows(found)

    return docs.select(*keep, "text").mapInArrow(run, schema)


