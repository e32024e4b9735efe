"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

A text's encoding is the one sequence of pieces in which every adjacent pair is what merging their joined characters
gives: no merge across a border ever was the best one, so borders hold in any context. The encoder therefore walks left
to right over the Aho-Corasick matches, takes the longest piece whose pair with the piece before it passes that check
(the pair is re-merged once and remembered), and backs up where none does; a bitfield marks positions from which no
completion exists, so each is left for good once.

Work is shared between equal chunks: where no piece holds a space mark after another character, and for characters that
no piece holds (they fall back to bytes), no merge can cross, and the text is encoded chunk by chunk through a bounded
memo in each worker.

Defined results: null and empty texts have no ids; unknown characters become byte pieces; any white space, the space mark
itself and NUL are encoded as the library does; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from driftrank.llm.textkit import slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MEMO_CHUNKS, MEMO_PAIRS = 800_000, 400_000


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            at += n
            yield tag >> 3, raw[at - n : at]
        else:
            n = 8 if kind == 1 else 4
            at += n
            yield tag >> 3, raw[at - n : at]


class PieceModel:
    """The vocabulary of a model file, with encode(text) -> ids and decode(ids) -> text."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        self.pieces: list[str] = []
        self.kind: list[int] = []
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.byte_of: dict[int, int] = {}
        trainer = dict(_fields(next(v for k, v in top if k == 2)))
        norm = dict(_fields(next(v for k, v in top if k == 3)))
        if trainer.get(3, 1) != 2 or norm.get(1) != b"identity" or norm.get(2) or norm.get(4, 1):
            raise ValueError("only merge-type models that neither normalise nor drop white space are supported")
        self.dummy = bool(norm.get(3, 1))
        for i, raw in enumerate(v for k, v in top if k == 1):
            got = dict(_fields(raw))
            piece, kind = got[1].decode(), got.get(3, NORMAL)
            self.pieces.append(piece)
            self.kind.append(kind)
            if kind == BYTE:
                self.byte_id[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            elif kind == NORMAL:
                self.id_of[piece], self.score[piece] = i, struct.unpack("<f", got[2])[0] if 2 in got else 0.0
            elif kind == UNKNOWN:
                self.unk = i
            elif kind in (USER, UNUSED):
                raise ValueError("user-defined and unused pieces are not supported")
        self.alphabet = set("".join(self.id_of))
        if not self.alphabet <= set(self.id_of):
            raise ValueError("a character of a piece is no piece itself")
        self.length = [len(p) for p in self.pieces]
        self.match = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.match.add_word(p, (i, len(p)))
        self.match.make_automaton()
        loose = any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        #: Chunks between which nothing merges; with pieces that hold an inner space mark, the whole text is one chunk.
        self.chunks = re.compile(rf"(?s).+" if loose else rf"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+").findall
        self.pair: dict[int, bool] = {}
        self.memo = _Memo(self)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves: always the best-scored adjacent pair, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether pieces a, b stand side by side in an encoding; a < 0: whether b stands at all."""
        key = (a + 1) << 32 | b
        known = self.pair.get(key)
        if known is None:
            want = [self.pieces[b]] if a < 0 else [self.pieces[a], self.pieces[b]]
            known = self.merged("".join(want)) == want
            if len(self.pair) >= MEMO_PAIRS:
                self.pair.clear()
            self.pair[key] = known
        return known

    def _walk(self, text: str) -> list[int]:
        """Backtracking over characters that are all in the alphabet."""
        n = len(text)
        if (whole := self.id_of.get(text)) is not None and self.fits(-1, whole):
            return [whole]
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, (i, size) in self.match.iter(text):
            starts[end + 1 - size].append(i)  # ends rise, so the longest comes last
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        tried: list[int] = []
        at, left, length, fits = 0, len(starts[0]), self.length, self.fits
        while at < n:
            here, before = starts[at], out[-1] if out else -1
            while left:
                left -= 1
                piece = here[left]
                to = at + length[piece]
                if not failed[to >> 3] >> (to & 7) & 1 and fits(before, piece):
                    out.append(piece)
                    tried.append(left)
                    at = to
                    left = len(starts[at]) if at < n else 0
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= length[out.pop()]
                left = tried.pop()
        return out

    def encode_chunk(self, chunk: str) -> list[int]:
        if self.alphabet.issuperset(chunk):
            return self._walk(chunk)
        out: list[int] = []
        run = 0
        for i, c in enumerate(chunk):
            if c not in self.alphabet:
                if run < i:
                    out += self._walk(chunk[run:i])
                out += [self.byte_id[b] for b in c.encode()] if self.byte_id else [self.unk]
                run = i + 1
        return out + (self._walk(chunk[run:]) if run < len(chunk) else [])

    def normal(self, text: str) -> str:
        return (SPACE if self.dummy else "") + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str | None) -> list[int]:
        return [i for c in self.chunks(self.normal(text or "")) for i in self.encode_chunk(c)]

    def _spell(self, ids: Iterable[int]) -> str:
        out, pending = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                pending.append(b)
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending.clear()
            if self.kind[i] == NORMAL:
                out.append(self.pieces[i])
            elif self.kind[i] == UNKNOWN:
                out.append(" ⁇ ")
        if pending:
            out.append(pending.decode(errors="replace"))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        text = self._spell(ids)
        return text[1:] if self.dummy and ids and self.pieces[ids[0]].startswith(SPACE) else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids joined by commas, SHA-256 of what the ids decode to)."""
        chunks = self.chunks(self.normal(text or ""))
        if not chunks:
            return 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()
        self.memo.trim()
        ids, spelt = zip(*map(self.memo.__getitem__, chunks))
        joined, back = ",".join(ids), "".join(spelt)
        if self.dummy and chunks[0][0] == SPACE:
            back = back[1:]
        return joined.count(",") + 1, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


class _Memo(dict):
    """chunk -> (its ids joined by commas, what they decode to); it starts again when full. Long chunks aren't kept."""

    def __init__(self, model: PieceModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, chunk: str) -> tuple[str, str]:
        ids = self.model.encode_chunk(chunk)
        got = ",".join(map(str, ids)), self.model._spell(ids)
        if len(chunk) <= 64:
            self[chunk] = got
        return got

    def trim(self) -> None:
        if len(self) > MEMO_CHUNKS:
            self.clear()


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """One model a worker process, kept between tasks."""
    return PieceModel(path)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array of int) and the decoded text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            for part in slices(batch):
                ids = [model.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, without carrying ids or texts onward."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            for part in slices(batch):
                n, ids, text = zip(*map(model.digest, part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
