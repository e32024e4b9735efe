"""Removal of every byte covered by a LENGTH-byte string that starts at two places or more of the corpus.

Sampled suffixes take the place of a full suffix array (see the README for why). Every LENGTH-byte window picks one of its
GRAM-byte strings, the one with the least hash, the leftmost of equals; what is picked depends on the window's bytes
alone, so equal windows pick alike, at the same offset. Picked positions, about two in LENGTH - GRAM, are the sampled
suffixes; each stands for the windows that pick it, so every window is looked at once. A sampled suffix whose gram occurs
once has no repeated window and is dropped after one count. Of the others, (gram, digest of the bytes of its windows) is
counted: where all suffixes of a gram agree, all their windows repeat. Only where a gram stands in different contexts are
those bytes fetched, one text for each distinct context, and the windows compared by hash and offset; the windows found
are induced back to every suffix with that context, wherever it is.

Beside the exact removal, `shared` tells of each text the longest passage of SHARED words or more that occurs elsewhere:
passages of over 50 words are often shorter than LENGTH bytes. It samples windows of words as the removal does windows of
bytes; words are told apart by 64-bit hashes.

A gram with more than MOST_CONTEXTS different contexts isn't brought together: its windows are dealt out by hash, so no
task holds a group that grows with the corpus.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH are kept whole; repeated rows are copies
of each other, so both lose their repeats; equal ids are told apart by their texts; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftrank.llm import tally
from driftrank.llm.textkit import Words, powers, slices, splitmix, utf8, words
from driftrank.tables import park, release

LENGTH, GRAM = 400, 48
REACH = LENGTH - GRAM
MOST_CONTEXTS = 20_000
U = np.uint64
_BYTE = splitmix(np.arange(256, dtype=U) + U(77))
_PLACE = U((1 << 24) - 1)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * U(0x9E3779B97F4A7C15) + b
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def grams(raw: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all strings of raw whose length is a power of two, for each such length up to the largest wanted."""
    out = {1: _BYTE[raw]}
    size = 1
    while size < max(sizes):
        h = out[size]
        out[2 * size] = _join(h[:-size], h[size:])
        size *= 2
        if size // 2 not in sizes:
            del out[size // 2]
    return out


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over every `width` neighbours."""
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return best(x[:-rest], x[rest:]) if rest else x


def _ahead(h: np.ndarray, off: np.ndarray, reach: int) -> np.ndarray:
    """For each place, how far ahead of it the least of the next reach + 1 hashes is, the leftmost of equals within a text."""
    n = off[-1]
    place = np.arange(n) - np.repeat(off[:-1], np.diff(off))

    def near(shift: int) -> np.ndarray:
        at = (place + shift).astype(U) & _PLACE
        least = _slide((h & ~_PLACE) | at[: len(h)], reach + 1, np.minimum)
        return ((least - at[: len(least)]) & _PLACE).astype(np.int64)

    out = near(0)
    if int(np.diff(off).max()) > int(_PLACE):  # places of a very long text start over; where they do, half a turn on is the truth
        wrapped = (place[: len(out)].astype(U) & _PLACE) > _PLACE - U(reach)
        out[wrapped] = near(int(_PLACE + U(1)) // 2)[wrapped]
    return out


def _picked(h: np.ndarray, off: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first and last window that picks it) of each place of h picked by some window of `length` within a text."""
    ahead = _ahead(h, off, reach)
    start = np.flatnonzero(np.arange(len(ahead)) + length <= np.repeat(off[1:], np.diff(off))[: len(ahead)])
    if not len(start):
        return start, start, start
    owner = start + ahead[start]
    new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return owner[new], start[new], start[np.append(new[1:], len(start)) - 1]


def sampled(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Picked strings that some window of a text picks: (position in raw, gram hash, first and last window that picks it).

    The windows that pick one string are neighbours, so each window belongs to one row.
    """
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, np.zeros(0, U), none, none
    g = grams(raw, (16, 32))
    h = _join(g[32][: n - GRAM + 1], g[16][32 : 32 + n - GRAM + 1])
    at, low, last = _picked(h, off, LENGTH, REACH)
    return at, h[at], low, last


_SUFFIX = "doc_id long, tag int, pos long, gram long, digest long, left int, right int"


def suffixes(docs: DataFrame) -> DataFrame:
    """A row for each sampled suffix: its text, place, gram, and digest and reach of the bytes around. docs: doc_id, tag, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, off = utf8(part.column("text"))
                at, h, low, last = sampled(raw, off)
                doc, high = np.searchsorted(off, at, side="right") - 1, last + LENGTH
                view = memoryview(np.ascontiguousarray(raw))
                digest = [xxhash.xxh3_64_intdigest(view[a:b], seed=i - a) for a, b, i in zip(low.tolist(), high.tolist(), at.tolist())]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("tag").take(take), pa.array(at - off[doc]), pa.array(h.view(np.int64)), pa.array(np.array(digest, U).view(np.int64)), pa.array((at - low).astype(np.int32)), pa.array((high - at).astype(np.int32))],
                    ["doc_id", "tag", "pos", "gram", "digest", "left", "right"],
                )

    return docs.mapInArrow(run, _SUFFIX)


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, digest, left, n, hot, bytes of the wanted contexts, read from one text each."""
    each = wanted.groupBy(F.col("doc_id").alias("i"), F.col("tag").alias("t")).agg(F.collect_list(F.struct("gram", "digest", "pos", "left", "right", "n", "hot")).alias("want"))  # of one text
    joined = docs.join(each, docs["doc_id"].eqNullSafe(each["i"]) & (docs["tag"] == each["t"])).select("text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text, want in zip(part.column("text").to_pylist(), part.column("want").to_pylist()):
                    raw = text.encode()
                    rows += [(w["gram"], w["digest"], w["left"], w["n"], w["hot"], raw[w["pos"] - w["left"] : w["pos"] + w["right"]]) for w in want]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["gram", "digest", "left", "n", "hot", "bytes"])

    # Rows that share an id and a text answer for the same contexts.
    return joined.mapInArrow(run, "gram long, digest long, left int, n long, hot boolean, bytes binary").dropDuplicates(["gram", "digest"])


def _windows(gram: np.ndarray, left: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, start in the row) of all windows; keys are equal for equal windows at equal offsets from equal grams."""
    size = np.array([len(b) for b in data], np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    raw = np.frombuffer(b"".join(data), np.uint8)
    g = grams(raw, (16, 128, 256))
    n = len(raw) - LENGTH + 1
    h = _join(_join(g[256][:n], g[128][256 : 256 + n]), g[16][384 : 384 + n])
    row = np.repeat(np.arange(len(data)), size)[:n]
    start = np.arange(n) - off[row]
    ok = np.flatnonzero(start + LENGTH <= size[row])
    row, start = row[ok], start[ok]
    key = _join(h[ok] ^ splitmix(gram.view(U))[row], (start - left[row] + REACH).astype(U))
    return key, row, start


def _ranges(row: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of maximal runs of consecutive rel; rows and rel ascend."""
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (rel[1:] != rel[:-1] + 1)]))
    return row[new], rel[new], rel[np.append(new[1:], len(row)) - 1]


_FOUND = "gram long, digest long, first int, last int"


def _repeats(contexts: DataFrame) -> DataFrame:
    """gram, digest, first, last: ranges of window starts, relative to the gram, that repeat. contexts: sorted by gram in partitions that hold whole grams."""

    def solve(gram: np.ndarray, digest: np.ndarray, left: np.ndarray, n: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
        key, row, start = _windows(gram, left, data)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = n[row] > 1
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        r, lo, hi = _ranges(row[at], start[at] - left[row[at]]) if len(at) else (at, at, at)
        return pa.RecordBatch.from_arrays([pa.array(gram[r]), pa.array(digest[r]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["gram", "digest", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                rows = list(zip(*[part.column(c).to_pylist() for c in ("gram", "digest", "left", "n", "bytes")]))
                held += rows
                size += sum(len(r[4]) for r in rows)
                if size >= 1 << 20 and held[0][0] != held[-1][0]:
                    cut = len(held) - 1
                    while held[cut][0] == held[-1][0]:
                        cut -= 1
                    done, held = held[: cut + 1], held[cut + 1 :]
                    size = sum(len(r[4]) for r in held)
                    yield solve(*[np.array(c, np.int64) for c in list(zip(*done))[:4]], [r[4] for r in done])
        if held:
            yield solve(*[np.array(c, np.int64) for c in list(zip(*held))[:4]], [r[4] for r in held])

    return contexts.mapInArrow(run, _FOUND)


def _repeats_dealt(contexts: DataFrame) -> DataFrame:
    """The same for grams of very many contexts: every window is a row, dealt by its key."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                gram, digest, left, n = (part.column(c).to_numpy().astype(np.int64) for c in ("gram", "digest", "left", "n"))
                key, row, start = _windows(gram, left, part.column("bytes").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(gram[row]), pa.array(digest[row]), pa.array((start - left[row]).astype(np.int32)), pa.array(n[row])], ["key", "gram", "digest", "rel", "n"])

    rows = contexts.mapInArrow(explode, "key long, gram long, digest long, rel int, n long")
    twice = rows.groupBy("key").agg(F.sum("n").alias("m")).where("m > 1").select("key")
    found = rows.join(twice, "key").select("gram", "digest", "rel")
    island = found.selectExpr("*", "rel - row_number() over (partition by gram, digest order by rel) as island")  # of one context
    return island.groupBy("gram", "digest", "island").agg(F.min("rel").alias("first"), F.max("rel").alias("last")).drop("island")


def removed(docs: DataFrame, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, tag, spans (array of first and end byte, overlaps possible) of texts with a repeated window. docs: doc_id, tag, text."""
    all_ = park(suffixes(docs), "suffixes")
    # Parked, the counts leave the join's own shuffle free to be split where one gram has very many suffixes.
    often = park(all_.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"), "grams-often")
    some = park(all_.join(often, "gram"), "suffixes-often")
    release(all_, often)
    kind = some.groupBy("gram", "digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tag", "pos", "left", "right")).alias("one"))
    kind = park(kind, "contexts")
    # Parked for the same reason, as are the ranges found: both meet all suffixes of a gram.
    many = park(kind.groupBy("gram").agg(F.count("*").alias("contexts")).where("contexts > 1"), "grams-mixed")
    wanted = kind.join(many, "gram").select("gram", "digest", "n", "one.*", (F.col("contexts") > most_contexts).alias("hot"))
    contexts = park(_contexts(docs, wanted), "context-bytes")
    cool, hot = contexts.where("not hot"), contexts.where("hot")
    found = _repeats(cool.repartition("gram").sortWithinPartitions("gram"))
    if not hot.isEmpty():
        found = found.union(_repeats_dealt(hot))
    found = park(found, "ranges")
    release(contexts)
    uniform = some.join(many, "gram", "left_anti").select("doc_id", "tag", (F.col("pos") - F.col("left")).alias("a"), (F.col("pos") + F.col("right")).alias("b")).where(f"b - a >= {LENGTH}")
    mixed = some.join(found, ["gram", "digest"]).select("doc_id", "tag", (F.col("pos") + F.col("first")).alias("a"), (F.col("pos") + F.col("last") + LENGTH).alias("b"))
    return uniform.union(mixed).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("a", "b")).alias("spans"))  # of one text, each once however many rows are equal to it


#: Passages count from SHARED words on: over 50, of which the first and the last may touch other text. A window of SHARED
#: words picks the least of its PIECE_REACH + 1 hashes of PIECE_GRAM words.
PIECE_GRAM, PIECE_REACH = 16, 32
SHARED = PIECE_GRAM + PIECE_REACH
ABROAD, HERE, OPEN = 1, 2, 4  # all windows of a range occur in another row, again in this one; its windows are to be looked up


def _prefixes(w: Words) -> np.ndarray:
    n = len(w.hash)
    upto = np.zeros(n + 1, U)
    np.cumsum(w.hash * powers(n)[0][:n], out=upto[1:])
    return upto


def _between(upto: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the words from a up to b."""
    return splitmix((upto[b] - upto[a]) * powers(len(upto))[1][a] + (b - a).astype(U))


def _times(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how often each key occurs in its row, whether it is there for the first time); rows ascend."""
    n, first = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    if len(key):
        order = np.argsort(key, kind="stable")
        k, r = key[order], row[order]
        new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])]))
        size = np.diff(new, append=len(key))
        n[order], first[order[new]] = np.repeat(size, size), True
    return n, first


def _longest(row: np.ndarray, more: list[np.ndarray], ok: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, words) of the longest run in each of n rows of windows that are ok. more: first window of each range, windows
    after it, first byte, end."""
    first, run, begin, end = more[:4]
    size, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.flatnonzero(ok)
    if len(at):
        r, a, b = row[at], first[at], first[at] + run[at]
        new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (a[1:] != b[:-1] + 1)]))
        last = np.append(new[1:], len(at)) - 1
        np.maximum.at(size, r[new], end[at[last]] - begin[at[new]])
        np.maximum.at(count, r[new], b[last] + SHARED - a[new])
    return size, count


def shared(docs: DataFrame) -> DataFrame:
    """doc_id, tag, longest, words: bytes of the longest stretch of a text of which every SHARED consecutive words occur a second
    time, in any text or in this one; words of the longest of which every SHARED consecutive words occur in another row. Rows
    without either may be missing. docs: doc_id, tag, text.

    Blocks of texts ask in how many rows their picked grams and the words of all windows around each (its context) occur
    (tally.py), so a passage that many texts hold is one row a block. A context that occurs in two rows settles its windows.
    Only the windows of grams that stand in different contexts are looked up one by one: of a gram with a context of which
    there are fewer, or with two in one row.
    """

    def make(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        w = words(*utf8(part.column("text")))
        if len(w.hash) < SHARED:
            return np.zeros(part.num_rows, np.int64), np.zeros(0, U), [np.zeros(0, np.int64)] * 4
        h, size = w.hash, 1
        while size < PIECE_GRAM:
            h, size = _join(h[:-size], h[size:]), 2 * size
        at, low, last = _picked(h, w.first, SHARED, PIECE_REACH)
        doc = w.doc[at]
        keys = np.stack([h[at], _between(_prefixes(w), low, last + SHARED)], 1).ravel()
        return 2 * np.bincount(doc, minlength=part.num_rows), keys, [low - w.first[doc], last - low, w.start[low] - w.off[doc], w.end[last + SHARED - 1] - w.off[doc]]

    def rows_of(per: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(per)), per)

    def once(per: np.ndarray, keys: np.ndarray, more: list[np.ndarray]) -> np.ndarray:
        return _times(rows_of(per), keys)[1]

    def settle(ids: list, tags: list, per: np.ndarray, keys: np.ndarray, total: np.ndarray, more: list[np.ndarray]) -> pa.RecordBatch:
        row = rows_of(per // 2)
        grams_here, here = _times(row, keys[::2])[0], _times(row, keys[1::2])[0]
        everywhere, alike = total[::2], total[1::2]
        flags = ABROAD * (alike > 1) + HERE * (here > 1) + OPEN * ((everywhere > alike) | (grams_here > here))
        longest, count = _longest(row, more, (flags & (ABROAD | HERE)) > 0, len(per))[0], _longest(row, more, (flags & ABROAD) > 0, len(per))[1]
        unsettled = np.zeros(len(per), bool)
        unsettled[row[(flags & OPEN) > 0]] = True
        keep = np.flatnonzero(unsettled | (longest > 0))
        at = np.flatnonzero(unsettled[row] & (flags > 0))
        off = np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=len(per))[keep])])
        ranges = pa.StructArray.from_arrays([pa.array(x[at].astype(np.int32)) for x in (more[0], more[1], flags)], ["low", "run", "flags"])
        rows = pa.array(keep)
        cols = [pa.array(ids, pa.int64()).take(rows), pa.array(tags, pa.int32()).take(rows), pa.array(longest[keep]), pa.array(count[keep]), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), ranges)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "tag", "longest", "words", "ranges"])

    def windows(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """A key for each window of an open range; a settled range stays whole and asks for key 0, whose answer isn't used."""
        w = words(*utf8(part.column("text")))
        ranges = part.column("ranges")
        low, run, flags = (ranges.flatten().field(c).to_numpy().astype(np.int64) for c in ("low", "run", "flags"))
        doc = rows_of(ranges.value_lengths().to_numpy())
        is_open = (flags & OPEN) > 0
        each = np.where(is_open, run + 1, 1)
        of = rows_of(each)
        first = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        rest, doc = np.where(is_open, 0, run)[of], doc[of]
        a = w.first[doc] + first
        keys = np.where(is_open[of], _between(_prefixes(w), a, a + SHARED), U(0))
        return np.bincount(doc, minlength=part.num_rows), keys, [first, rest, w.start[a] - w.off[doc], w.end[a + rest + SHARED - 1] - w.off[doc], flags[of]]

    def known(per: np.ndarray, keys: np.ndarray, more: list[np.ndarray]) -> np.ndarray:
        """A window of a context that occurs in two rows counts for two: the other row need not have been asked for it."""
        return once(per, keys, more) + (more[4] & ABROAD)

    def finish(ids: list, tags: list, per: np.ndarray, keys: np.ndarray, total: np.ndarray, more: list[np.ndarray]) -> pa.RecordBatch:
        row, flags = rows_of(per), more[4]
        is_open = (flags & OPEN) > 0
        abroad = ((flags & ABROAD) > 0) | (is_open & (total > 1))
        here = ((flags & HERE) > 0) | (is_open & (_times(row, keys)[0] > 1))
        cols = [pa.array(ids, pa.int64()), pa.array(tags, pa.int32()), pa.array(_longest(row, more, abroad | here, len(per))[0]), pa.array(_longest(row, more, abroad, len(per))[1])]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "tag", "longest", "words"])

    kind = "doc_id long, tag int, longest long, words long"
    found = tally.looked_up(docs, make, settle, f"{kind}, ranges array<struct<low: int, run: int, flags: int>>", "shared", once)
    each = found.where("size(ranges) > 0").groupBy(F.col("doc_id").alias("i"), F.col("tag").alias("t")).agg(F.first("ranges").alias("ranges"))  # of one text
    unsettled = docs.join(each, docs["doc_id"].eqNullSafe(each["i"]) & (docs["tag"] == each["t"])).select("doc_id", "tag", "text", "ranges")
    return found.where("size(ranges) = 0").drop("ranges").unionByName(tally.looked_up(unsettled, windows, finish, kind, "shared-windows", known))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, kept (binary), spans (array of removed byte ranges), n_bytes, n_removed, longest_shared, shared_words of each row.

    longest_shared: bytes of the longest stretch that shared() finds, or without one, of the longest removed one (long words);
    shared_words: shared()'s words.
    """
    rows = docs.select("doc_id", F.hash(F.coalesce("text", F.lit(""))).alias("tag"), "text")
    alike = shared(rows.where(f"octet_length(text) >= {2 * SHARED - 1}"))
    # Both sides have a row for each of a text's repeated rows at most.
    found = removed(rows.where(f"octet_length(text) >= {LENGTH}"), most_contexts).withColumns({c: F.lit(0).cast("long") for c in ("longest", "words")})
    both = found.unionByName(alike.withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType)))
    gone = both.groupBy(F.col("doc_id").alias("i"), F.col("tag").alias("t")).agg(F.first("spans", ignorenulls=True).alias("spans"), F.max("longest").alias("longest"), F.max("words").alias("words"))
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["i"]) & (rows["tag"] == gone["t"]), "left").select("doc_id", "text", "spans", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("longest", "words")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                kept, spans, size, longest = [], [], [], []
                for text, found, least in zip(*[part.column(c).to_pylist() for c in ("text", "spans", "longest")]):
                    raw, runs = (text or "").encode(), merged(found)
                    edge = [0, *[x for r in runs for x in r], len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2])))
                    spans.append([{"a": a, "b": b} for a, b in runs])
                    size.append(len(raw))
                    longest.append(least or max([0, *[b - a for a, b in runs]]))
                kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(kept, pa.binary()), pa.array(spans, kind), pa.array(size, pa.int64()), pa.array([n - len(k) for n, k in zip(size, kept)], pa.int64()), pa.array(longest, pa.int64()), part.column("words")],
                    ["doc_id", "kept", "spans", "n_bytes", "n_removed", "longest_shared", "shared_words"],
                )

    return joined.mapInArrow(run, "doc_id long, kept binary, spans array<struct<a: long, b: long>>, n_bytes long, n_removed long, longest_shared long, shared_words long")
