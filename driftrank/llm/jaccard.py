"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, with size-derived bounds.

The incidence has a row for each distinct set of word n-grams (copies are one row). Its columns, the n-grams by hash,
are dealt into blocks. Two rows of sizes a <= b link only if b <= a / t and they differ in at most
D = (a + b)(1 - t) / (1 + t) n-grams. Sizes are put into classes; for each class of the smaller size, the largest D sets
the number of blocks to more than D. A row with more than D filled blocks then agrees with every linked row on all of at
least one filled block. So the product is first taken block by block over equal block rows only: a block row is one hash,
equal hashes meet in one run of a sorted shuffle, and their agreements accumulate for each pair (row, least row of the
run). Rows with too few filled blocks also take part under further dealings until one has enough, which keeps this exact.

Each row gets its exact overlap, from the two texts, with the one least row that it agrees with most among those the bounds
leave. Runs that hold rows of one component only are then done. In the others the least row of the least component meets, of
each other component, the row that agrees with it most. What is still undecided is where a run holds rows of several
components. There, rows stay whose blocks agree with other components' rows of a size that can link in as many places as the
size bounds require. For those alone the full product follows: a row is counted, for each step of sizes
that can link with it, the n-grams that rows of other components and that size hold; where the count is below the overlap that
the sizes require, nothing of that size can link, and a row without a size left goes, until no more go. Of what is left,
pairs meet in the rarest n-grams that the bound requires. A bitmap of each row's n-grams rules out pairs whose bits already
differ in more places than linked rows of their sizes can; the others again get their exact overlap.

Defined results: null and empty texts have size 0 and link with nothing; with fewer words than n, the whole sequence is
the one n-gram; copies link; a null id has a null component and passes no link on; rows that share an id are one node;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftrank.llm.components import components
from driftrank.llm.textkit import distinct, plain_names, shingles, slices, splitmix, utf8, words
from driftrank.tables import park, release

U = np.uint64
MOST_DEALS = 64


def _bounds() -> list[int]:
    """Least size of each class: steps of a half, so that linked sizes (t >= 0.67) are in one class or in neighbours."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-3 * out[-1] // 2)))
    return out


LEAST = np.array(_bounds(), np.int64)


def most_apart(cls: int, num: int, den: int = 100) -> int:
    """The most n-grams by which linked sets differ, if the smaller one is in class cls. t = num / den."""
    a = int(LEAST[cls + 1]) - 1
    b = a * den // num
    return (a + b) * (den - num) // (den + num)


@lru_cache(maxsize=None)
def blocks_of(cls: int, num: int) -> int:
    """The least number of blocks of which a smallest row of the class is expected to fill some more than most_apart."""
    apart, size = most_apart(cls, num), int(LEAST[cls])
    if not apart:
        return 1
    low, high = apart + 1, 64 * (size + apart)
    while low < high:
        mid = (low + high) // 2
        if -mid * math.expm1(-size / mid) >= min(1.03 * (apart + 1) + 0.5, size - 0.25):
            high = mid
        else:
            low = mid + 1
    return low


def block_rows(h: np.ndarray, num: int) -> tuple[np.ndarray, list[int]]:
    """Hashes of the filled blocks of a row with the distinct n-gram hashes h, for each class it can link in.

    The lowest bit of a hash is that of its class, the next one tells later dealings from the first. With them: the number
    of blocks filled in the first dealing, for the even and the odd class (-1 for none).
    """
    n = len(h)
    cls = int(np.searchsorted(LEAST, n, side="right")) - 1
    families = [cls]
    if cls and n <= (int(LEAST[cls]) - 1) * 100 // num:
        families.append(cls - 1)
    out, filled = [], [-1, -1]
    for family in families:
        apart = most_apart(family, num)
        for deal in range(MOST_DEALS):
            blocks = blocks_of(family, num) * (4 + deal) // 4 if apart else 1
            v = np.sort(splitmix(h ^ U(deal * 0x9E3779B9 + 17)))
            block = ((v >> U(32)) * U(blocks)) >> U(32)
            cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            rows = np.add.reduceat(splitmix(v), cut)
            rows = splitmix(rows ^ splitmix(block[cut] + U((family << 40) + (deal << 32))))
            out.append(rows & ~U(3) | U(family & 1 | (deal > 0) << 1))
            if not deal:
                filled[family & 1] = len(cut)
            if len(cut) > apart:
                break
        else:
            raise RuntimeError("no dealing fills enough blocks")
    return np.concatenate(out), filled


def ngram_sets(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's n-grams, and offsets."""
    raw, off = utf8(part.column("text"))
    h, owner = shingles(words(raw, off, lower=True), k)
    return distinct(h, owner, part.num_rows)


def incidence(docs: DataFrame, k: int, num: int) -> DataFrame:
    """doc_id, n, d1, d2 (128-bit digest of the set), rows (hashes of the filled blocks), f0, f1 (blocks filled for the even and the odd class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, off = ngram_sets(part, k)
                n = np.diff(off)
                sums = [np.concatenate([np.zeros(1, U), np.cumsum(splitmix(h ^ U(s)), dtype=U)]) for s in (0xA5A5, 0x5C5C)]
                digest = [(s[off[1:]] - s[off[:-1]]).view(np.int64) for s in sums]
                made = [block_rows(h[a:b], num) if b > a else (h[:0], [-1, -1]) for a, b in zip(off[:-1], off[1:])]
                rows = [m[0] for m in made]
                filled = [pa.array([m[1][i] for m in made], pa.int32()) for i in (0, 1)]
                ends = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) for r in rows], out=ends[1:])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *map(pa.array, digest), lists, *filled], ["doc_id", "n", "d1", "d2", "rows", "f0", "f1"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, rows array<long>, f0 int, f1 int")


def _runs(cells: DataFrame) -> DataFrame:
    """cell, node of cells that hold two nodes or more. cells: sorted by cell within partitions that hold whole cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, bool] | None = None  # cell, first node, whether that row has been given out
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, node = (batch.column(c).to_numpy() for c in ("cell", "node"))
            head = np.concatenate([[True], cell[1:] != cell[:-1]])
            start = np.flatnonzero(head)
            first = node[start].copy()
            joined = last is not None and last[0] == cell[0]
            if joined:
                first[0] = last[1]
            which = np.cumsum(head) - 1
            other = node != first[which]
            live = np.zeros(len(start), bool)
            live[which[other]] = True
            if joined and last[2]:
                live[0] = True
            keep = live[which]
            c, v = cell[keep], node[keep]
            if joined and live[0] and not last[2]:
                c, v = np.append(c, last[0]), np.append(v, last[1])
            same = joined and len(start) == 1
            last = (int(cell[-1]), int(first[-1]), bool(live[-1]) or (same and last[2]))
            if len(c):
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(v)], ["cell", "node"])

    return cells.mapInArrow(run, "cell long, node long")


def _overlaps(pairs: DataFrame, texts: DataFrame, k: int, num: int) -> DataFrame:
    """Those of the pairs (a, b) whose exact overlap reaches the bound: 100 * common >= num * union."""
    pairs = park(pairs.select("a", "b"), "candidates")
    one, two = (park(pairs.select(F.col(x).alias("node")).distinct(), f"candidates-{x}") for x in "ab")
    left = _among(texts, one).select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = _among(texts, two).select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                one = part.column("text_a").dictionary_encode()  # a least row meets many others: its set is made once
                sets = ngram_sets(pa.RecordBatch.from_arrays([one.dictionary], ["text"]), k)
                two = ngram_sets(part.select(["text_b"]).rename_columns(["text"]), k)
                ok = np.zeros(part.num_rows, bool)
                for i, d in enumerate(one.indices.to_pylist()):
                    x, y = sets[0][sets[1][d] : sets[1][d + 1]], two[0][two[1][i] : two[1][i + 1]]
                    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < num * max(len(x), len(y)):
                        continue
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    common = int((x[at] == y).sum())
                    ok[i] = 100 * common >= num * (len(x) + len(y) - common)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(ok)), part.column("b").filter(pa.array(ok))], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _closest(met: DataFrame, by: list[str], of: str) -> DataFrame:
    """For each group of `by` the row of column `of` with the most agreements, the least one of equals."""
    return met.groupBy(*by).agg(F.max_by(of, F.struct("agreements", F.bitwise_not(F.col(of)).alias("back"))).alias(of))


def _mixed(shared: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of shared whose cell holds several components, with their component; lo, a, size: least component of the cell, its least row, that row's size."""
    component = F.coalesce("component", "node").alias("component")
    named = park(shared.select("cell", "node", "n", "f0", "f1").join(label, "node", "left").select("cell", "node", "n", "f0", "f1", component), "labelled")
    least = named.groupBy("cell").agg(F.min(F.struct("component", "node", "n")).alias("least"), F.max("component").alias("z")).where("least.component < z")
    mixed = park(named.join(least.selectExpr("cell", "least.component as lo", "least.node as a", "least.n as size"), "cell"), "mixed")
    release(named)
    return mixed


def _columns(texts: DataFrame, k: int) -> DataFrame:
    """node, n, h: the incidence of the given rows, one row an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, off = ngram_sets(part, k)
                n = np.diff(off)
                node = part.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, n)), pa.array(np.repeat(n, n)), pa.array(h.view(np.int64))], ["node", "n", "h"])

    return texts.select("node", "text").mapInArrow(run, "node long, n long, h long")


#: Ratio of neighbouring steps of sizes. An entry meets each step that can link with it once, so a ratio near 1 multiplies
#: entries (by up to 89 steps at 1.005 and a similarity of 0.8; 15 at 1.03) as more sizes occur.
COARSE = 1.03


def _step(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(COARSE) + 1e-9).cast("int")


def _hits(entries: DataFrame, key: str, num: int) -> DataFrame:
    """The entries (node, component, n, step, key) that a row of another component, of a size that can link, holds too; partner is the step of that size."""
    held = entries.groupBy(key, F.col("step").alias("partner")).agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    low, high = _step(F.ceil(F.col("n") * num / 100)), _step(F.floor(F.col("n") * 100 / num))
    return entries.withColumns({"low": low, "high": high}).join(held, key).where("partner between low and high and (lo <> component or hi <> component)").drop("low", "high", "lo", "hi")


def _apart(num: int, other: Column) -> Column:
    """The most n-grams by which a row of size n and a linked one of size `other` differ."""
    return F.floor((F.col("n") + other) * (100 - num) / (100 + num) + 1e-9)


def _open(shared: DataFrame, label: DataFrame, num: int) -> DataFrame:
    """node, component of rows that rows of other components agree with in as many blocks as a link needs.

    Of the blocks that a row fills, all but those that its differences reach agree with a linked row's.
    """
    named = shared.select("cell", "node", "n", "f0", "f1").join(label, "node", "left").withColumns({"component": F.coalesce("component", "node"), "step": _step(F.col("n"))})
    filled = F.when(F.col("cell") % 2 == 0, F.col("f0")).otherwise(F.col("f1"))
    now = park(named.select("cell", "node", "component", "n", "step", filled.alias("filled")), "agreeing")
    left = now.count()
    while left:
        hits = _hits(now.where("cell & 2 = 0"), "cell", num)
        largest = F.ceil(F.pow(F.lit(COARSE), F.col("partner") + 1))
        enough = hits.groupBy("node", "n", "filled", F.expr("cell & 1").alias("class"), "partner").agg(F.count("*").alias("m")).where(F.col("m") >= F.col("filled") - _apart(num, largest))
        # Rows that may agree with a linked one in none of their first blocks are never ruled out.
        unsure = now.where((F.expr("cell & 2") > 0) | (F.col("filled") <= _apart(num, F.ceil(F.col("n") * 100 / num))))
        alive = enough.select("node").union(unsure.select("node")).distinct()
        last, now = now, park(now.join(alive, "node", "left_semi"), "agreeing")
        release(last)
        before, left = left, now.count()
        if left > 0.9 * before:
            break
    return now.select("node", "component").distinct()


def _needed(num: int) -> Column:
    """The least overlap of a row of size n with a linked one of the step `partner`."""
    least = F.ceil(F.pow(F.lit(COARSE), F.col("partner")) * (1 - 1e-9))
    return F.ceil(num * (F.col("n") + least) / (100 + num) - 1e-9)


#: Words of 64 bits in a row's bitmap. Rows of very many n-grams fill it and are not told apart by it, which only leaves more to check.
BITMAP = 8


def _bitmaps(entries: DataFrame) -> DataFrame:
    """node, bits: a bit for each of 64 * BITMAP classes of n-grams, set where the row holds one of the class."""
    word, bit = F.expr(f"pmod(shiftright(h, 6), {BITMAP})"), F.expr("shiftleft(1L, cast(h & 63 as int))")
    words = [F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(BITMAP)]
    return entries.groupBy("node").agg(*words).select("node", F.array(*[f"w{i}" for i in range(BITMAP)]).alias("bits"))


def _can_link(num: int) -> Column:
    """Whether rows a and b may link: of each, no more bits than n-grams that linked rows of these sizes need not share are missing in the other,
    and the n-gram in which they meet can be the first of as many common ones as a link needs."""
    needed = F.ceil(num * (F.col("n_a") + F.col("n_b")) / (100 + num) - 1e-9)

    def fits(x: str, y: str) -> Column:
        missing = [F.bit_count(F.col(f"bits_{x}")[i].bitwiseAND(F.bitwise_not(F.col(f"bits_{y}")[i]))) for i in range(BITMAP)]
        return (sum(missing[1:], missing[0]) <= F.col(f"n_{x}") - needed) & (F.col(f"place_{x}") <= F.col(f"m_{x}") - needed + 1)

    return fits("a", "b") & fits("b", "a")


def _rest(shared: DataFrame, texts: DataFrame, label: DataFrame, k: int, num: int) -> DataFrame:
    """Candidate pairs (a, b) of different components among rows whose cells hold several components."""
    open_ = park(_open(shared, label, num), "open")
    read = _columns(_among(texts, open_.select("node")), k)
    entries = park(read.join(open_, "node").select("node", "component", "n", _step(F.col("n")).alias("step"), "h"), "columns")
    left = entries.count()
    while left:
        hits = _hits(entries, "h", num)
        alive = hits.groupBy("node", "n", "partner").agg(F.count("*").alias("m")).where(F.col("m") >= _needed(num)).select("node").distinct()
        last, entries = entries, park(entries.join(alive, "node", "left_semi"), "columns")
        release(last)
        before, left = left, entries.count()
        if left > 0.9 * before:
            break
    df = entries.groupBy("h").agg(F.count("*").alias("df"))
    ranked = _hits(entries, "h", num).join(df, "h").selectExpr(
        "*", "row_number() over (partition by node, partner order by df, h) as place", "count(*) over (partition by node, partner) as m"
    )
    # Of two linked rows' m shared entries each, needed ones are common; so one is among the first m - needed + 1 of both.
    prefix = ranked.where(F.col("place") <= F.col("m") - _needed(num) + 1).join(_bitmaps(entries), "node")
    left_, right = (prefix.select(*[F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "n", "step", "partner", "place", "m", "bits")], "h") for x in "ab")
    pairs = left_.join(right, (left_["h"] == right["h"]) & (left_["step_a"] == right["partner_b"]) & (left_["partner_a"] == right["step_b"]))
    pairs = pairs.where(f"component_a < component_b and 100 * least(n_a, n_b) >= {num} * greatest(n_a, n_b)").where(_can_link(num))
    return pairs.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.count("*").alias("agreements"))


#: Up to so many ids (16 bytes each) a selection of texts is made by a broadcast; for more, the texts are shuffled.
BROADCAST_IDS = 2_000_000


def _among(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts whose node is among ids, which are parked and distinct."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return texts.join(ids, "node", "left_semi")


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that links reach), class_id (the least id with the same set) of each row."""
    if not 67 <= percent <= 100:
        raise ValueError("size classes hold for similarities from 0.67 on")
    table = park(incidence(docs, k, percent), "incidence")
    # Parked, the classes leave the join's own shuffle free to be split where one set has very many copies.
    classes = park(table.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id")), "sets")
    named = park(table.select("doc_id", "n", "d1", "d2", "f0", "f1").join(classes, ["n", "d1", "d2"], "left").select("doc_id", "n", "f0", "f1", "class_id"), "classes")
    spread = table.where("n > 0 and doc_id is not null").select(F.explode("rows").alias("cell"), F.col("doc_id").alias("node"))
    live = park(_runs(spread.repartition("cell").sortWithinPartitions("cell")), "runs")
    release(table, classes)
    member = named.where("class_id is not null").select(F.col("doc_id").alias("node"), "class_id", "n", "f0", "f1").distinct()
    cells = park(live.join(member, "node").select("cell", F.col("class_id").alias("node"), "n", "f0", "f1").distinct(), "cells")
    release(live)
    pivots = cells.groupBy("cell").agg(F.min(F.struct("node", "n")).alias("least"), F.max("node").alias("z")).where("least.node < z").selectExpr("cell", "least.node as a", "least.n as size")
    fits = f"node <> a and 100 * least(n, size) >= {percent} * greatest(n, size)"
    shared = park(cells.join(pivots, "cell"), "shared")
    release(cells)
    met = shared.where(fits).groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("agreements"))
    pairs = park(_closest(met, ["b"], "a"), "pairs")
    wanted = park(shared.select("node").distinct(), "wanted")
    texts = park(_among(docs.select(F.col("doc_id").alias("node"), "text"), wanted), "texts")
    lowest = member.groupBy("node").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).where("a < z").select("node", "a")
    same_id = member.join(lowest, "node").where("class_id <> a").select("a", F.col("class_id").alias("b"))
    links = park(_overlaps(pairs, texts, k, percent).union(same_id), "links")
    release(pairs)
    label = components(links)
    mixed = _mixed(shared, label)
    release(shared)
    met = mixed.where(f"component <> lo and {fits}").groupBy("a", "component", F.col("node").alias("b")).agg(F.count("*").alias("agreements"))
    between = park(_overlaps(_closest(met, ["a", "component"], "b"), texts, k, percent), "links")
    if not between.isEmpty():
        label = components(links.union(between))
    more = park(_overlaps(_rest(mixed, texts, label, k, percent), texts, k, percent), "links")
    if not more.isEmpty():
        label = components(links.union(between).union(more))
    release(texts, mixed, wanted, links, between, more)
    out = named.join(label.withColumnRenamed("node", "class_id"), "class_id", "left")
    linked = F.coalesce("component", "class_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), linked).alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


@plain_names
def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each component the document with the least id stays; rows without an id stay."""
    found = join(docs.select("doc_id", "text"), k, percent)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    return left
