"""LambdaRank: boosted trees on pairwise gradients within groups, stopped on a validation slice.

Rows are binned once. A round then takes one pass for gradients and one for each level of its tree:

- The objective is nDCG cut at TOP rows of a group. A pair counts by how much swapping it would move that, which is nothing
  for two rows beyond the cut; so each row meets the at most TOP leading rows of its group and no group is held anywhere,
  however many rows it has. What a pair does to the leading row is given out as a row of its own with that row's bins, and
  since histograms are sums, nothing has to be joined back.
- Groups of at most MOST_WHOLE rows, which are nearly all of them, are written once in blocks of whole groups: a row a block. A round
  takes their scores, gradients and nDCG block by block, without a shuffle. Only larger groups take the way above.
- A level's histograms (gradient, curvature and rows by node, feature and bin) are summed within tasks, then by key; nodes x
  features x bins cells reach the driver, which picks each node's best split.

Each round's gradients are written to the shared folder and deleted after its tree, so lineage stays one round long; scores of blocks
are made from the trees since they were last written, which is every FRESH rounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftrank.operators import trees
from driftrank.operators.metrics import ndcg_at
from driftrank.tables import park, release, spread

TOP = 30
BINS = 64  # of a numeric feature, 0 holds missing values; of a categorical one, the last does
MOST_CATEGORIES = BINS - 2
MOST_WHOLE = 1024
BLOCK = 4096
FRESH = 16
_ROWS = "g string, id long, y int, s double, bins binary"
_BLOCKS = "size array<int>, id array<long>, y array<int>, s array<double>, bins binary"
_PASS = "leading boolean, g string, id long, y int, s double, bins binary, grad double, curve double, loss double, pairs long"


@dataclass
class Fitted:
    forest: trees.Forest
    rounds: list[dict]  # loss (mean over training pairs before the round's tree, None where there are none) and valid (nDCG of the validation rows after it)
    best: int  # trees kept


@dataclass
class _Binner:
    numeric: list[str]
    edges: list[np.ndarray]
    categorical: list[str]
    codes: dict[str, list]

    def table(self, df: DataFrame, group: Sequence[str], label: str, key: Sequence[str]) -> DataFrame:
        rows = df.select(
            F.concat_ws("\x1f", *group).alias("g"), F.xxhash64(*key, F.monotonically_increasing_id()).alias("id"), F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("y"),
            *[F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(self.numeric)], *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(self.categorical)],
        )

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = np.zeros((len(f), len(self.numeric) + len(self.categorical)), np.uint8)
                for i in range(len(self.numeric)):
                    x = f[f"n{i}"].to_numpy(np.float64, na_value=np.nan)
                    out[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(self.edges[i], x, side="left"))
                for i, c in enumerate(self.categorical):
                    code = pd.Index(self.codes[c]).get_indexer(f[f"c{i}"])
                    out[:, len(self.numeric) + i] = np.where(code < 0, BINS - 1, code + 1)
                yield pd.DataFrame({"g": f["g"], "id": f["id"], "y": f["y"], "s": 0.0, "bins": [r.tobytes() for r in out]})

        return park(rows.mapInPandas(run, _ROWS), "binned")


def _binner(train: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str]) -> _Binner:
    """Edges at quantiles of the training rows; categories in the order of their training rate, which makes splits between neighbours
    in that order the best ones. Beyond MOST_CATEGORIES the rarest count as missing."""
    at = [i / (BINS - 2) for i in range(BINS - 1)]
    found = train.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 10_000).alias(f"q{i}") for i, c in enumerate(numeric)]).first() if numeric else []
    edges = [np.unique(np.array([x for x in (q or []) if x is not None and x == x], np.float64))[:-1] for q in found]
    codes = {}
    for c in categorical:
        seen = train.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate")).orderBy(F.desc("n"), "v").limit(MOST_CATEGORIES)
        codes[c] = [r.v for r in sorted(seen.collect(), key=lambda r: (r.rate, r.v))]
    return _Binner(list(numeric), edges, list(categorical), codes)


def _sums(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The sum of x at each of n places, always of doubles: bincount of no rows gives whole numbers, which a batch's schema is not to follow."""
    return np.bincount(at, x, minlength=n).astype(np.float64, copy=False)


def _leading(rows: DataFrame, by: str) -> DataFrame:
    """The first TOP rows of each group by descending `by`, with their place from 1."""
    w = Window.partitionBy("g").orderBy(F.desc(by), "id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= TOP)


def _ideal(rows: DataFrame) -> DataFrame:
    """g, ideal: the best cut DCG of groups whose rows differ in relevance."""
    varied = rows.groupBy("g").agg(F.min("y").alias("a"), F.max("y").alias("b")).where("a < b").select("g")
    best = _leading(rows, "y").groupBy("g").agg(F.sum((F.pow(F.lit(2.0), "y") - 1) / F.log2(F.col("place") + 1.0)).alias("ideal"))
    return park(best.join(varied, "g"), "ideal")


def _gradients(rows: DataFrame, ideal: DataFrame) -> DataFrame:
    """Each row with its gradient and curvature against its group's leading rows, and what those get from it."""
    lead = _leading(rows, "s").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("place", "id", "y", "s", "bins"))).alias("lead"))
    # Written first, so that both sides of the join below are tables and a group with very many rows can be split.
    lead = park(lead.join(ideal, "g"), "leading")
    both = rows.join(lead, "g", "left")  # groups of one relevance have no pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, s, id_ = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "s", "id"))
            lists = batch.column("lead")
            size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = lists.flatten()
            p, pid, py, ps = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            me = np.repeat(np.arange(len(y)), size)
            # Where a row leads itself, it meets those before it only, so a pair is met once.
            own = np.full(len(y), TOP + 1)
            same = pid == id_[me]
            own[me[same]] = p[same]
            use = np.flatnonzero((py != y[me]) & (p < own[me]))
            me, p, py, ps, at = me[use], p[use], py[use], ps[use], use
            discount = lambda place: np.where(place > TOP, 0.0, 1 / np.log2(place + 1.0))
            ideal_ = batch.column("ideal").to_numpy(zero_copy_only=False)[me]
            moves = np.abs(np.exp2(py) - np.exp2(y[me])) * np.abs(discount(p) - discount(own[me])) / ideal_
            sign = np.where(y[me] > py, 1.0, -1.0)
            gap = np.clip(sign * (s[me] - ps), -50, 50)
            rho = 1 / (1 + np.exp(gap))
            push, curve = -sign * rho * moves, rho * (1 - rho) * moves
            total = lambda x: _sums(me, x, len(y))
            yield pa.RecordBatch.from_pydict({
                "leading": np.zeros(len(y), bool), "g": batch.column("g"), "id": id_, "y": batch.column("y"), "s": s, "bins": batch.column("bins"),
                "grad": total(push), "curve": total(curve), "loss": total(np.log1p(np.exp(-gap))), "pairs": total(np.ones(len(me))).astype(np.int64),
            })
            if len(at):  # the leading rows' sides, summed for each leading row of the batch
                key, first, back = np.unique(pid[at], return_index=True, return_inverse=True)
                none = np.zeros(len(key))
                yield pa.RecordBatch.from_pydict({
                    "leading": np.ones(len(key), bool), "g": pa.nulls(len(key), pa.string()), "id": key, "y": pa.nulls(len(key), pa.int32()), "s": none, "bins": flat.field(4).take(pa.array(at[first])),
                    "grad": _sums(back, -push, len(key)), "curve": _sums(back, curve, len(key)), "loss": none, "pairs": none.astype(np.int64),
                })

    out = park(both.select("g", "id", "y", "s", "bins", "lead", "ideal").mapInArrow(run, _PASS), "gradients")
    release(lead)
    return out


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(blocks of whole groups, rows of groups of more than MOST_WHOLE rows or None)"""
    sizes = park(rows.groupBy("g").agg(F.count("*").alias("n")), "group-sizes")
    large = sizes.where(F.col("n") > MOST_WHOLE).select("g")
    loose = None if large.isEmpty() else park(rows.join(large, "g", "left_semi"), "loose")
    small = rows if loose is None else rows.join(large, "g", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def told(table: pa.Table) -> pa.RecordBatch:
            g = table.column("g").combine_chunks().dictionary_encode().indices.to_numpy()
            size = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])), [len(g)]])).astype(np.int32)
            lists = [pa.array([table.column(c).to_numpy()], pa.list_(t)) for c, t in (("id", pa.int64()), ("y", pa.int32()), ("s", pa.float64()))]
            return pa.RecordBatch.from_arrays([pa.array([size], pa.list_(pa.int32())), *lists, pa.array([b"".join(table.column("bins").to_pylist())])], ["size", "id", "y", "s", "bins"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                table = pa.Table.from_batches(held)
                last = table.column("g")[n - 1]
                keep = pa.compute.sum(pa.compute.equal(table.column("g"), last)).as_py()  # the last group may go on
                if n > keep:
                    yield told(table.slice(0, n - keep))
                    table = table.slice(n - keep)
                held, n = table.to_batches(), table.num_rows
        if n:
            yield told(pa.Table.from_batches(held))

    (dealt,) = spread(sizes.agg(F.sum("n")).first()[0] or 0, (small, "g"))
    dealt = dealt if dealt is not small else small.repartition("g")
    blocks = park(dealt.sortWithinPartitions("g").mapInArrow(run, _BLOCKS), "blocks")
    release(sizes)
    return blocks, loose


@dataclass
class _Block:
    group: np.ndarray
    start: np.ndarray  # a row number for each group
    size: np.ndarray
    id: np.ndarray
    y: np.ndarray
    s: np.ndarray
    bins: np.ndarray

    def placed(self, by: np.ndarray) -> np.ndarray:
        """The place from 1 of each row in its group by descending `by`, equals by id."""
        order = np.lexsort((self.id, -by, self.group))
        place = np.empty(len(by), np.int64)
        place[order] = np.arange(len(by)) - np.repeat(self.start, self.size) + 1
        return place

    def gains(self, place: np.ndarray, k: int) -> np.ndarray:
        """The DCG cut at k of each group."""
        return np.bincount(self.group, np.where(place <= k, (np.exp2(self.y) - 1) / np.log2(place + 1.0), 0.0), len(self.size))


def _read(batches: Iterator[pa.RecordBatch], steps: list[tuple[_Growing, np.ndarray]], width: int) -> Iterator[_Block]:
    """Blocks, with the trees' steps added to their scores."""
    for batch in batches:
        for i in range(batch.num_rows):
            size, id_, y, s = (np.array(batch.column(c)[i].values) for c in ("size", "id", "y", "s"))
            bins = np.frombuffer(batch.column("bins")[i].as_py(), np.uint8).reshape(len(y), width)
            for grown, step in steps:
                s = s + step[-1 - grown.place(bins)]
            yield _Block(np.repeat(np.arange(len(size)), size), np.cumsum(size) - size, size.astype(np.int64), id_, y, s, bins)


def _block_gradients(blocks: DataFrame, steps: list, width: int) -> DataFrame:
    """What _gradients gives, of blocks: a row's own and its leading side are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _read(batches, steps, width):
            n, place = len(b.y), b.placed(b.s)
            ideal = b.gains(b.placed(b.y.astype(np.float64)), TOP)
            leads = np.minimum(b.size, TOP)
            at = np.empty(n, np.int64)  # the row at each group's place
            at[b.start[b.group] + place - 1] = np.arange(n)
            many = leads[b.group]
            me = np.repeat(np.arange(n), many)
            p = np.arange(len(me)) - np.repeat(np.cumsum(many) - many, many) + 1
            lead, own = at[b.start[b.group[me]] + p - 1], np.minimum(place, TOP + 1)
            use = (b.y[lead] != b.y[me]) & (p < own[me])  # a pair is met once
            me, lead, p = me[use], lead[use], p[use]
            discount = lambda place: np.where(place > TOP, 0.0, 1 / np.log2(place + 1.0))
            moves = np.abs(np.exp2(b.y[lead]) - np.exp2(b.y[me])) * np.abs(discount(p) - discount(own[me])) / ideal[b.group[me]]
            sign = np.where(b.y[me] > b.y[lead], 1.0, -1.0)
            gap = np.clip(sign * (b.s[me] - b.s[lead]), -50, 50)
            rho = 1 / (1 + np.exp(gap))
            push, curve = -sign * rho * moves, rho * (1 - rho) * moves
            total = lambda x: _sums(me, x, n)
            yield pa.RecordBatch.from_pydict({
                "leading": np.zeros(n, bool), "bins": [r.tobytes() for r in b.bins], "grad": total(push) - _sums(lead, push, n), "curve": total(curve) + _sums(lead, curve, n),
                "loss": total(np.log1p(np.exp(-gap))), "pairs": total(np.ones(len(me))).astype(np.int64),
            })

    return blocks.mapInArrow(run, "leading boolean, bins binary, grad double, curve double, loss double, pairs long")


def _block_ndcg(blocks: DataFrame, steps: list, width: int, k: int) -> tuple[float, int]:
    """(sum, number) of nDCG at k over the blocks' groups that hold a positive and more than k rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, groups = 0.0, 0
        for b in _read(batches, steps, width):
            has = (np.bincount(b.group, b.y, len(b.size)) > 0) & (b.size > k)
            v = b.gains(b.placed(b.s), k)[has] / b.gains(b.placed(b.y.astype(np.float64)), k)[has]
            total, groups = total + float(v.sum()), groups + int(has.sum())
        yield pa.RecordBatch.from_pydict({"v": [total], "n": pa.array([groups], pa.int64())})

    found = blocks.mapInArrow(run, "v double, n long").agg(F.sum("v"), F.sum("n")).first()
    return found[0] or 0.0, found[1] or 0


def _block_advanced(blocks: DataFrame, steps: list, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _read(batches, steps, width):
            lists = [pa.array([x], pa.list_(t)) for x, t in ((b.size.astype(np.int32), pa.int32()), (b.id, pa.int64()), (b.y, pa.int32()), (b.s, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([b.bins.tobytes()])], ["size", "id", "y", "s", "bins"])

    return blocks.mapInArrow(run, _BLOCKS)


def _bins(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


class _Growing:
    """A tree over bins while it grows: inner nodes are numbered as they are split."""

    def __init__(self) -> None:
        self.feature: list[int] = []
        self.bin: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.open: dict[int, tuple[int, int]] = {}  # open node -> (parent, side)
        self.leaves = 1

    def place(self, b: np.ndarray) -> np.ndarray:
        """The leaf (as -1 - leaf) of each row."""
        at = np.zeros(len(b), np.int64) if self.feature else np.full(len(b), -1)
        left, right = np.array(self.left + [0]), np.array(self.right + [0])
        feature, cut = np.array(self.feature + [0]), np.array(self.bin + [0])
        while (inner := np.flatnonzero(at >= 0)).size:
            n = at[inner]
            at[inner] = np.where(b[inner, feature[n]] <= cut[n], left[n], right[n])
        return at

    def split(self, leaf: int, feature: int, bin_: int, parent: tuple[int, int] | None) -> tuple[int, int]:
        """Makes an inner node of a leaf; returns the leaves below it: the left one keeps the number."""
        node, new = len(self.feature), self.leaves
        self.leaves += 1
        self.feature.append(feature), self.bin.append(bin_), self.left.append(-1 - leaf), self.right.append(-1 - new)
        if parent:
            (self.left if parent[1] == 0 else self.right)[parent[0]] = node
        return leaf, new


def _histograms(rows: DataFrame, tree: _Growing, width: int) -> dict[tuple[int, int], np.ndarray]:
    """(leaf, feature) -> sums by bin of gradient, curvature and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((tree.leaves * width * BINS, 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            b = _bins(batch.column("bins"), width)
            leaf = -1 - tree.place(b)
            cell = ((leaf[:, None] * width + np.arange(width)) * BINS + b).ravel()
            for j, x in enumerate((batch.column("grad"), batch.column("curve"), None)):
                w = (~batch.column("leading").to_numpy(zero_copy_only=False)).astype(np.float64) if x is None else x.to_numpy()
                held[:, j] += np.bincount(cell, np.repeat(w, width), minlength=len(held))
        has = np.flatnonzero(held.any(1))
        yield pa.RecordBatch.from_pydict({"cell": has, "grad": held[has, 0], "curve": held[has, 1], "n": held[has, 2]})

    sums = rows.select("leading", "bins", "grad", "curve").mapInArrow(run, "cell long, grad double, curve double, n double").groupBy("cell").agg(F.sum("grad"), F.sum("curve"), F.sum("n"))
    out: dict[tuple[int, int], np.ndarray] = {}
    for cell, *x in sums.collect():  # leaves x features x bins at most
        out.setdefault((cell // BINS // width, cell // BINS % width), np.zeros((BINS, 3)))[cell % BINS] = x
    return out


def _grow(rows: DataFrame, width: int, depth: int, least_rows: int, penalty: float) -> tuple[_Growing, np.ndarray]:
    """(tree, step of each leaf): level by level, each open leaf at its best split."""
    tree = _Growing()
    open_: dict[int, tuple[int, int] | None] = {0: None}
    totals: dict[int, np.ndarray] = {}
    worth = lambda x: x[..., 0] ** 2 / (x[..., 1] + penalty)
    for level in range(depth + 1):
        found = _histograms(rows, tree, width)
        totals = {leaf: found[leaf, 0].sum(0) for leaf in range(tree.leaves) if (leaf, 0) in found}
        if level == depth or not open_:
            break
        nxt: dict[int, tuple[int, int] | None] = {}
        for leaf, parent in open_.items():
            best, gain = None, 1e-9
            for f in range(width):
                h = found.get((leaf, f))
                if h is None:
                    continue
                low = np.cumsum(h, 0)[:-1]
                high = h.sum(0) - low
                fine = (low[:, 2] >= least_rows) & (high[:, 2] >= least_rows)
                g = np.where(fine, worth(low) + worth(high) - worth(h.sum(0)), -1.0)
                if g.max() > gain:
                    best, gain = (f, int(g.argmax())), float(g.max())
            if best:
                node = len(tree.feature)
                a, b = tree.split(leaf, *best, parent)
                nxt |= {a: (node, 0), b: (node, 1)}
        if not nxt:
            break
        open_ = nxt
    return tree, np.array([-totals[i][0] / (totals[i][1] + penalty) if i in totals else 0.0 for i in range(tree.leaves)])


def _as_tree(grown: _Growing, step: np.ndarray, binner: _Binner) -> trees.Tree:
    kind, threshold, sets = [], [], []
    for f, b in zip(grown.feature, grown.bin):
        if f < len(binner.numeric):
            edges = binner.edges[f]
            kind.append(trees.NAN_IS_MISSING | trees.LEFT_IF_MISSING)
            # Bin 0 alone goes left below every number; the last bin's edge is above every number.
            threshold.append(-np.inf if b == 0 else float(edges[b - 1]) if b - 1 < len(edges) else np.inf)
        else:
            kind.append(trees.CATEGORICAL | trees.NAN_IS_MISSING)
            threshold.append(len(sets))
            sets.append(frozenset(range(b)))
    return trees.Tree(np.array(grown.feature, np.int64), np.array(threshold, np.float64), np.array(kind, np.int64), np.array(grown.left, np.int64), np.array(grown.right, np.int64), step, sets)


def _advanced(rows: DataFrame, grown: _Growing, step: np.ndarray, width: int) -> DataFrame:
    """rows with the tree's steps added to their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column("s").to_numpy() + (step[-1 - grown.place(_bins(batch.column("bins"), width))] if batch.num_rows else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("g", "id", "y")), pa.array(s), batch.column("bins")], ["g", "id", "y", "s", "bins"])

    return rows.select("g", "id", "y", "s", "bins").mapInArrow(run, _ROWS)


def fit(
    train: DataFrame, valid: DataFrame, group: Sequence[str], label: str, numeric: Sequence[str], categorical: Sequence[str] = (), key: Sequence[str] = (),
    rounds: int = 100, rate: float = 0.1, depth: int = 4, least_rows: int = 30, stop: int = 10, k: int = 10, penalty: float = 1.0,
) -> Fitted:
    """A ranker of the rows of each group by relevance (`label`, 0 or more; missing: 0).

    Boosting ends when nDCG at k of the validation rows has not risen for `stop` rounds, and keeps the trees up to its best round.
    `key` tells rows apart where scores tie.
    """
    binner = _binner(train, label, numeric, categorical)
    width = len(numeric) + len(categorical)
    table, valid_table = binner.table(train, group, label, key), binner.table(valid, group, label, key)
    (blocks, rows), (held_blocks, held_out) = _split(table), _split(valid_table)
    release(table, valid_table)
    ideal = None if rows is None else _ideal(rows)
    order = [F.desc("s"), F.col("id")]
    cols = ["leading", "bins", "grad", "curve", "loss", "pairs"]
    built: list[trees.Tree] = []
    steps: list[tuple[_Growing, np.ndarray]] = []  # since the blocks were written
    history: list[dict] = []
    best, best_at = -1.0, 0
    for n in range(rounds):
        passed = of_blocks = park(_block_gradients(blocks, steps, width), "block-gradients")
        if rows is not None:
            of_rows = _gradients(rows, ideal)
            release(rows)
            passed = of_blocks.unionByName(of_rows.select(*cols))
        grown, step = _grow(passed, width, depth, least_rows, penalty)
        step = rate * step
        built.append(_as_tree(grown, step, binner))
        steps.append((grown, step))
        told = passed.agg((F.sum("loss") / F.nullif(F.sum("pairs"), F.lit(0))).alias("loss")).first()
        release(of_blocks)
        total, groups = _block_ndcg(held_blocks, steps, width, k)
        if rows is not None:
            rows = park(_advanced(of_rows.where(~F.col("leading")), grown, step, width), "scored")
            release(of_rows)
        if held_out is not None:
            after = park(_advanced(held_out, grown, step, width), "validated")
            release(held_out)
            held_out = after
            mean, more = ndcg_at(held_out, ["g"], "y", order, k, F.pow(F.lit(2.0), "y") - 1).first()
            total, groups = total + mean * more, groups + more
        if len(steps) == FRESH:
            fresh = [park(_block_advanced(b, steps, width), "blocks") for b in (blocks, held_blocks)]
            release(blocks, held_blocks)
            (blocks, held_blocks), steps = fresh, []
        value = total / groups if groups else 0.0
        history.append({"loss": told.loss, "valid": value})
        if value > best + 1e-12:
            best, best_at = value, n + 1
        elif n + 1 - best_at >= stop:
            break
    release(*[x for x in (rows, held_out, ideal, blocks, held_blocks) if x is not None])
    return Fitted(trees.Forest([*numeric, *categorical], built[:best_at], binner.codes), history, best_at)
