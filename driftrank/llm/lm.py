"""LM scoring with a weighted backoff automaton.

The model is an n-gram model (ORDER words) over words and one end token a text, of every n-gram that training texts hold,
those that occur once included. States are the n-grams of up to ORDER - 1 tokens. An arc leads from state h by token w where
hw occurs; where it does not, the failure arc leads to the next shorter state. With c counts, q the probability in the
shorter state and m its weight MASS, an arc weighs log10((c(hw) + m q) / (c(h) + m)) and a failure arc log10(m / (c(h) + m)):
Dirichlet smoothing, which needs no other sum over a state's arcs, so for every state the probabilities sum to 1. In the
root a token weighs log10((c - D) / N), an unknown one log10(D V / N), with D = n1 / (n1 + 2 n2) from the counts of counts.
A text is read once, from left to right; the state carried along is the longest one that the last tokens name.

A state is at most ORDER - 1 tokens, so a walk that begins that many tokens early, in the root, is in the right state when it is
its turn: a block is cut into lanes of LANE tokens, and all lanes are walked side by side, a token of each at a time.

Texts are read once and kept as blocks of BLOCK tokens (or one longer text): the block's distinct tokens and the place of
each of its tokens among them. A block asks for the counts of its own n-grams (tally.py), counts of training texts are
added up over all blocks, and the answers are the part of the automaton that the block's texts can reach. So what is
gathered grows with the corpus, nothing is broadcast, no n-gram is left out and a task holds one block at a time.

Defined results: null and empty texts are the end token alone; words and n-grams are known by 64-bit hashes; repeated rows
are scored each time; an empty table gives an empty result; without training text every token is unknown and scores 0 in the
model; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftrank.llm import tally
from driftrank.llm.textkit import slices, splitmix, utf8, words
from driftrank.tables import park

U = np.uint64
ORDER = 3
#: Weight of the shorter state's probability, by the length of the longer state.
MASS = (0.0, 1000.0, 4.0, 2.0)
BLOCK = 1 << 19
LANE = 256
END = U(0x1F3D5B79A2C4E608)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 7 == 2


def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts in order, each text closed by END; n + 1 offsets)."""
    w = words(*utf8(part.column("text")), lower=True)
    n = part.num_rows
    off = w.first + np.arange(n + 1)
    out = np.empty(off[-1], U)
    last = np.zeros(off[-1], bool)
    last[off[1:] - 1] = True
    out[last], out[~last] = END, w.hash
    return out, off


_BLOCK = "block long, ids array<long>, held array<boolean>, sizes binary, distinct int, length int, vocabulary binary, sequence binary, trained long"


def blocks(docs: DataFrame, limit: int = BLOCK) -> DataFrame:
    """Texts as blocks: ids, which are held out, sizes in tokens (uint32), the distinct tokens and each token's place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def give() -> pa.RecordBatch:
            t = np.concatenate([x[0] for x in held])
            sizes = np.concatenate([np.diff(x[1]) for x in held])
            out = [y for x in held for y in x[3]]
            vocabulary, place, times = np.unique(t, return_inverse=True, return_counts=True)
            rank = np.empty(len(times), np.uint32)
            rank[np.argsort(-times, kind="stable")] = np.arange(len(times), dtype=np.uint32)  # frequent tokens get small numbers, which compress well
            named = np.empty_like(vocabulary)
            named[rank] = vocabulary
            row = (number, [y for x in held for y in x[2]], out, tally.squeeze(sizes.astype(np.uint32)), len(vocabulary), len(t), named.tobytes(), tally.squeeze(rank[place]), int(sizes[~np.array(out, bool)].sum()))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()])], [x.split()[0] for x in _BLOCK.split(", ")])

        for batch in batches:
            for part in slices(batch):
                t, off = tokens(part)
                held.append((t, off, part.column("doc_id").to_pylist(), part.column("held").to_pylist()))
                size += len(t)
                if size >= limit:
                    yield give()
                    number, held, size = number + 1, [], 0
        if held:
            yield give()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    return rows.mapInArrow(run, _BLOCK)


@dataclass
class Block:
    """A block's tokens; of n-grams of each length the places they end at and their hashes."""

    token: np.ndarray
    sizes: np.ndarray
    train: np.ndarray  # by token

    @classmethod
    def of(cls, row: dict) -> Block:
        sizes = tally.unsqueeze(row["sizes"], len(row["ids"]), np.uint32).astype(np.int64)
        token = np.frombuffer(row["vocabulary"], U)[tally.unsqueeze(row["sequence"], row["length"], np.uint32)]
        return cls(token, sizes, np.repeat(~np.array(row["held"], bool), sizes))

    def grams(self, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places of last tokens, hashes) of the n-grams of 1 to `order` tokens of one text."""
        n = len(self.token)
        before = np.arange(n) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)  # tokens before each in its text
        out = [(np.arange(n), self.token)]
        hashed = self.token
        for k in range(1, order):
            at = np.flatnonzero(before >= k)
            longer = np.zeros(n, U)
            longer[at] = splitmix(splitmix(hashed[at - 1] + U(k)) + self.token[at])
            hashed = longer
            out.append((at, hashed[at]))
        return out


def requests(parked: DataFrame, k: int, buckets: int) -> DataFrame:
    """Requests for the n-grams of k tokens; k is their kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in tally.each(batches):
            block = Block.of(row)
            at, keys = block.grams(k)[-1]
            yield tally.requests(row["block"], k, *tally.counted(keys, block.train[at]), buckets)

    return parked.mapInArrow(run, tally.REQUEST)


@dataclass
class Automaton:
    """The root's arcs, and how a state's arcs follow from counts."""

    n: int
    v: int
    n1: int
    n2: int
    mass: tuple[float, ...] = MASS

    @property
    def discount(self) -> float:
        return self.n1 / (self.n1 + 2 * self.n2) if self.n1 and self.n2 else 0.5

    def root(self, c: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones(len(c))
        return np.where(c > 0, c - self.discount, self.discount * self.v) / self.n

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10(c + 1.0) - math.log10(self.n + self.v + 1)

    def step(self, shorter: np.ndarray, state: np.ndarray, arc: np.ndarray, length: int) -> np.ndarray:
        """Probability in a state of `length` tokens and count `state`: of its arc of count `arc`, or along its failure arc (arc 0)."""
        m = self.mass[min(length, len(self.mass) - 1)]
        return (arc + m * shorter) / (state + m)

    def reach(self, block: Block, totals: list[np.ndarray]) -> Reach:
        """The states and arcs that the block's texts can reach, from the totals of its distinct n-grams, by their length."""
        order, n = len(totals), len(block.token)
        v, state, place = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, weights, targets, back, cost = [], [], [], [np.zeros(1, np.int64)], [np.zeros(1)]
        p = total = np.zeros(0)
        root_weight = root_target = token = np.zeros(0)
        states = 1  # the root is 0
        for k, ((at, keys), here) in enumerate(zip(block.grams(order), totals), 1):
            _, first, number = np.unique(keys, return_index=True, return_inverse=True)
            live, ends = here > 0, at[first]
            own = np.zeros(len(here), np.int64)  # the state that an n-gram names, else the root
            if k < order:
                own[live] = states + np.arange(live.sum())
            gram = np.full(n, -1, np.int64)
            gram[at] = number
            if k == 1:
                v, token, p = len(here), gram, self.root(here)
                root_weight, root_target, suffix = np.log10(p), own, own * 0
            else:
                shorter, source = place[ends], place[ends - 1]
                suffix = state[shorter]
                q = self.step(p[shorter], total[source], here, k - 1)
                codes.append((state[source] * v + token[ends])[live])
                weights.append(np.log10(q[live]))
                targets.append((own if k < order else suffix)[live])
                p = q
            if k < order:
                m = self.mass[min(k, len(self.mass) - 1)]
                back.append(suffix[live])
                cost.append(np.log10(m / (here[live] + m)))
                states += int(live.sum())
            state, place, total = own, gram, here
        code = np.concatenate([*codes, [np.iinfo(np.int64).max]]).astype(np.int64)
        at = np.argsort(code)
        return Reach(token, v, root_weight, root_target, code[at], np.concatenate([*weights, [0.0]])[at], np.concatenate([*targets, [0]]).astype(np.int64)[at], np.concatenate(back), np.concatenate(cost))

    def walk(self, block: Block, totals: list[np.ndarray], lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability of each token, its count)."""
        reach, n = self.reach(block, totals), len(block.token)
        opens = np.zeros(n, bool)
        opens[np.cumsum(block.sizes) - block.sizes] = True
        start = np.arange(0, n, lane)
        state, p = np.zeros(len(start), np.int64), np.empty(n)
        for t in range(1 - len(totals), min(lane, n)):
            lanes = np.flatnonzero((start + t >= 0) & (start + t < n))
            at = start[lanes] + t
            gained, state[lanes] = reach.read(np.where(opens[at], 0, state[lanes]), reach.token[at])
            if t >= 0:
                p[at] = gained
        return p, totals[0][reach.token]


@dataclass
class Reach:
    """A part of the automaton: arcs of the root by token, arcs of other states by state * v + token, failure arcs by state."""

    token: np.ndarray  # number of each place's token
    v: int
    root_weight: np.ndarray
    root_target: np.ndarray
    code: np.ndarray  # ascending, closed by one that no arc has
    weight: np.ndarray
    target: np.ndarray
    back: np.ndarray
    cost: np.ndarray

    def read(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, next state) of one token from each state: along failure arcs until an arc bears the token."""
        state, gained = state.copy(), np.zeros(len(state))
        rest, falls = np.flatnonzero(state > 0), state == 0
        while len(rest):
            code = state[rest] * self.v + token[rest]
            j = np.searchsorted(self.code, code)
            hit = self.code[j] == code
            took, lost = rest[hit], rest[~hit]
            gained[took] += self.weight[j[hit]]
            state[took] = self.target[j[hit]]
            gained[lost] += self.cost[state[lost]]
            state[lost] = self.back[state[lost]]
            falls[lost[state[lost] == 0]] = True
            rest = lost[state[lost] > 0]
        gained[falls] += self.root_weight[token[falls]]
        state[falls] = self.root_target[token[falls]]
        return gained, state


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def score(docs: DataFrame, order: int = ORDER, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, score_per_token of each row."""
    spark = docs.sparkSession
    parked = park(blocks(docs, block), "lm-blocks")
    n, length, n_blocks = parked.agg(F.sum("trained"), F.sum("length"), F.count("*")).first()
    parts, buckets, groups = tally.shape(length or 0, n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # One length after the other, so that the requests of one are on disk at a time.
    answered = [tally.answers(requests(parked, k, buckets), parts, f"lm-counts-{k}", groups) for k in range(1, order + 1)]
    seen = answered[0].agg(*[F.sum(c) for c in ("seen", "once", "twice")]).first()
    model = Automaton(n or 0, *[x or 0 for x in seen])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in tally.each(batches):
            own = Block.of(row)
            p, count = model.walk(own, [tally.totals(row["got"], k) for k in range(1, order + 1)])
            first = np.cumsum(own.sizes) - own.sizes
            add = lambda x: pa.array(np.add.reduceat(x, first))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(own.sizes), add((count > 0).astype(np.int64)), add(model.base(count)), add(p)],
                [x.split()[0] for x in _SCORED.split(", ")],
            )

    scored = parked.join(tally.by_block(reduce(DataFrame.unionAll, answered)), "block").mapInArrow(run, _SCORED)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
        (F.col("score") / F.col("n_tokens")).alias("score_per_token"),
    )
