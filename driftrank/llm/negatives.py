"""Hard negatives of anchors by full score sorts.

Anchors, a stated set, are scored against all rows in blocks: a block of anchors meets every block of rows once, each
block of rows being one unit of work. A block sorts all its scores for each anchor, highest first and equal ones by id;
a positive's upper limit is found in that order by binary search, and the k different-label entries from there on that
do not fall below the lower limit are read off. An anchor's order over all rows is the merge of its blocks' orders, so the
first k of all are among the firsts of the blocks; windows with a limit merge those, whatever their number, without
gathering an anchor's entries in one place.

Two passes share the blocks: the first reads the leading rows of each anchor's own label (its positives), the second
reads the negatives under the positives' limits. Scores are exact integers.

Defined results: rows with a null label, a null vector, or a component that is null, not finite or beyond 2^27 as a whole
number take no part; of two vectors the shorter one is filled up with zeros; anchors equal in id are anchors each, and a
row is not its own positive while an equal row is; a null id is no anchor, comes last among ties and is returned as null;
anchors without positives, and positives without negatives in their limits, give no rows; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftrank.llm import vectors
from driftrank.tables import park

ANCHORS, ROWS, MOST_TASKS = 256, 8192, 100_000
_BLOCK = "unit int, block long, ids binary, labels binary, v binary"
_WANTED = "array<struct<place: long, positives: array<struct<score: long, id: long>>>>"
_SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _blocks(df: DataFrame, rows: int, label: str) -> tuple[DataFrame, int]:
    """(blocks of about `rows` rows in ascending order of ids, number of units): a unit is what one partition made."""
    parts = max(1, -(-df.count() // rows))
    made = [0]

    def make(t: pa.Table) -> dict[str, list]:
        t = t.combine_chunks()
        key, v = vectors.ids(t.column("vec_id").chunk(0)), t.column("v").chunk(0)
        width = max(v.value_lengths().to_pylist())
        order = np.argsort(key, kind="stable")
        unit, made[0] = TaskContext.get().partitionId(), made[0] + 1
        labels = t.column("label").chunk(0).to_numpy().astype(np.int64)[order]
        return {"unit": pa.array([unit], pa.int32()), "block": [(unit << 24) + made[0]], "ids": [key[order].tobytes()], "labels": [labels.tobytes()], "v": [vectors.pack(vectors.matrix(v, width)[order])]}

    return park(vectors.in_blocks(df.repartition(parts), 2 * rows, make, _BLOCK), label), parts


class Block:
    def __init__(self, ids: bytes, labels: bytes, v: bytes) -> None:
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.v = vectors.unpack(v).reshape(len(self.ids), -1)


def sorted_scores(anchors: Block, rows: Block) -> tuple[np.ndarray, np.ndarray]:
    """(scores, order) of the rows for each anchor: order sorts by descending score, then by ascending id."""
    width = min(anchors.v.shape[1], rows.v.shape[1])
    s = vectors.inner(anchors.v[:, :width], rows.v[:, :width])
    return s, np.lexsort((np.broadcast_to(rows.ids, s.shape), -s), axis=-1)


def leading(anchors: Block, rows: Block, k: int) -> dict[str, np.ndarray]:
    """Of each anchor (by place) the first k rows of its own label."""
    s, order = sorted_scores(anchors, rows)
    out: list[list[np.ndarray]] = [[], [], []]
    for i, o in enumerate(order):
        o = o[rows.labels[o] == anchors.labels[i]][:k]
        for held, x in zip(out, (np.full(len(o), i), s[i, o], rows.ids[o])):
            held.append(x)
    return {n: np.concatenate(x).astype(np.int64) for n, x in zip(("place", "score", "id"), out)}


def within(anchors: Block, rows: Block, wanted: list[dict], k: int, low: int, high: int) -> dict[str, np.ndarray]:
    """For each wanted anchor's each positive the first k rows of other labels whose score is between low and high percent of the
    positive's."""
    s, order = sorted_scores(anchors, rows)
    out: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
    for w in wanted:
        i = w["place"]
        o = order[i]
        o = o[rows.labels[o] != anchors.labels[i]]
        falling = -s[i, o]
        for number, p in enumerate(w["positives"]):
            top, floor = high * p["score"] // 100, -(-low * p["score"] // 100)
            a, b = np.searchsorted(falling, -top, side="left"), np.searchsorted(falling, -floor, side="right")
            found = o[a : min(a + k, b)]
            for held, x in zip(out, (i, number, anchors.ids[i], p["score"], p["id"])):
                held.append(np.full(len(found), x, np.int64))
            out[5].append(s[i, found])
            out[6].append(rows.ids[found])
    names = ("place", "number", "anchor_id", "positive_score", "positive_id", "score", "id")
    return {n: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for n, x in zip(names, out)}


def _meet(anchors: DataFrame, rows: DataFrame, units: int, fields: str, work: Callable[[Block, Block, list], dict[str, np.ndarray]]) -> DataFrame:
    """work(anchors, rows, wanted) of every block of anchors and every block of rows.

    A unit's blocks of rows come first in its partition, then every block of anchors streams past them.
    """
    names = [f.split()[0] for f in fields.split(", ")]
    sent = anchors.withColumns({"unit": F.explode(F.sequence(F.lit(0), F.lit(units - 1))), "kind": F.lit(1)})
    held = rows.withColumns({"kind": F.lit(0), "wanted": F.lit(None).cast(_WANTED)})
    both = held.unionByName(sent).repartition(min(units, MOST_TASKS), "unit").sortWithinPartitions("unit", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, own = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["unit"] != unit:
                    unit, own = r["unit"], []
                block = Block(r["ids"], r["labels"], r["v"])
                if not r["kind"]:
                    own.append(block)
                    continue
                for rows_ in own:
                    found = work(block, rows_, r["wanted"])
                    if len(found["id"]):
                        yield pa.RecordBatch.from_pydict({"block": np.full(len(found["id"]), r["block"], np.int64)} | {n: found[n] for n in names[1:]})

    return both.mapInArrow(run, fields)


def _first(df: DataFrame, k: int, *by: str) -> DataFrame:
    """The first k rows of each group by descending score, then ascending id, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, factor: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Each of an anchor's first `positives` rows of its label gets the first `negatives` rows of other labels whose score is
    between low and high percent of the positive's. `is_anchor`: a condition over vec_id and label.
    """
    vector = F.col("embedding")
    taking = embeddings.where(F.col("label").isNotNull() & vectors.usable(vector, factor))
    taking = taking.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vectors.whole(vector, factor).alias("v"))
    rows, units = _blocks(taking, ROWS, "score-rows")
    anchors, _ = _blocks(taking.where(is_anchor), ANCHORS, "score-anchors")
    anchors = anchors.drop("unit")

    lead = _meet(anchors.withColumn("wanted", F.lit(None).cast(_WANTED)), rows, units, "block long, place long, score long, id long, own_id long, own long", lambda a, r, _: _with_own(a, leading(a, r, positives + 1)))
    lead = _first(lead, positives + 1, "block", "place").groupBy("block", "place", "own_id", "own").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("near"))
    itself = F.array_position(F.transform("near", lambda x: (x.id == F.col("own_id")) & (x.score == F.col("own"))), True)
    others = F.slice(F.filter("near", lambda x: x.rank != F.col("itself")), 1, positives)
    lead = lead.withColumn("itself", itself).select("block", "place", F.transform(others, lambda x: F.struct(x.score.alias("score"), x.id.alias("id"))).alias("positives"))
    wanted = lead.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "positives"))).alias("wanted"))  # a block's anchors at most

    found = _meet(anchors.join(wanted, "block"), rows, units, "block long, place long, number long, anchor_id long, positive_score long, positive_id long, score long, id long", lambda a, r, w: within(a, r, w, negatives, low, high))
    known = lambda c: F.when(F.col(c) != vectors.NO_ID, F.col(c))
    return _first(found, negatives, "block", "place", "number").select(
        "anchor_id", known("positive_id").alias("positive_id"), "rank", known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _with_own(anchors: Block, found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What was found, with each anchor's id and its score with itself."""
    at = found["place"]
    return found | {"own_id": anchors.ids[at], "own": (anchors.v**2).sum(1)[at]}
