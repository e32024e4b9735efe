"""Corpus-wide counts of 64-bit keys for blocks of rows, by request and answer.

A block (the rows that one task reads up to a bound) asks for its distinct keys, with its own counts of them; keys go to
buckets by range, and a bucket adds up what all blocks counted and answers each block with the totals of the keys it asked
for, in their order. A key leaves a block once however often it occurs there; a request row holds the ascending keys of one
block and bucket as differences, a byte plane each, compressed.

A common key is asked for by every block. So beyond FAN blocks the requests go up a tree: blocks are dealt into groups of about
FAN, a node adds up what one group asks of one bucket, nodes ask as blocks do (in further levels where they are more than FAN
themselves), and the totals come down to the nodes and from there to the blocks, one request row at a time. Buckets are as many
as keep a node near BUCKET_KEYS keys, so neither a task's rows nor its memory grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftrank.llm.textkit import slices
from driftrank.tables import park, release

BUCKET_KEYS = 1 << 20
FAN = 1 << 14
U = np.uint64
REQUEST = "block long, kind int, bucket int, keys binary, counts binary, size int"
_REQUEST = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
_REQUESTED = ("block", "kind", "bucket", "keys", "counts", "size")
_ANSWER = "block long, kind int, bucket int, totals binary, size int, seen long, once long, twice long"


def squeeze(x: np.ndarray) -> bytes:
    """The byte planes of x, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)
    return pa.compress(np.ascontiguousarray(planes.T).tobytes(), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, size: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, size * width, codec="zstd", asbytes=True), np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def counted(keys: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, ascending; how many of each are flagged)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys)
    s = keys[order]
    new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[new], np.add.reduceat(flags[order].astype(np.int64), new)


def requests(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, buckets: int, width: type = np.uint32) -> pa.RecordBatch:
    """Request rows of a block's distinct ascending keys, in buckets of equal ranges; counts are held in `width`."""
    bucket = (keys >> U(32)) * U(buckets) >> U(32)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
    rows = []
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(keys)]):
        rows.append((block, kind, int(bucket[i]), squeeze(np.diff(keys[i:j], prepend=U(0))), squeeze(counts[i:j].astype(width)), j - i))
    cols = list(zip(*rows)) or [()] * len(_REQUEST)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _REQUEST)], list(_REQUESTED))


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def shape(keys: int, blocks: int, shuffle_partitions: int) -> tuple[int, int, int]:
    """(partitions, buckets, groups of blocks) for so many keys requested by so many blocks."""
    groups = max(1, -(-blocks // FAN))
    parts = max(shuffle_partitions, -(-keys // (2 * BUCKET_KEYS)))
    return parts, 2 * max(shuffle_partitions, -(-keys // (2 * BUCKET_KEYS * groups))), groups


def added(rows: list[tuple], width: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, ascending; their counts over all request rows; the place among them of each row's keys in turn)."""
    _, _, _, keys, counts, size = zip(*rows)
    all_keys = np.concatenate([np.cumsum(unsqueeze(k, n, U), dtype=U) for k, n in zip(keys, size)])
    own = np.concatenate([unsqueeze(c, n, width) for c, n in zip(counts, size)])
    order = np.argsort(all_keys, kind="stable")  # sorted runs: a merge
    s = all_keys[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    back = np.empty(len(s), np.int64)
    back[order] = np.cumsum(new) - 1
    return s[new], np.add.reduceat(own[order].astype(U), np.flatnonzero(new)), back


def together(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(values of `by`, request rows) of each run of rows that agree in them."""
    key, held = None, []
    for batch in batches:
        marks = zip(*[batch.column(c).to_pylist() for c in by])
        for mark, row in zip(marks, zip(*[batch.column(c).to_pylist() for c in _REQUESTED])):
            if held and mark != key:
                yield key, held
                held = []
            key = mark
            held.append(row)
    if held:
        yield key, held


def _told(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _ANSWER.split(", ")])


def answers(asked: DataFrame, parts: int, label: str, groups: int = 1, width: type = np.uint32) -> DataFrame:
    """block, kind, bucket, totals (binary, of `size` uint64) for each request row; seen, once, twice count a bucket's keys with a
    total above 0, of 1, of 2, on one row of the bucket. Parked; the requests' shuffle files go.
    """
    if groups > 1:
        return _by_nodes(asked, parts, label, groups, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in together(batches, ("kind", "bucket")):
            _, total, back = added(rows, width)
            edge = np.cumsum([0, *[r[5] for r in rows]]).tolist()
            sums = [(int(np.count_nonzero(total)), int((total == 1).sum()), int((total == 2).sum()))] + [(0, 0, 0)] * (len(rows) - 1)
            yield _told([(*r[:3], squeeze(total[back[a:b]]), r[5], *t) for r, a, b, t in zip(rows, edge, edge[1:], sums)])

    dealt = asked.repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket", "block")
    return park(dealt.mapInArrow(run, _ANSWER), label, clean=True)


def _by_nodes(asked: DataFrame, parts: int, label: str, groups: int, width: type) -> DataFrame:
    """answers(), through nodes that each hold what one group of blocks asks of one bucket."""
    whole = lambda c, bits: F.shiftleft(F.col(c).cast("long"), bits)
    node = whole("kind", 56).bitwiseOR(whole("bucket", 28)).bitwiseOR(F.pmod(F.xxhash64("block"), F.lit(groups)))
    waiting = park(asked.withColumn("node", node), f"{label}-asked")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (at, kind), rows in together(batches, ("node", "kind")):
            keys, total, _ = added(rows, width)
            cells = (at, kind, squeeze(np.diff(keys, prepend=U(0))), squeeze(total), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32()])], ["node", "kind", "keys", "counts", "size"])

    nodes = park(waiting.repartition(parts, "node").sortWithinPartitions("node", "block").mapInArrow(up, "node long, kind int, keys binary, counts binary, size int"), f"{label}-nodes", clean=True)
    above = -(-groups // FAN)
    buckets = -(-2 * parts // above)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            yield requests(row["node"], row["kind"], np.cumsum(unsqueeze(row["keys"], row["size"], U), dtype=U), unsqueeze(row["counts"], row["size"], U), buckets, U)

    top = answers(nodes.mapInArrow(ask, REQUEST), parts, f"{label}-up", above, U)
    known = top.groupBy(F.col("block").alias("node")).agg(F.collect_list(F.struct("kind", "bucket", "totals", "size")).alias("got"), *[F.sum(c).alias(c) for c in ("seen", "once", "twice")])
    known = nodes.drop("counts").join(known, "node").withColumn("asks", F.lit(False))
    rows = waiting.drop("counts").withColumn("asks", F.lit(True)).unionByName(known, allowMissingColumns=True)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = total = np.zeros(0, U)
        sums, out = (0, 0, 0), []
        for row in each(batches):
            own = np.cumsum(unsqueeze(row["keys"], row["size"], U), dtype=U)
            if row["asks"]:
                out.append((row["block"], row["kind"], row["bucket"], squeeze(total[np.searchsorted(keys, own)]), row["size"], *sums))
                sums = (0, 0, 0)
                if len(out) == 256:
                    yield _told(out)
                    out = []
            else:
                keys, total, sums = own, totals(row["got"], row["kind"]), (row["seen"], row["once"], row["twice"])
        if out:
            yield _told(out)

    done = park(rows.repartition(parts, "node").sortWithinPartitions("node", "asks", "block").mapInArrow(down, _ANSWER), label, clean=True)
    release(waiting, nodes, top)
    return done


def by_block(answered: DataFrame) -> DataFrame:
    """block, got: a block's answers together, as many bytes as its keys ask for."""
    return answered.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "totals", "size")).alias("got"))


def totals(got: list[dict], kind: int) -> np.ndarray:
    """The totals of a block's keys of one kind, in the order of its keys."""
    parts = sorted((g["bucket"], g["totals"], g["size"]) for g in got if g["kind"] == kind)
    return np.concatenate([unsqueeze(t, n, U) for _, t, n in parts]) if parts else np.zeros(0, U)


_KEYED = "block long, ids array<long>, tags array<int>, per binary, keys binary, size int, more array<binary>, lengths array<int>"
KEYED_BLOCK = 1 << 18

Make = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, list[np.ndarray]]]
Weigh = Callable[[np.ndarray, np.ndarray, list[np.ndarray]], np.ndarray]
Use = Callable[[list, list, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]], pa.RecordBatch]


def looked_up(docs: DataFrame, make: Make, use: Use, out: str, label: str, weigh: Weigh | None = None) -> DataFrame:
    """What use(ids, tags, keys of each row, keys, how often each occurs in all rows, more) makes of each block of docs (doc_id, tag,
    text, others that make reads), of which make(rows) has given (keys of each row, keys in order, more uint32 arrays). Parked.
    weigh(keys of each row, keys, more): what each key counts for, where that isn't one.
    """
    spark = docs.sparkSession

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def give() -> pa.RecordBatch:
            per, keys = (np.concatenate(x) for x in zip(*[y[2][:2] for y in held]))
            more = [np.concatenate(x).astype(np.uint32) for x in zip(*[y[2][2] for y in held])]
            row = (number, [i for y in held for i in y[0]], [i for y in held for i in y[1]], squeeze(per.astype(np.uint32)), keys.tobytes(), len(keys), [squeeze(x) for x in more], [len(x) for x in more])
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [x.split()[0] for x in _KEYED.split(", ")])

        for batch in batches:
            for part in slices(batch):
                held.append((part.column("doc_id").to_pylist(), part.column("tag").to_pylist(), make(part)))
                size += part.num_rows + len(held[-1][2][1])
                if size >= KEYED_BLOCK:
                    yield give()
                    number, held, size = number + 1, [], 0
        if held:
            yield give()

    def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        per = unsqueeze(row["per"], len(row["ids"]), np.uint32).astype(np.int64)
        return per, np.frombuffer(row["keys"], U), [unsqueeze(m, n, np.uint32).astype(np.int64) for m, n in zip(row["more"], row["lengths"])]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            keys = np.frombuffer(row["keys"], U)
            counts = weigh(*unpacked(row)) if weigh else np.ones(len(keys), bool)
            yield requests(row["block"], 0, *counted(keys, counts), buckets)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            per, keys, more = unpacked(row)
            total = totals(row["got"] or [], 0)[np.unique(keys, return_inverse=True)[1]]
            yield use(row["ids"], row["tags"], per, keys, total, more)

    made = park(docs.mapInArrow(blocks, _KEYED), f"{label}-blocks", clean=True)
    n, n_blocks = made.agg(F.sum("size"), F.count("*")).first()
    parts, buckets, groups = shape(n or 0, n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    answered = answers(made.mapInArrow(ask, REQUEST), parts, f"{label}-counts", groups)
    done = park(made.join(by_block(answered), "block", "left").mapInArrow(answer, out), label, clean=True)  # a block without a key has no answer
    release(made, answered)
    return done
