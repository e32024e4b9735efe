"""Sharding by a k-d tree of weighted medians (DataFrame operations only).

Nodes split along the metadata dimension in which their rows spread most (share of distinct coarse cells that hold
bytes), at the weighted median of bytes, until leaves hold the target bytes: total / leaves. Coordinates are 62-bit
keys: 31 bits of the scaled value, then 31 bits of a row hash, so that a value shared by a third of the rows is still
split evenly. A median is found by four histogram rounds over all rows; a round moves one row for each node and bin.

Defined results: a null text counts 0 bytes; null metadata sorts first; repeated rows are separate rows, which a node spreads
over its shards like others; shards and slots depend on the order of the rows in the table; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftrank.tables import park, release

BINS = 4096
ROUNDS = 4
TOP = 1 << 62


def _key(scaled: Column) -> Column:
    """scaled in [0, 1] to the high half of the key, the row hash to the low half."""
    high = F.least(F.greatest(F.floor(scaled * F.lit(float((1 << 31) - 1))), F.lit(0)), F.lit((1 << 31) - 1))
    return F.shiftleft(high.cast("long"), 31) + F.col("tie")


def _category(c: Column) -> Column:
    return F.coalesce(F.crc32(c.cast("binary")), F.lit(0)) / F.lit(float((1 << 32) - 1))


def _scaled(x: Column, low: float | None, high: float | None) -> Column:
    return F.coalesce((x - F.lit(low)) / F.lit(max(high - low, 1e-9)), F.lit(0.0)) if low is not None else F.lit(0.0)


def meta(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, row hash and one key for each dimension: log size, source, language, id.

    Size and id are scaled to the range they are seen in. The row hash takes in the row's place in the table, so rows equal in
    everything are spread like others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64("doc_id", text, F.monotonically_increasing_id()), 33).alias("tie"),
        _category(F.col("source")).alias("s"),
        _category(F.col("lang")).alias("l"),
    )
    log, number = F.log2(F.col("size").cast("double")), F.col("doc_id").cast("double")
    ends = base.agg(F.min(log), F.max(log), F.min(number), F.max(number)).first()
    return base.select(
        "doc_id", "size", "text_crc32", "tie",
        _key(_scaled(log, ends[0], ends[1])).alias("d0"),
        _key(F.col("s")).alias("d1"),
        _key(F.col("l")).alias("d2"),
        _key(_scaled(number, ends[2], ends[3])).alias("d3"),
    )


DIMS = 4
#: Tables of open nodes (under 10 MB) are broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_NODES = 200_000
_BOX = "node int, dim int, lo long, step long, want long"


def _nodes(rows: DataFrame, named: list[tuple], schema: str) -> DataFrame:
    table = rows.sparkSession.createDataFrame(named, schema)
    return F.broadcast(table) if len(named) <= BROADCAST_NODES else table


def _along() -> Column:
    """A row's key along its node's dimension."""
    out = F.col("d0")
    for d in range(1, DIMS):
        out = F.when(F.col("dim") == d, F.col(f"d{d}")).otherwise(out)
    return out


def _split_round(rows: DataFrame, dim: dict[int, int], box: dict[int, tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """Narrow each node's (low, high, bytes wanted from low on) to the bin where its wanted weight is reached."""
    step = {n: max(1, -(-(hi - lo) // BINS)) for n, (lo, hi, _) in box.items()}
    boxes = _nodes(rows, [(n, dim[n], lo, step[n], want) for n, (lo, _, want) in box.items()], _BOX)
    part = rows.join(boxes, "node").select("node", "size", "want", "step", (_along() - F.col("lo")).alias("k")).where("k >= 0")
    # At most BINS rows for each node.
    hist = part.select("node", "size", "want", F.expr("k div step").alias("bin")).where(F.col("bin") < BINS).groupBy("node", "want", "bin").agg(F.sum("size").alias("b"))
    run = hist.selectExpr("node", "want", "bin", "b", "sum(b) over (partition by node order by bin) as upto")
    found = run.where("upto >= want").groupBy("node").agg(F.min_by(F.struct("bin", "b", "upto"), "bin").alias("x"))
    out = {}
    for r in found.collect():  # one row a node: at most the number of leaves
        lo, _, want = box[r.node]
        out[r.node] = (lo + r.x.bin * step[r.node], lo + (r.x.bin + 1) * step[r.node], want - (r.x.upto - r.x.b))
    return {n: out.get(n, b) for n, b in box.items()}


def _widest(rows: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """By node: the dimension whose bytes spread over most, and the bytes.

    Spread: the weighted standard deviation of the scaled coordinate, which needs sums alone.
    """
    cols = [F.sum("size").alias("b")]
    for d in range(DIMS):
        x = F.col(f"d{d}") / F.lit(float(TOP))
        w = F.col("size").cast("double")
        cols += [(F.sum(w * x * x) / F.sum(w) - F.pow(F.sum(w * x) / F.sum(w), 2)).alias(f"v{d}")]
    dim, weight = {}, {}
    for r in rows.groupBy("node").agg(*cols).collect():  # one row a node
        spread = [round(r[f"v{d}"], 9) for d in range(DIMS)]
        dim[r.node], weight[r.node] = max(range(DIMS), key=lambda d: (spread[d], -d)), r.b
    return dim, weight


def kd_tree(docs: DataFrame, leaves: int = 24, subs: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs, in `leaves` shards or in as many as target_bytes asks for.

    The open nodes of a level are a table that rows are joined with, a row for each node, so plans stay small.
    """
    rows = park(meta(docs).withColumn("node", F.lit(0)), "shard-meta")
    if target_bytes:
        leaves = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    width = {0: leaves}  # leaves below each open node; a node's number is that of its first leaf
    while any(n > 1 for n in width.values()):
        dim, weight = _widest(rows)
        width = {n: w for n, w in width.items() if n in weight}
        open_ = {n: w for n, w in width.items() if w > 1}
        if not open_:
            break
        box = {n: (0, TOP, weight[n] * (w // 2) // w) for n, w in open_.items()}
        for _ in range(ROUNDS):
            box = _split_round(rows, dim, box)
        cuts = _nodes(rows, [(n, dim[n], hi, n + open_[n] // 2) for n, (_, hi, _) in box.items()], "node int, dim int, hi long, right int")
        moved = rows.join(cuts, "node", "left").withColumn("node", F.when(_along() >= F.col("hi"), F.col("right")).otherwise(F.col("node")))
        last, rows = rows, park(moved.select(*rows.columns), "shard-level")
        release(last)
        width = {k: v for n, w in width.items() for k, v in ([(n, w // 2), (n + w // 2, w - w // 2)] if w > 1 else [(n, 1)])}
    return slots(rows.withColumnRenamed("node", "shard"), subs)


def slots(rows: DataFrame, subs: int | None = None) -> DataFrame:
    """A gapless slot from 0 in each shard. A shard's rows are numbered in blocks by row hash, so none is sorted whole."""
    spark = rows.sparkSession
    subs = subs or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("sub", F.pmod("tie", F.lit(subs)).cast("int"))
    count = rows.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    lead = count.selectExpr("shard", "sub", "sum(n) over (partition by shard order by sub) - n as lead")  # `subs` rows a shard
    at = rows.selectExpr("*", "row_number() over (partition by shard, sub order by tie, doc_id, text_crc32) - 1 as place")
    out = at.join(lead, ["shard", "sub"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("lead") + F.col("place")).cast("long").alias("slot"))
