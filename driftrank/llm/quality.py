"""Quality rules with adaptive thresholds from mergeable quantile sketches, one for each language and source.

Each row is measured once; fixed base rules reject what is too short or repeats itself; the other thresholds are fences
from two quantiles of the rows that pass the base rules, `inner` and `outer`: outer * GAMMA + REACH * (outer - inner) + SLACK,
and for the mean word length the same below, from the mirrored quantiles. Word lengths and symbols take the median and q80, so
up to a fifth of a cell's rows can be bad on a side without moving its fences; repeated lines and windows, of which the base
rules have left a thin tail, take q95 and q99. One repeated line and one pair of repeated windows are no repetition yet: the
shares leave them out. Where both quantiles are 0 (symbols in prose) the fence is the slack alone. Quantiles come from log-bucket sketches (counts of buckets whose bounds are powers of GAMMA, so a
quantile is off by half a percent at most). Sketches merge by adding counts, in any order, so thresholds do not depend on
how rows are dealt out; a cell of language and source with under MIN_ROWS rows takes its language's sketch, and a
language with too few takes that of all rows. Filtering joins each row with its cell's fences.

Defined results: null and empty texts have no words and fail the base rules; null language or source is a cell of its
own; repeated rows count each time; an empty table gives an empty result; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftrank.llm.textkit import plain_names, shingles, slices, splitmix, utf8, words
from driftrank.tables import park

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
GAMMA, MIN_ROWS = 1.01, 200
#: Sizes that slacks are told in: expression over the measured columns.
SIZES = {"chars": "__word_chars", "lines": "__n_lines"}
#: metric: (expression over the measured columns, inner and outer quantile, reach, slack, fence below too); a slack is a number, or
#: (so much, of which size's, which quantile)
RULES = {
    "mean_length": ("__word_chars / __n_words", "q50", "q80", 6.0, 0.03, True),
    "symbol_share": ("__n_symbols / __word_chars", "q50", "q80", 6.0, (6.0, "chars", "q50"), False),
    "dup_line_share": ("greatest(__n_dup_lines - 1, 0) / __n_lines", "q95", "q99", 1.0, (0.25, "lines", "q99"), False),
    "repeat_share": (f"greatest(__n_repeat_words - {2 * WINDOW}, 0) / __n_words", "q95", "q99", 1.0, 0.01, False),
}
QUANTILES = {"q1": 0.25, "q3": 0.75, "q20": 0.2, "q50": 0.5, "q80": 0.8, "q95": 0.95, "q99": 0.99}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Up to so many cells (under 10 MB) the fences are broadcast; more are joined by shuffle.
BROADCAST_CELLS = 50_000


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[off[1:]] - run[off[:-1]]


def _repeated(w) -> np.ndarray:
    """By text, the words inside 5-word windows that the text holds twice or more."""
    out = np.zeros(len(w.off) - 1, np.int64)
    total = len(w.hash)
    if total < WINDOW + 1:
        return out
    ok = np.flatnonzero(w.doc[: total - WINDOW + 1] == w.doc[WINDOW - 1 :])
    if not len(ok):
        return out
    h, owner = shingles(w, WINDOW)
    long = np.diff(w.first)[owner] >= WINDOW
    h, owner = h[long], owner[long]
    h = h ^ splitmix(owner.astype(np.uint64))
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return out
    hit = ok[np.isin(h, np.unique(twice))]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(w.doc[covered], minlength=len(out))


def _lines(text: str | None) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier one)"""
    found = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(found), len(found) - len(set(found))


def _measure(part: pa.RecordBatch) -> list[pa.Array]:
    raw, off = utf8(part.column("text"))
    w = words(raw, off)
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[w.start] += 1
    np.subtract.at(inside, w.end, 1)
    chars = (np.cumsum(inside[:-1]) > 0) & ((raw & 0xC0) != 0x80)
    lines = np.array([_lines(t) for t in part.column("text").to_pylist()], np.int64).reshape(-1, 2)
    return [pa.array(x, pa.int64()) for x in (np.diff(w.first), _per_doc(chars, off), _per_doc(_SYMBOL[raw], off), lines[:, 1], _repeated(w), lines[:, 0])]


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, and for each row __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words, __n_lines."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f"__{m}", T.LongType()) for m in MEASURES])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + _measure(part), names)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words"))


def _value(metric: str) -> Column:
    if metric in SIZES:
        return F.col(SIZES[metric]).cast("double")
    return F.coalesce(F.expr(f"try_divide({RULES[metric][0].replace(' / ', ', ')})"), F.lit(0.0))


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: one mergeable sketch for each cell and metric, of rows that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _value(m).alias("x")) for m in (*RULES, *SIZES)]))
    flat = rows.where(~base_failed()).select("lang", "source", each.alias("m")).select("lang", "source", "m.metric", "m.x")
    bucket = F.when(F.col("x") <= 1e-9, F.lit(-10000)).otherwise(F.ceil(F.log("x") / float(np.log(GAMMA)))).cast("int")
    return flat.groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by, metric, rows and the QUANTILES of sketches merged over the columns that `by` leaves out."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    over = "partition by " + ", ".join([*by, "metric"])
    run = merged.selectExpr(*by, "metric", "bucket", f"sum(n) over ({over} order by bucket) as upto", f"sum(n) over ({over}) as rows")
    x = F.when(F.col("bucket") == -10000, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    q = lambda p: F.min(F.when(F.col("upto") >= F.ceil(p * F.col("rows")), x))
    return run.groupBy(*by, "metric").agg(F.max("rows").alias("rows"), *[q(p).alias(x) for x, p in QUANTILES.items()])


def fences(sketch: DataFrame) -> DataFrame:
    """cell_lang, cell_source and, for each metric, the lowest and highest value that is kept."""
    cell, lang = quartiles(sketch, ["lang", "source"]), quartiles(sketch, ["lang"])
    whole = quartiles(sketch.withColumn("every", F.lit(1)), ["every"])
    name = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    a, b, c = name(cell, "a"), name(lang, "b"), name(whole, "c")
    # The right sides have a row for each language and metric, or for each metric.
    both = a.join(b, a.a_lang.eqNullSafe(b.b_lang) & (a.a_metric == b.b_metric), "left").join(c, a.a_metric == c.c_metric, "left")
    choose = lambda q: F.when(F.col("a_rows") >= MIN_ROWS, F.col(f"a_{q}")).when(F.col("b_rows") >= MIN_ROWS, F.col(f"b_{q}")).otherwise(F.col(f"c_{q}"))
    got = both.select(F.col("a_lang").alias("cell_lang"), F.col("a_source").alias("cell_source"), F.col("a_metric").alias("metric"), *[choose(q).alias(q) for q in QUANTILES])
    cols = []
    of = lambda m, q: F.max(F.when(F.col("metric") == m, F.col(q)))
    for m, (_, inner, outer, reach, slack, two) in RULES.items():
        low, mid, high = of(m, "q20"), of(m, inner), of(m, outer)
        slack = F.lit(slack[0]) / F.greatest(of(*slack[1:]), F.lit(1.0)) if isinstance(slack, tuple) else slack
        cols += [(high * GAMMA + reach * (high - mid) + slack).alias(f"hi_{m}")] + ([(low / GAMMA - reach * (mid - low) - slack).alias(f"lo_{m}")] if two else [])
    return got.groupBy("cell_lang", "cell_source").agg(*cols)


def judged(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows with __base_failed and __kept. A cell without fences has no row that passed the base rules."""
    if cells.count() <= BROADCAST_CELLS:  # cells is parked: the count reads file footers
        cells = F.broadcast(cells)
    fine = reduce(lambda a, b: a & b, [F.coalesce(_value(m) <= F.col(f"hi_{m}"), F.lit(True)) for m in RULES] + [F.coalesce(_value(m) >= F.col(f"lo_{m}"), F.lit(True)) for m in RULES if RULES[m][-1]])
    joined = rows.join(cells, rows["lang"].eqNullSafe(cells["cell_lang"]) & rows["source"].eqNullSafe(cells["cell_source"]), "left")
    return joined.select(*[rows[c] for c in rows.columns], base_failed().alias("__base_failed"), (~base_failed() & fine).alias("__kept"))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept of each row."""
    rows = park(measured(docs, ["doc_id", "lang", "source"]), "quality-rows")
    out = judged(rows, park(fences(sketches(rows)), "quality-fences"))
    return out.select("doc_id", *[F.col(f"__{m}").alias(m) for m in MEASURES], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


@plain_names
def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, columns as they are. Fences first, from narrow measured rows; then one more
    pass measures and filters each row in place, so that no text is shuffled."""
    narrow = park(measured(docs, ["lang", "source"]), "quality-rows")
    cells = park(fences(sketches(narrow)), "quality-fences")
    return judged(measured(docs, docs.columns), cells).where("__kept").select(*docs.columns)
