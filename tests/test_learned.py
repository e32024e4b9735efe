"""Tree files and the pairwise ranker."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftrank.operators import ranker, trees
from driftrank.operators.metrics import ndcg_at
from driftrank.plans.learned import TREE_FILE


def test_a_file_is_read_to_nodes_and_written_back(spark, tmp_path):
    forest = trees.parse(TREE_FILE)
    assert forest.features == ["quantity", "kind", "score"] and list(forest.categories) == ["kind"] and forest.trees[0].sets == [frozenset({0, 2})]
    assert forest.importances()[0] == ("quantity", 2)
    nodes = forest.nodes(spark)
    assert nodes.where("node >= 0").count() == 4 and {r.leaf_value for r in nodes.where("tree = 1 and node < 0").collect()} == {0.125, 2.0, -2.0}
    (tmp_path / "m.txt").write_text(forest.to_text())
    again = trees.load(spark, str(tmp_path / "m.txt"))
    x = np.array([[a, b, c] for a in (np.nan, 0.0, 10.0, 24.5, 25.0) for b in (np.nan, 0.0, 1.0, 2.0, -1.0) for c in (np.nan, 0.05, 0.07)])
    assert (again.raw(x) == forest.raw(x)).all()


def test_every_kind_of_missing_value():
    one = lambda kind: trees.Tree(*[np.array(v) for v in ([0], [1.0], [kind], [-1], [-2], [10.0, 20.0])])
    x = np.array([[np.nan], [0.0], [0.5], [2.0]])
    want = {0: [10, 10, 10, 20], trees.NAN_IS_MISSING: [20, 10, 10, 20], trees.NAN_IS_MISSING | 2: [10, 10, 10, 20], trees.ZERO_IS_MISSING: [20, 20, 10, 20], trees.ZERO_IS_MISSING | 2: [10, 10, 10, 20]}
    for kind, w in want.items():
        assert one(kind).value[one(kind).leaves(x)].tolist() == w, kind
    assert trees.stump(3.0).leaves(x).tolist() == [0] * 4


def test_a_binary_file_gives_probabilities_and_a_broken_one_is_refused(spark):
    forest = trees.parse(TREE_FILE.replace("objective=lambdarank", "objective=binary sigmoid:1"))
    rows = spark.createDataFrame([(30.0, "PARAMETER_MOVED", 0.01), (None, "new kind", None)], "quantity double, kind string, score double")
    got = [r.p for r in rows.select(forest.score().alias("p")).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-1.125)), 1 / (1 + math.exp(1.75))])
    with pytest.raises(ValueError):
        trees.parse(TREE_FILE.replace("leaf_value=0.25 -0.5 1", "leaf_value=0.25 -0.5"))
    with pytest.raises(ValueError):
        trees.parse(TREE_FILE, categorical=["kind", "score"])


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Groups of 20 rows in a planted order of relevance, 3 for the best row down to 0, and a group's own level, which says nothing about it."""
    r = np.random.default_rng(5)
    n = 2400
    g = np.arange(n) // 20
    frame = pd.DataFrame({"g": g, "line": np.arange(n) % 20, "seen": r.random(n), "kind": [f"k{x}" for x in r.integers(0, 4, n)], "level": r.normal(0, 4, g.max() + 1)[g], "empty": np.nan})
    place = (2 * frame["seen"] + (frame["kind"] == "k3")).groupby(g).rank(ascending=False)
    frame["label"] = np.select([place <= 1, place <= 3, place <= 7], [3, 2, 1], 0)
    frame["positive"] = (frame["label"] > 0).astype(int)
    where = str(tmp_path_factory.mktemp("ranker") / "t.parquet")
    spark.createDataFrame(frame).write.parquet(where)
    df = spark.read.parquet(where)
    return df.where("g % 4 <> 0"), df.where("g % 4 = 0")


@pytest.fixture(scope="module")
def fitted(planted):
    return ranker.fit(*planted, ["g"], "label", ["seen", "level", "empty"], ["kind"], ["line"], rounds=8, rate=0.4, depth=3, least_rows=5, stop=8)


def _ndcg(df, score):
    return ndcg_at(df.withColumn("s", score), ["g"], "label", [F.desc("s"), F.col("line")], 10, F.pow(F.lit(2.0), "label") - 1).first()[0]


def test_loss_falls_every_round_and_the_order_beats_a_pointwise_model(fitted, planted):
    from driftrank.plans import models

    loss = [x["loss"] for x in fitted.rounds]
    assert loss[0] == pytest.approx(math.log(2)) and all(b < a for a, b in zip(loss, loss[1:]))
    train, valid = planted
    model = models.trees(["seen", "level"], ["kind"], "positive", count=8).fit(train)
    pointwise = _ndcg(models.scored(model, valid).drop("features"), F.col("score"))
    assert _ndcg(valid, fitted.forest.score()) > pointwise + 0.01


def test_file_trees_score_as_the_bins_did(fitted, planted, spark):
    """The forest evaluated on the rows' own values gives what training added up, missing values and unseen categories included."""
    text = trees.parse(fitted.forest.to_text(), categorical=["kind"])
    valid = planted[1]
    both = valid.select(fitted.forest.score().alias("a"), text.score().alias("b")).collect()
    assert all(r.a == pytest.approx(r.b, abs=1e-12) for r in both)
    assert fitted.rounds[fitted.best - 1]["valid"] == pytest.approx(max(x["valid"] for x in fitted.rounds))
    binner = ranker._binner(planted[0], "label", ["seen", "level", "empty"], ["kind"])
    rows = binner.table(planted[0], ["g"], "label", ["line"])
    passed = ranker._gradients(rows, ranker._ideal(rows))
    grown, step = ranker._grow(passed, 4, 3, 10, 1.0)
    one = trees.Forest(fitted.forest.features, [ranker._as_tree(grown, step, binner)], binner.codes)
    by_bins = sorted(round(r.s, 12) for r in ranker._advanced(rows, grown, step, 4).collect())
    assert len(grown.feature) > 2 and sorted(round(r.s, 12) for r in planted[0].select(one.score().alias("s")).collect()) == by_bins
    odd = spark.createDataFrame([(None, None, None, "k9"), (1e9, -1e9, 1.0, None)], "seen double, level double, empty double, kind string")
    assert all(math.isfinite(r.s) for r in odd.select(fitted.forest.score().alias("s")).collect())


def test_gradients_equal_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ranker, "TOP", 3)
    r = np.random.default_rng(1)
    rows = [("g" if i < 9 else "h", i, int(y), float(s), bytes([i])) for i, (y, s) in enumerate(zip(r.integers(0, 3, 14), r.integers(-2, 3, 14)))] + [("flat", 99, 1, 0.0, b"\x01")]
    df = spark.createDataFrame(rows, ranker._ROWS)
    got = {}
    for x in ranker._gradients(df, ranker._ideal(df)).collect():
        a = got.setdefault(x.id, [0.0, 0.0])
        a[0] += x.grad
        a[1] += x.curve
    for group in ("g", "h", "flat"):
        own = sorted((x for x in rows if x[0] == group), key=lambda x: (-x[3], x[1]))
        discount = [1 / math.log2(p + 2) if p < 3 else 0.0 for p in range(len(own))]
        best = sum((2**y - 1) * d for y, d in zip(sorted((x[2] for x in own), reverse=True), discount))
        want = {x[1]: [0.0, 0.0] for x in own}
        for i, a in enumerate(own):
            for j, b in enumerate(own):
                if a[2] > b[2]:
                    move, rho = abs(2 ** a[2] - 2 ** b[2]) * abs(discount[i] - discount[j]) / best, 1 / (1 + math.exp(a[3] - b[3]))
                    for x, sign in ((a, -1), (b, 1)):
                        want[x[1]][0] += sign * rho * move
                        want[x[1]][1] += rho * (1 - rho) * move
        for k, w in want.items():
            assert got[k] == pytest.approx(w, abs=1e-12)


def test_boosting_stops_early_and_keeps_the_best_round(spark):
    """Labels that say nothing about the features: validation stops rising at once."""
    df = spark.range(400).select((F.col("id") % 20).alias("g"), "id", (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).cast("int").alias("label"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100))).cast("double").alias("x"))
    got = ranker.fit(df.where("g < 15"), df.where("g >= 15"), ["g"], "label", ["x"], [], ["id"], rounds=20, depth=2, least_rows=5, stop=2)
    assert len(got.rounds) == got.best + 2 < 20 and len(got.forest.trees) == got.best


def test_large_groups_and_blocks_learn_the_same(planted, monkeypatch):
    """Groups taken whole in blocks, and the same ones met by their leading rows, give the same rounds; so do scores written anew."""
    def told(whole, fresh):
        monkeypatch.setattr(ranker, "MOST_WHOLE", whole)
        monkeypatch.setattr(ranker, "FRESH", fresh)
        got = ranker.fit(*planted, ["g"], "label", ["seen", "level", "empty"], ["kind"], ["line"], rounds=3, rate=0.4, depth=2, least_rows=5, stop=3)
        return [x for r in got.rounds for x in (r["loss"], r["valid"])]

    blocks = told(1024, 2)
    assert told(0, 16) == pytest.approx(blocks, rel=1e-9)
    largest = planted[0].groupBy("g").count().agg(F.percentile("count", 0.5)).first()[0]
    assert told(int(largest), 16) == pytest.approx(blocks, rel=1e-9)


@pytest.mark.parametrize("whole", [1024, 0])
def test_blocks_and_batches_without_a_pair(spark, tmp_path, monkeypatch, whole):
    """A block, or a batch of large groups, whose groups are each of one relevance has no pairs; the blocks beside it in the task have."""
    monkeypatch.setattr(ranker, "MOST_WHOLE", whole)
    monkeypatch.setattr(ranker, "BLOCK", 20)
    df = spark.range(0, 800, 1, 1).select((F.col("id") % 40).alias("g"), "id", F.when(F.col("id") % 40 < 36, 0).otherwise((F.col("id") % 3 == 0).cast("int")).alias("label"), (F.col("id") % 7).cast("double").alias("x"))
    df.write.parquet(str(tmp_path / "t.parquet"))
    df = spark.read.parquet(str(tmp_path / "t.parquet"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = ranker.fit(df, df, ["g"], "label", ["x"], [], ["id"], rounds=2, depth=2, least_rows=5, stop=2)
        none = ranker.fit(df.where("g < 36"), df.where("g < 36"), ["g"], "label", ["x"], [], ["id"], rounds=2, depth=2, least_rows=5, stop=2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.rounds[0]["loss"] == pytest.approx(math.log(2)) and got.rounds[1]["loss"] < got.rounds[0]["loss"]
    assert none.rounds[0] == {"loss": None, "valid": 0.0} and {r.s for r in df.select(none.forest.score().alias("s")).collect()} == {0.0}
