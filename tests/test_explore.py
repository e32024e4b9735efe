"""Exploration views and the bands of the bundle's lifts."""

import pytest
from pyspark.sql import functions as F

from driftrank.operators import explore, metrics
from driftrank.operators.store import Refused


@pytest.fixture(scope="module")
def changes(spark):
    rows = [
        ("Flask", None, "1.0", "OBJECT_REMOVED", "flask.a", True, 1), ("Flask", None, "1.0", "PARAMETER_MOVED", "flask.b", False, 1),
        ("Flask", "1.0", "2.0", "PARAMETER_REMOVED", "flask.c", False, 1), ("click", "8.0", "8.1", None, None, None, None), (None, None, None, "OBJECT_REMOVED", "x" * 61, None, 0),
    ]
    return spark.createDataFrame(rows, "package string, version_from string, version_to string, kind string, symbol string, is_private boolean, depth int")


def test_packages_and_kinds(changes):
    got = {r.package: (r.rows, r.pairs, r.share) for r in explore.by_package(changes).collect()}
    assert got == {"Flask": (3, 2, 0.6), "click": (1, 1, 0.2), None: (1, 1, 0.2)}
    kinds = {(r.kind, r.level): (r.rows, r.share, r.serious) for r in explore.by_kind(changes).collect()}
    assert kinds == {
        ("OBJECT_REMOVED", 0): (2, 0.4, True), ("PARAMETER_REMOVED", 0): (1, 0.2, True), ("PARAMETER_MOVED", 0): (1, 0.2, False), (None, 0): (1, 0.2, False),
        ("serious", 1): (3, 0.6, True), ("other", 1): (2, 0.4, False),
    }
    assert explore.by_package(changes.limit(0)).count() == 0 and explore.by_kind(changes.limit(0)).where("level = 0").count() == 0


def test_removed_and_one_package(changes):
    assert sorted((r.flag, r.symbol[:7]) for r in explore.removed(changes).collect()) == [("private", "flask.a"), ("public", "xxxxxxx")]
    got = sorted(((r.version_from or "", r.in_pair, r.mark, r.symbol) for r in explore.of_package(changes, "FLASK").collect()))
    assert got == [("", 2, " ", "flask.b"), ("", 2, "!", "flask.a"), ("1.0", 1, " ", "flask.c")]
    with pytest.raises(Refused):
        explore.of_package(changes, "django")


def test_one_row(changes):
    got = explore.card(changes, F.col("depth") == 0, ["package"], {"symbol": "its name", "kind": "what", "version_to": "new"}).collect()
    assert [(r.place, r.name, r.value, r.meaning) for r in got] == [(0, "symbol", "x" * 57 + "...", "its name"), (1, "kind", "OBJECT_REMOVED", "what"), (2, "version_to", "", "new")]
    with pytest.raises(Refused):
        explore.card(changes, F.col("depth") == 9, ["package"], {"symbol": "its name"})


def test_lift_bands_are_those_of_the_paired_intervals(spark):
    rows = [(f"g{i % 12}", float((i * 7) % 23), float((i * 5) % 11), float(i % 9), int(i * i % 7 < 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, score double, pop double, path double, label int")
    got = {r.quantity: (r.low, r.high, r.draws) for r in metrics.lift_bands(df, ["g"], "score", {"pop": "pop", "path": "path"}, "label", draws=100).collect()}
    for name in ("pop", "path"):
        want = metrics.intervals(df, ["g"], "score", name, "label", [F.desc("score")], draws=100).where("quantity = 'lift'").first()
        assert got[f"lift_over_{name}"] == pytest.approx((want.low, want.high, want.draws))
    assert metrics.lift_bands(df.limit(0), ["g"], "score", {"pop": "pop"}, "label", draws=10).count() == 0
