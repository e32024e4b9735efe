"""Operators without SQL: source trees, isolated runs, published tables, orders over whole tables."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from driftrank import tables
from driftrank.functions import names
from driftrank.operators import api, graph, keyed, relational, reports, runs, sealed, store
from driftrank.sources import files as files_
from driftrank.streaming import events

OLD = '''
import warnings
from .core import Thing as Other
LIMIT: int = 3
def f(a, b=1, *, c=2) -> int:
    """Words.

    .. deprecated:: 1.2
    """
@deprecated
class A(Base, Mixin):
    x = 1
    def m(self, p, q): ...
def gone(): ...
'''
NEW = '''
LIMIT: float = 3
def f(b, a=1, *, c, d) -> str: ...
class A(Base):
    x = 2
    def m(self, q, /): ...
'''


@pytest.fixture(scope="module")
def offers(spark):
    files = spark.createDataFrame([("p", "1", "pk.mod", OLD), ("p", "2", "pk.mod", NEW), ("p", "1", "pk.bad", "def ("), ("p", "1", "pk.none", None)], "package string, version string, module string, text string")
    return api.symbols(files).persist()


def test_symbols_of_a_source_tree(offers):
    got = {(r.symbol, r.what, r.parameter) for r in offers.where("version = 1").collect()}
    assert {("pk.mod.f", "function", ""), ("pk.mod.f", "parameter", "c"), ("pk.mod.A", "base", "Mixin"), ("pk.mod.A.m", "parameter", "p"), ("pk.mod.LIMIT", "attribute", "")} <= got
    assert not [s for s, *_ in got if s.startswith(("pk.bad", "pk.none"))]
    assert {tuple(r) for r in api.alias_edges(offers).collect()} == {("pk.mod.Other", "pk.core.Thing"), ("pk.mod.warnings", "warnings")}
    assert {r.symbol for r in api.deprecated(offers.where("version = 1")).collect()} == {"pk.mod.f", "pk.mod.A", "pk.mod.A.m", "pk.mod.A.x"}


def test_structural_diff_of_two_trees(offers):
    got = {tuple(r) for r in api.structural_diff(offers.where("version = 1"), offers.where("version = 2")).collect()}
    assert got == {
        ("pk.mod.gone", "OBJECT_REMOVED", ""), ("pk.mod.LIMIT", "ATTRIBUTE_CHANGED_TYPE", ""), ("pk.mod.A.x", "ATTRIBUTE_CHANGED_VALUE", ""), ("pk.mod.f", "RETURN_CHANGED_TYPE", ""),
        ("pk.mod.f", "PARAMETER_CHANGED_REQUIRED", "b"), ("pk.mod.f", "PARAMETER_MOVED", "a"), ("pk.mod.f", "PARAMETER_MOVED", "b"), ("pk.mod.f", "PARAMETER_CHANGED_REQUIRED", "c"),
        ("pk.mod.f", "PARAMETER_ADDED_REQUIRED", "d"), ("pk.mod.A", "CLASS_REMOVED_BASE", "Mixin"), ("pk.mod.A.m", "PARAMETER_REMOVED", "p"), ("pk.mod.A.m", "PARAMETER_CHANGED_KIND", "q"),
        ("pk.mod.A.m", "PARAMETER_MOVED", "q"), ("pk.mod.A.m", "PARAMETER_CHANGED_KIND", "self"),
    }


def _rows(module, text, *what):
    return {r[0] for r in api.offered(module, text) if not what or r[1] in what}


def test_definitions_inside_blocks_and_again():
    text = """
import os.path, numpy as np
from typing import overload
try:
    def f(a): ...
except ImportError:
    def f(b): ...
    def only(): ...
if True:
    class A:
        x = 1
else:
    class A:
        y = 1
with open(p) as h:
    held = 1
def g(): ...
def g(again): ...
@overload
def g(x: int): ...
class B:
    old = 1
class B:
    new = 1
"""
    got = api.offered("p.m", text)
    assert {r[0] for r in got} == {"p.m.os", "p.m.np", "p.m.overload", "p.m.f", "p.m.only", "p.m.A", "p.m.A.x", "p.m.held", "p.m.g", "p.m.B", "p.m.B.new"}
    assert [r[2] for r in got if r[1] == "parameter"] == ["a", "again"]
    assert {(r[0], r[8]) for r in got if r[1] == "alias"} == {("p.m.os", "os"), ("p.m.np", "numpy"), ("p.m.overload", "typing.overload")}


def test_relative_imports():
    alias = lambda module, text: {(r[0], r[8]) for r in api.offered(module, text) if r[1] in ("alias", "star")}
    assert alias("p.q.m", "from . import y\nfrom .z import a as b\nfrom .. import t\nfrom ..s import *") == {("p.q.m.y", "p.q.y"), ("p.q.m.b", "p.q.z.a"), ("p.q.m.t", "p.t"), ("p.q.m", "p.s")}
    assert alias("p.q.__init__", "from . import y\nfrom .z import *\nfrom ..s import a") == {("p.q.y", "p.q.y"), ("p.q", "p.q.z"), ("p.q.a", "p.s.a")}
    assert not alias("p", "from .... import y")


def test_what_counts_as_deprecated():
    yes = ["Deprecated: use g.", "**Deprecated**", "x\n\n.. deprecated:: 1.4", ":deprecated: y", "DEPRECATED and gone", "Warning: Deprecated", '!!! warning "Deprecated"', "Deprecated since version 1.4", "It was deprecated in 2", "This class is deprecated.", "this function has  been deprecated"]
    no = ["Deprecated aliases are listed here", "'economic' mode is deprecated", ":param x: deprecated", "This parameter is deprecated", "Issued for usage of deprecated APIs", "", None, "deprecatedly :"]
    assert all(map(api.says_deprecated, yes)) and not any(map(api.says_deprecated, no))
    marked = lambda deco: [r[7] for r in api.offered("m", f"@{deco}\ndef f(): ...") if r[1] == "function"] == [True]
    assert marked("deprecated") and marked("util.Deprecated('x')") and marked("deprecate(since=1)")
    assert not marked("deprecated_params(1)") and not marked("deprecate_kwarg('x')") and not marked("pytest.mark.filterwarnings('ignore::DeprecationWarning')")


def test_star_imports_are_a_fixpoint(spark):
    """A ring of star imports ends, lists decide what is handed on, own names come first."""
    files = {"r.a": "from r.b import *\none = 1\n_a = 1", "r.b": "from r.c import *\ntwo = 2\none = 9", "r.c": "from r.a import *\n__all__ = ['three', 'one']\nthree = 3\nfour = 4", "r.__init__": "from .a import *\nfrom r import *"}
    rows = spark.createDataFrame([("r", "1", m, t) for m, t in files.items()], "package string, version string, module string, text string")
    got = {(r.symbol, r.target) for r in api.star_names(api.symbols(rows)).collect()}
    assert got == {("r.a.two", "r.b.two"), ("r.a.three", "r.b.three"), ("r.b.three", "r.c.three"), ("r.c.one", "r.a.one"), ("r.c.two", "r.a.two"), ("r.one", "r.a.one"), ("r.two", "r.a.two"), ("r.three", "r.a.three")}
    whole = api.with_stars(api.symbols(rows))
    assert ("r.three", "r.c.three") in {tuple(r) for r in graph.alias_closure(api.alias_edges(whole)).collect()}


def test_inherited_members_by_level_and_order(spark):
    files = {"q.m": "class A:\n  def f(self): ...\n  def g(self): ...\nclass B:\n  def f(self): ...\n  def h(self): ...\nclass C(B, A):\n  def h(self): ...\nclass D(C): ...\nclass E(E): ...\nclass F(n.Out): ...\n"}
    rows = spark.createDataFrame([("q", "1", m, t) for m, t in files.items()], "package string, version string, module string, text string")
    got = {tuple(r) for r in api.inherited_members(api.symbols(rows)).collect()}
    assert got == {("q.m.C.f", "q.m.B.f"), ("q.m.C.g", "q.m.A.g"), ("q.m.D.f", "q.m.B.f"), ("q.m.D.g", "q.m.A.g"), ("q.m.D.h", "q.m.C.h")}


@pytest.mark.parametrize("walk", [api.inherited_members, api.star_names])
def test_no_walk_parses_a_source_twice(walk, spark):
    """Rounds and levels read the written offers: each text goes through the parser once."""
    parsed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        parsed.add(1)
        return text

    rows = spark.createDataFrame([("q", "1", "q.a", "class A:\n  def f(self): ..."), ("q", "1", "q.b", "from q.a import *\nfrom q.a import A\nclass B(A): ..."), ("q", "1", "q.c", "from q.b import *")], "package string, version string, module string, text string")
    assert walk(api.symbols(rows.withColumn("text", counted("text")))).count() > 0
    assert parsed.value == 3


def test_short_forms_of_expressions_are_those_of_unparse():
    for text in ("a", "a.b.c", "1", "True", "None", "-1", "1.5", "'x'", "a[0].b", "f(x).y", "1j", "...", "b''", "(1).real"):
        node = api.ast.parse(text, mode="eval").body
        assert api._text(node) == api.ast.unparse(node)


def test_a_source_offers_its_definitions_after_many_others():
    """A name is looked for below a replaced one only; a thousand names take no walk over the others each."""
    text = "".join(f"class C{i}:\n  def f(self): ...\n" for i in range(50)) + "class C7:\n  g = 1\n"
    got = {r[0] for r in api.offered("m", text)}
    assert "m.C7.g" in got and "m.C7.f" not in got and "m.C8.f" in got


def test_chains_count_every_step():
    assert files_.used_names("import numpy as np\nnp.linalg.solve(x).y.z\nother.a.b") == ["numpy", "numpy.linalg", "numpy.linalg.solve"]


def test_noise_names_and_repositories(spark):
    rows = [("Third-Party", True), ("py_src", True), (".hidden", True), ("test_x", True), ("a_tests", True), ("_testing", True), ("Docs", True), ("flask", False), ("contest", False), ("latest", False)]
    got = spark.createDataFrame(rows, "n string, w boolean").select(api.is_noise(F.col("n")).alias("g"), "w").collect()
    assert all(r.g == r.w for r in got)
    urls = [("https://github.com/users/x", None), ("http://www.GitHub.com/A_b/c.d.GIT", "A_b/c.d"), ("git+https://github.com/a/b", None), ("https://github.com/a/b c", "a/b"), ("https://github.com/a b/c", None), ("https://github.com/a", None), ("https://gitlab.com/a/b", None), (None, None), ("https://github.com/topics/x", "topics/x")]
    got = spark.createDataFrame(urls, "u string, w string").select(names.repository(F.col("u")).alias("g"), "w").collect()
    assert [r.g for r in got] == [r.w for r in got]


@pytest.mark.parametrize("name", ["q_csv_scan", "q_line_set", "q_ranked_json"])
def test_a_second_call_leaves_the_first_ones_result(name, spark, sf):
    import __spark_entry__

    first = __spark_entry__.queries()[name](spark, sf)
    n = first.count()
    __spark_entry__.queries()[name](spark, sf.replace("sf0.001", "sf0.01")).count()
    assert first.count() == n


def test_old_and_new_of_an_explanation(spark):
    rows = [("m.py:3: f(x): Parameter default was changed: 1 -> [2, 3]",), ("a: b was changed: 'x -> y' -> 3",), ("a: b was changed: unset", ), (None,), ("a: b was changed: 1 -> 2 -> 3",)]
    got = spark.createDataFrame(rows, "t string").select(api.old_and_new(F.col("t")).alias("v")).select("v.*").collect()
    assert [tuple(r) for r in got] == [("1", "[2, 3]"), ("'x -> y'", "3"), (None, None), (None, None), (None, None)]


def _work(unit):
    k = unit["k"]
    if k == 2:
        raise ValueError("no")
    if k == 3:
        time.sleep(30)
    if k == 4:
        os._exit(9)
    yield from ((k * 10 + i,) for i in range(k))
    if k == 5:
        raise RuntimeError("half done")


def test_units_are_isolated_and_whole(spark):
    units = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6)], "k long").repartition(3)
    got = runs.isolated(units, _work, "v long", seconds=3).collect()
    fine = sorted((r.k, r.v) for r in got if r.error is None)
    assert fine == [(1, 10)] + [(6, 60 + i) for i in range(6)]
    said = {r.k: r.error for r in got if r.error}
    assert said[2] == "ValueError: no" and "3 seconds" in said[3] and "ended with 9" in said[4] and "half done" in said[5]


def test_runs_resume_and_restart(spark, tmp_path):
    units, done = spark.range(10).withColumnRenamed("id", "k"), str(tmp_path / "done")
    assert runs.left_to_do(units, done, ["k"]).count() == 10
    units.where("k < 4").write.parquet(done)
    assert {r.k for r in runs.left_to_do(units, done, ["k"]).collect()} == set(range(4, 10))
    assert runs.restart(spark, done) and not runs.restart(spark, done) and not os.path.exists(done)
    assert runs.in_batches(spark.range(10_000), ["id"], 2000).groupBy("batch").count().count() == 5


def test_a_reader_finds_a_published_version_at_any_time(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert not store.published(spark, folder)
    for i in range(12):
        store.publish(spark.range(i + 1), folder)
        pointers = sorted(os.listdir(f"{folder}/pointers"))
        assert len([p for p in pointers if not p.startswith(".")]) == i + 1  # none is changed or taken away
        assert store.current(spark, folder).count() == i + 1


def test_a_second_writer_is_refused(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    store.publish(spark.range(1), folder)
    seen = store._pointers(spark, folder)
    store.publish(spark.range(2), folder)
    monkeypatch.setattr(store, "_pointers", lambda *_: seen)  # what a writer saw that began before
    with pytest.raises(store.Refused) as e:
        store.publish(spark.range(3), folder)
    monkeypatch.undo()
    assert e.value.code == "taken" and store.current(spark, folder).count() == 2


def _files_of(folder):
    return {b: sorted(os.listdir(os.path.join(folder, p))) for b, p in json.load(open(f"{folder}/manifests/{max(n for n in os.listdir(f'{folder}/manifests') if n[0] != '.')}"))["folders"].items()}


def test_upserts_write_only_what_they_touch(spark, tmp_path):
    folder = str(tmp_path / "k")
    old = spark.range(500).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.lit(1).alias("first"), F.lit(None).cast("timestamp").alias("at"))
    rules = [keyed.Rule("one row a key", "unique", ("k",)), keyed.Rule("k is there", "present", ("k",)), keyed.Rule("first is positive", "check", says="first > 0"), keyed.Rule("v is known", "reference", ("v",), "values")]
    known = {"values": spark.range(2000).select(F.concat(F.lit("v"), "id").alias("v"))}
    keyed.create(spark, folder, old.schema, ["k"], 16, rules)
    assert keyed.read(spark, folder).count() == 0
    assert keyed.merge(old, folder, tables=known) == 16
    before = _files_of(folder)
    new = spark.createDataFrame([(7, None, 5), (1000, "v9", 5)], "k long, v string, first int").withColumn("at", F.lit(None).cast("timestamp"))
    n = keyed.merge(new, folder, coalesced=["v"], kept=["first"], stamp="at", tables=known)
    after = _files_of(folder)
    assert 1 <= n <= 2 and sum(before[b] != after[b] for b in before) == n
    got = {r.k: (r.v, r.first, r.at is not None) for r in keyed.read(spark, folder).collect()}
    assert len(got) == 501 and got[7] == ("v7", 1, True) and got[1000] == ("v9", 5, True) and got[8] == ("v8", 1, False)
    for bad, name in (([(1, "v1", -1)], "first is positive"), ([(1, "unknown", 1)], "v is known")):
        with pytest.raises(store.Refused, match=name):
            keyed.merge(spark.createDataFrame(bad, "k long, v string, first int").withColumn("at", F.lit(None).cast("timestamp")), folder, tables=known)
    assert _files_of(folder) == after and keyed.read(spark, folder).count() == 501
    assert keyed.vacuum(spark, folder, keep=1) == 0 and keyed.read(spark, folder).count() == 501
    keyed.merge(old, folder, tables=known)
    assert keyed.vacuum(spark, folder, keep=1) == 2 and keyed.read(spark, folder).count() == 501


def test_a_keyed_table_refuses_a_writer_from_an_older_state(spark, tmp_path):
    folder, rows = str(tmp_path / "k"), spark.range(10).withColumnRenamed("id", "k")
    keyed.create(spark, folder, rows.schema, ["k"], 4)
    stale = keyed.manifest(spark, folder)
    keyed.merge(rows, folder)
    with pytest.raises(store.Refused) as e:
        keyed._publish(spark, folder, stale)
    assert e.value.code == "taken" and keyed.read(spark, folder).count() == 10
    store.claim(spark, f"{folder}/manifests/{99:012d}", "{")  # a writer that died while it wrote
    keyed.merge(rows.selectExpr("k + 5 as k"), folder)
    assert keyed.read(spark, folder).count() == 15


def test_batches_hold_the_rows_they_may(spark, tmp_path):
    folder = str(tmp_path / "k")
    rows = spark.range(1050).select((F.col("id") % 700).alias("k"), F.col("id").alias("seq"))
    keyed.create(spark, folder, rows.schema, ["k"], 8)
    assert keyed.merge_in_batches(rows, folder, "seq", 400) == [400, 400, 250]
    assert {(r.k, r.seq) for r in keyed.read(spark, folder).collect()} == {(k, k + 700 if k < 350 else k) for k in range(700)}


def test_micro_batches_keep_the_last_row(spark, tmp_path):
    src, folder = str(tmp_path / "src"), str(tmp_path / "t")
    spark.createDataFrame([(1, 5, "new"), (1, 2, "old"), (2, 1, "only")], "k long, seq long, v string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k long, seq long, v string").parquet(src)
    events.upsert_batches(stream, folder, ["k"], str(tmp_path / "ck"), "seq").awaitTermination(120)
    assert {(r.k, r.v) for r in keyed.read(spark, folder).collect()} == {(1, "new"), (2, "only")}


@pytest.mark.parametrize("hops", [1, 2, 3, 5, 10])
def test_alias_closure_takes_the_hops_it_is_given(spark, hops):
    chain = [(f"a{i}", f"a{i + 1}") for i in range(14)] + [("x", "y"), ("y", "x")]
    got = {(r.alias, r.target) for r in graph.alias_closure(spark.createDataFrame(chain, "alias string, target string"), hops).collect()}
    assert got == {(f"a{i}", "a14") for i in range(14 - hops, 14)}


def test_ranks_of_a_whole_table(spark):
    rows = [(i, float(i * 7 % 50) if i % 9 else None) for i in range(400)]
    got = {r.k: r.r for r in relational.ranked(spark.createDataFrame(rows, "k long, v double"), "v", "r").collect()}
    order = sorted((v for _, v in rows if v is not None), reverse=True)
    assert got == {k: order.index(v) + 1 if v is not None else len(order) + 1 for k, v in rows}


def test_digest_of_a_key_set(spark):
    one = lambda rows: relational.set_digest(spark.createDataFrame(rows, "a long, b string"), ["a", "b"]).first().fingerprint
    assert one([(1, "x"), (2, None)]) == one([(2, None), (1, "x"), (1, "x")]) != one([(1, "x"), (2, "y")])
    held = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a long, b string")
    assert sealed.membership(held, ["a", "b"]).first().groups == 2


def test_weights_and_ties(spark):
    assert reports.weights_checked(spark.createDataFrame([(0,), (3,)], "w long"), "w").count() == 2
    with pytest.raises(Exception, match="whole number"):
        reports.weights_checked(spark.createDataFrame([(0.5,)], "w double"), "w").collect()
    t = spark.range(50)
    order = [r.id for r in t.orderBy(reports.tie_key(["id"], 0)).collect()]
    assert order == [r.id for r in t.repartition(7).orderBy(reports.tie_key(["id"], 0)).collect()] != list(range(50))


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Session:
        conf = Conf

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="share"):
        tables.shared_dir(Session)


def test_model_helpers(spark):
    from driftrank.plans import models

    assert models.noise_floor([("all", 0.3, 0.0), ("no_x", 0.2, -0.1), ("control:a", 0.31, 0.01), ("control:b", 0.28, -0.02)]) == 0.02
    assert models.noise_floor([("all", 0.3, 0.0)]) == 0.0
