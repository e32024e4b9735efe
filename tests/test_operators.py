"""Plans whose answers a small table shows."""

import io
import itertools
import math
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from driftrank.operators import graph, keyed, labels, metrics, relational, rules, store, sweep
from driftrank.plans import models
from driftrank.sources import files
from driftrank.streaming import events


def test_average_precision_is_the_mean_over_orders_of_ties(spark):
    r = random.Random(3)
    cases = []
    for i in range(40):
        n = r.randint(2, 6)
        rows = [(i, float(r.randint(0, 2)), r.randint(0, 1)) for _ in range(n)]
        if any(x[2] for x in rows):
            cases.append(rows)
    got = {x.i: x.pr_auc_ties for x in metrics.average_precision(spark.createDataFrame([x for rows in cases for x in rows], "i int, score double, label int"), "score", "label", ["i"]).collect()}
    for rows in cases:
        total, orders = 0.0, 0
        for p in itertools.permutations(rows):
            if all(a[1] >= b[1] for a, b in zip(p, p[1:])):
                found, ap = 0, 0.0
                for k, (_, _, y) in enumerate(p, 1):
                    found += y
                    ap += y * found / k
                total, orders = total + ap / found, orders + 1
        assert abs(got[rows[0][0]] - total / orders) < 1e-9


def test_harmonic_numbers(spark):
    got = spark.range(0, 3000).select("id", metrics.harmonic(F.col("id")).alias("h")).orderBy("id").collect()
    h = 0.0
    for r in got:
        h += 1 / r.id if r.id else 0
        assert abs(r.h - h) < 1e-11


def test_bootstrap_covers_the_value(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(g, r.random() + 0.3 * (y := int(r.random() < 0.3)), y) for g in range(60) for _ in range(10)], "g int, score double, label int")
    low, high, _ = metrics.bootstrap(df, ["g"], "score", "label", draws=100).first()
    value = metrics.average_precision(df, "score", "label").first().pr_auc_ties
    assert low < value < high and high - low < 0.5


def test_later_rows_do_not_change_earlier_counts(spark):
    rows = [("p", "2026-01-01"), ("p", "2026-01-02"), ("p", "2026-01-02"), ("p", None), ("q", "2026-01-01")]
    df = lambda more: spark.createDataFrame(rows + more, "package string, d string")
    first = sorted(map(str, relational.count_before(df([]), ["package"], "d", "n").collect()))
    second = sorted(map(str, relational.count_before(df([("p", "2026-02-01")]), ["package"], "d", "n").where("d is null or d < '2026-02'").collect()))
    assert first == second and "n=0" in [x for x in first if "None" in x][0]


def test_holdout_is_decided_for_whole_groups(spark):
    rows = [("a", "2026-07-27", False), ("b", "2026-07-28", True), ("c", "2026-07-29", True), ("d", None, False), ("e", "2026-07-01", True), ("e", "2026-07-30", True)]
    got = labels.with_holdout(spark.createDataFrame(rows, "package string, d string, w boolean"), ["package"], "d", F.lit(labels.HOLDOUT_START)).collect()
    assert all(r.holdout == r.w for r in got)


def test_feature_audit():
    labels.audit_features(list(labels.FEATURES))
    with pytest.raises(ValueError):
        labels.audit_features(["kind"])


def test_alias_closure(spark):
    edges = [(f"a{i}", f"a{i + 1}") for i in range(12)] + [("x", "y"), ("y", "x"), ("s", "s"), ("b", "a0")]
    got = {r.alias: r.target for r in graph.alias_closure(spark.createDataFrame(edges, "alias string, target string")).collect()}
    assert got == {f"a{i}": "a12" for i in range(2, 12)}


def test_inheritance_folds(spark):
    rows = [("p", "m.Mixin.f", "K", "", None)] + [("p", f"m.C{i}.f", "K", "", "m.Mixin.f") for i in range(10)] + [("p", "deep.er.D.g", "K", "", "m._Base.g"), ("p", "m.D.g", "K", "", "m._Base.g")]
    got = {(r.symbol, r.inherited_by) for r in graph.fold_inherited(spark.createDataFrame(rows, "package string, symbol string, kind string, sub_target string, defined_at string")).collect()}
    assert got == {("m.Mixin.f", 10), ("m.D.g", 1)}


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, t int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 9)], "k int, v string, t int")
    assert sorted(map(tuple, store.upsert(old, new, ["k"], coalesced=["v"], kept=["t"]).collect())) == [(1, "a", 5), (2, "b", 6), (3, "c", 9)]
    folder = str(tmp_path / "t")
    store.publish(old, folder)
    store.publish(store.upsert(store.current(spark, folder), new, ["k"]), folder)
    assert store.current(spark, folder).count() == 3
    path = str(tmp_path / "log")
    store.append_rows(old, path, ["k", "v"])
    store.append_rows(old.limit(0), path, ["k", "v"])
    assert spark.read.parquet(path).count() == 2
    for bad in (lambda: store.append_rows(old, path, ["v", "k"]), lambda: store.guard_replacement(10, 4), lambda: store.guard_replacement(1, 0), lambda: store.guard_delete(100, 6, yes=True), lambda: store.guard_delete(100, 1)):
        with pytest.raises(store.Refused):
            bad()
    assert store.write_once(old, str(tmp_path / "m")) and not store.write_once(new, str(tmp_path / "m"))


def test_require_none(spark):
    df = spark.range(5)
    assert relational.require_none(df, F.col("id") > 9, "too large").count() == 5
    with pytest.raises(Exception, match="too large"):
        relational.require_none(df, F.col("id") > 3, "too large").collect()


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("package,version,released_at,status,n_changes\na,1.10,2026-01-01,clean,0\nb,1.0,nan,x,\n")
    got = files.csv(spark, str(tmp_path / "c.csv"), files.RELEASES).orderBy("package").collect()
    assert [(r.version, r.released_at, r.n_changes) for r in got] == [("1.10", "2026-01-01", 0), ("1.0", None, None)]
    assert files.optional_csv(spark, str(tmp_path / "none.csv"), files.RELEASES).count() == 0
    (tmp_path / "top.json").write_text('{"rows": [{"project": "x"}, {"project": "y"}]}')
    assert [tuple(r) for r in files.ranked_json(spark, str(tmp_path / "top.json"), limit=1).collect()] == [(1, "x")]
    (tmp_path / "done").write_text(" a\na\n\nb\n")
    assert sorted(r.line for r in files.lines(spark, str(tmp_path / "done")).collect()) == ["a", "b"]
    (tmp_path / "ar").mkdir()
    with tarfile.open(tmp_path / "ar" / "p.tar.gz", "w:gz") as t:
        for name, text in (("p/a.py", "import numpy as np\nfrom click import echo, style as s\nnp.linalg.norm(1)\ns.x.y\nfrom . import z\nfrom os import *\n"), ("../evil.py", "x"), ("p/b.txt", "x"), ("p/bad.py", "def (")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    (tmp_path / "ar" / "broken.zip").write_bytes(b"nothing")
    rows = files.archives(spark, str(tmp_path / "ar"))
    assert sorted(r.path for r in rows.where("error is null").collect()) == ["p/a.py", "p/bad.py"] and rows.where("error is not null").count() == 1
    pairs = files.usage_pairs(rows.where("error is null").select(F.lit("me").alias("scanner"), F.array(F.lit("os")).alias("own_roots"), "text"))
    assert sorted(r.symbol for r in pairs.collect()) == ["click.echo", "click.style", "click.style.x", "click.style.x.y", "numpy", "numpy.linalg", "numpy.linalg.norm"]  # each step of a chain
    assert files.usage_index(pairs).where("symbol = 'numpy'").first().user_count == 1


def test_streams_agree_with_tables(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    table.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = run(events.windowed(stream, "1 hour"), "complete", "w")
    key = lambda df: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(got) == key(events.windowed(table, "1 hour"))
    counts = run(events.running_counts(stream), "update", "c").groupBy("user_id").agg(F.max("seen").alias("seen"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, table.groupBy("user_id").count().collect()))
    assert run(events.first_seen(stream.union(stream), "event_id", "90 days"), "append", "f").count() == table.count()
    events.upsert_batches(stream.select("event_id", "value"), str(tmp_path / "t"), ["event_id"], str(tmp_path / "ck"), "value").awaitTermination(120)
    assert keyed.read(spark, str(tmp_path / "t")).count() == table.count()


def test_learned_scorers(spark):
    r = random.Random(5)
    df = models.balanced(spark.createDataFrame([(x := r.random(), r.choice("ab"), int(r.random() < x)) for _ in range(400)], "x double, k string, y int"), "y")
    model = models.linear(["x"], ["k"], "y", steps=10).fit(df)
    out = models.scored(model, df.withColumn("k", F.lit("unseen")))
    assert metrics.average_precision(out, "score", "y").first().pr_auc_ties > df.agg(F.avg("y")).first()[0]
    tree = models.trees(["x"], ["k"], "y", count=2).fit(df)
    assert models.importances(tree, ["x", "k"])[0][0] == "x"
    assert models.tree_count([3, 50, 40]) == 40 and models.choose([{"n": 2}, {"n": 1}], [1.0, 1.0], lambda s: s["n"]) == {"n": 1}
    assert models.ablations(["a", "b"], {"no a": ["a"]}, ["b"]) == {"no a": ["b"], "control:b": ["a"]}


def test_a_missing_number_stays_missing_under_the_logarithm(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (3.0,)], "package_rank double")
    assert [r[0] for r in models.prepared(df, ["package_rank"]).collect()] == [None, 0.0, pytest.approx(math.log(4))]


@pytest.mark.parametrize("name,features", [("q_linear_baseline", labels.FEATURES), ("q_model_grid", None), ("q_ablation", None), ("q_serving_scores", None)])
def test_linear_fits_end_by_themselves(name, features, spark, sf, monkeypatch):
    """Every fit goes on until it converges, and the baseline's has all 17 features."""
    from pyspark.ml import Pipeline

    from driftrank.plans import catalogue, reports
    from driftrank.plans.standins import Standins

    fits, real = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: (fits.append(real(self, df)), fits[-1])[1])
    f = next(getattr(m, name) for m in (catalogue, reports) if hasattr(m, name))
    assert f(Standins(spark, sf)).count() > 0
    assert fits and all(m.stages[-1].summary.totalIterations < m.stages[-1].getMaxIter() for m in fits)
    used = {*fits[0].stages[0].getInputCols(), *fits[0].stages[3].getInputCols()}
    assert features is None or used == set(features)


def test_web_source(spark):
    import http.server
    import threading

    class Answer(http.server.BaseHTTPRequestHandler):
        seen: dict[str, int] = {}

        def do_GET(self):
            n = self.seen[self.path] = self.seen.get(self.path, 0) + 1
            ok = self.path == "/ok" or (self.path == "/late" and n > 1)
            self.send_response(200 if ok else 404 if self.path == "/gone" else 503)
            self.end_headers()
            if ok:
                self.wfile.write(b'{"a": 1}')

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    from driftrank.sources import web

    urls = [f"http://127.0.0.1:{server.server_address[1]}/{p}" for p in ("ok", "late", "gone", "down")]
    got = {r.url.rsplit("/", 1)[1]: (r.body, r.error) for r in web.json_documents(spark, urls, pause_s=0.01).collect()}
    server.shutdown()
    assert got["ok"][0] == got["late"][0] == '{"a": 1}' and got["gone"][1] and got["down"][1]
    assert Answer.seen == {"/ok": 1, "/late": 2, "/gone": 1, "/down": 3}


def test_sweeps_over_different_cuts_are_refused(spark):
    from driftrank.operators import sweep

    a = spark.createDataFrame([(1, 0.5), (2, 0.9)], "cut int, x double")
    assert [r.moved for r in sweep.compare_sweeps(a, a.withColumn("x", F.col("x") + F.col("cut") * 0.2), "x").orderBy("cut").collect()] == [False, True]
    with pytest.raises(store.Refused):
        sweep.compare_sweeps(a, a.where("cut = 1"), "x")


def test_the_holdout_is_looked_at_once(spark, tmp_path):
    from driftrank.operators import sealed

    r = random.Random(2)
    rows = [(g, i, r.random(), int(r.random() < 0.4), g >= 30) for g in range(40) for i in range(25)]
    df = spark.createDataFrame(rows, "package int, i int, score double, label int, holdout boolean")
    dev, held = sealed.parts(df)
    key, ledger = ["package"], str(tmp_path / "ledger")
    got = sealed.evaluate_once(dev, held, key, [F.desc("score")], "score", "label", ledger, "one")
    assert got["upgrades"] == 10 and got["rows"] == 250 and 0 < got["pr_auc_ties"] <= 1 and spark.read.parquet(ledger).count() == 1
    with pytest.raises(store.Refused):
        sealed.evaluate_once(dev, held, key, [F.desc("score")], "score", "label", ledger, "one")
    with pytest.raises(store.Refused):
        sealed.evaluate_once(df, held, key, [F.desc("score")], "score", "label", ledger, "two")
    path = str(tmp_path / "frozen")
    assert sealed.freeze(held, key, path) and not sealed.freeze(held, key, path)
    assert {x.side: x.groups for x in sealed.drift(df.where("package >= 35 or package < 2"), key, path).collect()} == {"kept": 5, "gone": 5, "added": 2}
    sealed.write_metrics(spark, got, str(tmp_path / "m"))
    assert sealed.read_metrics(spark, str(tmp_path / "m"))["rows"] == 250
    with pytest.raises(store.Refused):
        sealed.assert_none_held_out(df, "package", F.lit(39))


def test_scripts_and_catalog(spark):
    ids = spark.range(1200).withColumnRenamed("id", "k")
    assert store.delete_script(ids, "t", "k").count() == 3 and store.delete_script(ids.limit(3), "t", "k").count() == 0
    ids.createOrReplaceTempView("some_ids")
    assert store.columns_of(spark, "some_ids") == ["k"]


def test_intervals_of_five_quantities_and_of_rates_against_plain_sums(spark):
    import numpy as np

    rows = [(f"g{i % 12}", float((i * 7) % 23), float((i * 5) % 11), int(i * i % 7 < 2), "ab"[i % 5 > 1]) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, score double, other double, label int, kind string")
    got = {r.quantity: r for r in metrics.intervals(df, ["g"], "score", "other", "label", [F.desc("score"), F.desc("other")], draws=300).collect()}
    assert set(got) == {"pr_auc", "baseline_pr_auc", "lift", "precision_at_10", "ndcg_at_20"} and all(r.draws == 300 and r.low < r.high for r in got.values())
    hashes = df.select("g", F.xxhash64("g").alias("h")).distinct().collect()
    w = {(r.g, d): int(x) for r, row in zip(hashes, metrics.weights(np.array([r.h for r in hashes]), 300)) for d, x in enumerate(row)}
    top = {g: sum(x[3] for x in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], -x[2]))[:10]) / 10 for g in {x[0] for x in rows}}
    means = [sum(w.get((g, d), 0) * v for g, v in top.items()) / sum(w.get((g, d), 0) for g in top) for d in range(300)]
    assert np.allclose([got["precision_at_10"].low, got["precision_at_10"].high], np.percentile(means, [2.5, 97.5]))
    rate = {r.kind: r for r in sweep.rate_intervals(df, ["g"], "kind", "label", draws=300, base="a").collect()}

    def of(kind, d):
        k = [(w.get((x[0], d), 0), x[3]) for x in rows if x[4] == kind]
        return sum(a * b for a, b in k) / sum(a for a, _ in k)

    pair = np.array([[of("a", d), of("b", d)] for d in range(300)])
    b = rate["b"]
    assert np.allclose([b.minus_base_low, b.minus_base_high], np.percentile(pair[:, 1] - pair[:, 0], [2.5, 97.5]))
    assert np.allclose([b.over_rest_low, b.over_rest_high], np.percentile(pair[:, 1] / pair[:, 0], [2.5, 97.5])) and b.minus_base == b.minus_rest


@pytest.mark.parametrize("hot", [1 << 16, 3])
def test_precision_of_each_draw_against_plain_sums(spark, monkeypatch, hot):
    """Every draw's average precision equals that of its rows repeated by weight, hot scores summed beforehand or not."""
    import numpy as np

    monkeypatch.setattr(metrics, "HOT_CELLS", hot)
    rows = [(f"g{i % 9}", float((i * 7) % 11) if i % 13 else None, int(i * i % 7 < 2)) for i in range(150)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    hashes = df.select("g", F.xxhash64("g").alias("h")).distinct().collect()
    w = dict(zip([r.g for r in hashes], metrics.weights(np.array([r.h for r in hashes]), 30, 5)))
    got = {r.draw: r.v for r in metrics._draws_of_precision(df, ["g"], "score", "label", 30, 5).collect()}
    for d in range(30):
        runs, above, found, total = {}, 0, 0, 0.0
        for g, s, y in rows:
            a = runs.setdefault(-math.inf if s is None else s, [0, 0])
            a[0] += int(w[g][d])
            a[1] += int(w[g][d]) * y
        for s in sorted(runs, reverse=True):
            n, r = runs[s]
            for i in range(1, n + 1):
                total += r / n * (found + 1 + (i - 1) * (r - 1) / (n - 1 if n > 1 else 1)) / (above + i)
            above, found = above + n, found + r
        assert got[d] == pytest.approx(total / found, rel=1e-9)


def test_weights_are_those_of_poisson():
    import numpy as np

    w = metrics.weights(np.arange(4000), 200, 3)
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01 and abs((w == 0).mean() - math.exp(-1)) < 0.003
    assert (w[7] == metrics.weights(np.array([7]), 200, 3)[0]).all() and not (w == metrics.weights(np.arange(4000), 200, 4)).all()


def test_quantiles_are_those_of_percentile(spark):
    r = random.Random(11)
    shares = [0.0, 0.4, 0.55, 0.8, 1.0]
    for n in (1, 2, 7, 500):
        rows = [(float(r.randint(0, 40)) if r.random() > 0.1 else None,) for _ in range(n)] + [(3.5,)]
        df = spark.createDataFrame(rows, "v double")
        want = df.agg(F.percentile("v", F.array(*[F.lit(s) for s in shares])).alias("q")).first().q
        assert relational.quantiles(df, F.col("v"), shares).first().q == pytest.approx(want, abs=1e-12)
    assert relational.quantiles(spark.createDataFrame([(None,)], "v double"), F.col("v"), shares).first().q == [None] * 5


def test_dates_split_without_a_date(spark):
    undated = spark.createDataFrame([(1, None), (2, None)], "i int, d date")
    assert {x.split for x in labels.split_by_date(undated, "d", 0.2).collect()} == {"train"}
    assert labels.folds(undated, "d").count() == 0
    some = spark.createDataFrame([(i,) for i in range(10)], "i int").withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")))
    assert sorted(x.i for x in labels.split_by_date(some, "d", 0.2).where("split = 'test'").collect()) == [8, 9]


def test_more_rows_are_dealt_into_more_parts(spark, sf, monkeypatch):
    """What a task sorts or groups stays the same when the tables grow."""
    from driftrank import tables
    from driftrank.plans.standins import Standins

    monkeypatch.setattr(tables, "ROWS_A_TASK", 500)
    s = Standins(spark, sf)
    assert s.changes.rdd.getNumPartitions() >= s.n_changes // 500 > spark.sparkContext.defaultParallelism


def test_one_change_each_needs_no_distinct_count(spark):
    rows = [("p", "u", "a", 1), ("p", "u", "a", 0), ("p", "u", "b", None), ("p", "u", "b", 1), ("p", "u", "c", None)]
    out = rules.one_change_each(spark.createDataFrame(rows, "package string, upgrade string, symbol string, label int"), "label", ("package", "upgrade"))
    assert {(r.symbol, r.label, r.rows, r.mixed) for r in out.collect()} == {("a", 1, 2, True), ("b", 1, 2, False), ("c", None, 1, False)}
    assert "distinct" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_the_feature_table_deals_rows_out_once_a_key(spark, sf):
    """Two sides by order, package and module; bumps by package and upgrade, ranks by package twice."""
    from driftrank.plans import reports
    from driftrank.plans.standins import Standins

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reports.q_feature_table(Standins(spark, sf))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    assert sum("Exchange hashpartitioning" in x for x in lines) <= 7


@pytest.mark.parametrize("name", ["q_serving_scores", "q_linear_baseline", "q_model_grid", "q_ablation", "q_lambdarank"])
def test_learners_read_the_changes_once(name, spark, sf):
    """Every pass of a fit reads the written rows, not the joins and windows before them."""
    from driftrank.plans import catalogue, learned, reports
    from driftrank.plans.standins import Standins

    met = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        met.add(1)
        return text

    s = Standins(spark, sf)
    s.changes = s.changes.withColumn("symbol", counted.asNondeterministic()("symbol"))
    f = next(getattr(m, name) for m in (catalogue, reports, learned) if hasattr(m, name))
    assert f(s).count() > 0
    assert met.value <= 2 * s.n_changes


def test_a_text_is_parsed_once_in_a_task(spark, monkeypatch):
    from driftrank.sources import files

    code = spark.range(0, 3000, 1, 1).selectExpr("cast(id % 2 as string) as scanner", "array('own') as own_roots", "concat('import t.a, own.b\n', if(id % 3 = 0, 'def (', '')) as text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        calls = spark.sparkContext.accumulator(0)
        real = files.used_names

        def counting(text, tracked=None):
            calls.add(1)
            return real(text, tracked)

        monkeypatch.setattr(files, "used_names", counting)
        got = files.usage_pairs(code).groupBy("scanner", "symbol").count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in got} == {("0", "t.a", 1000), ("1", "t.a", 1000)}


def test_a_task_gives_out_a_key_once(spark):
    """300 keys in turn fill no more than the held vectors: a row a key leaves the task, not one each time 64 keys were met."""
    rows = spark.range(0, 30000, 1, 1).selectExpr("cast(id % 300 as double) as score", "id as g", "1.0 as n")
    out = metrics.weighed_sums(rows, ["score"], ["n"], 20)
    want = metrics.weights(metrics.np.arange(30000), 20).astype(float)
    got = {(r.score, r.draw): r.n for r in out.collect()}
    assert len(got) == 6000 and all(got[k, d] == want[int(k)::300, d].sum() for k in (0.0, 7.0, 299.0) for d in (0, 19))
    assert metrics.HELD // (8 * 2000 * 2) > 1024 and len(list(metrics._gathered(iter([metrics.pd.DataFrame({"a": range(10)})] * 7)))) == 1


def test_files_of_any_size_are_analyzed_without_a_limit(spark):
    from driftrank.operators import serve

    n = serve.MOST_PINS + 50
    lines = "\n".join(f"p{i}==1.0" for i in range(n))
    file = spark.createDataFrame([("f", lines)], "file string, text string")
    packages = spark.range(n).selectExpr("id as package", "concat('p', id) as name")
    releases = spark.range(n).selectExpr("id as package", "'1.0' as version", "id as upgrade", "'F' as status")
    none = spark.createDataFrame([], "upgrade bigint, line bigint, symbol string, kind string, sub_target string, is_private boolean")
    usage, scores = spark.createDataFrame([], "symbol string, user_count bigint"), spark.createDataFrame([], "upgrade bigint, line bigint, model_version string, score double")
    told = lambda **more: {r.status: r["count"] for r in serve.analyzed(file, packages, releases, none, usage, scores, "m", **more).groupBy("status").count().collect()}
    assert told(most_pins=None) == {"up_to_date": n} and told() == {"too_many_packages": 1}
