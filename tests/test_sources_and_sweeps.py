"""Registry sources with failures and mirrors, release listings, sweeps with repeated cuts, factorials, boundaries."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from driftrank.operators import audit, listing, reports, store, sweep
from driftrank.sources import web


@pytest.fixture(scope="module")
def server():
    seen, lock, now = Counter(), threading.Lock(), {"open": 0, "most": 0}

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            with lock:
                seen[self.path] += 1
                n = seen[self.path]
                now["open"] += 1
                now["most"] = max(now["most"], now["open"])
            name = self.path.rsplit("/", 1)[1]
            code = 404 if name == "gone" or (self.path.startswith("/main/") and name == "moved") else 503 if name == "flaky" and n < 2 else 200
            body = f"{name} of {self.path.split('/')[1]}".encode()
            with lock:
                now["open"] -= 1
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen, now
    http.shutdown()


def test_registry_rows_mirrors_and_errors(spark, server):
    base, seen, now = server
    names = ["a", "b/c", "flaky", "moved", "gone", "a"] + [f"p{i}" for i in range(30)]
    df = web.registry(spark, names, [f"{base}/main/{{}}", f"{base}/copy/{{}}"], per_partition=10, threads=3, pause=0.01)
    assert df.rdd.getNumPartitions() == 4
    got = {r.package: r for r in df.collect()}
    assert len(got) == 35 and got["a"].body == "a of main" and got["flaky"].body == "flaky of main" and got["moved"].body == "moved of copy"
    assert got["gone"].body is None and "404" in got["gone"].error and got["b/c"].mirror.endswith("/main/b%2Fc")
    assert now["most"] <= 3 * 4
    assert web.registry(spark, [], [f"{base}/main/{{}}"]).count() == 0


def test_a_document_is_fetched_once_and_kept(spark, server, tmp_path):
    base, seen, _ = server
    cache = str(tmp_path / "list.json")
    mirrors = ["http://127.0.0.1:1/none", f"{base}/main/ranking"]
    first = web.cached_document(spark, mirrors, cache, tries=1)
    assert web.cached_document(spark, mirrors, cache) == first == cache and seen["/main/ranking"] == 1
    assert spark.read.text(cache).first()[0] == "ranking of main"
    assert web.cached_document(spark, mirrors, cache, use_cache=False, tries=1) != cache and seen["/main/ranking"] == 2
    with pytest.raises(OSError):
        web.cached_document(spark, ["http://127.0.0.1:1/none"], str(tmp_path / "other"), tries=1)


def _listed(spark, releases, last=15, info=None):
    files = {v: [{"packagetype": t, "yanked": y, "url": f"u{v}", "upload_time_iso_8601": "d"} for t, y in f] for v, f in releases.items()}
    docs = listing.documents(spark.createDataFrame([("p", json.dumps({"info": info or {}, "releases": files}))], "package string, body string"))
    return {r.version: (r.status, r.place) for r in listing.window(listing.releases(docs), last).collect()}, docs


def test_release_reasons_window_and_fallback(spark):
    ok, wheel, yanked = [("sdist", False)], [("bdist_wheel", False)], [("sdist", True)]
    got, _ = _listed(spark, {"1.0": ok, "1.1": yanked, "1.2": wheel, "1.3rc1": ok, "1.4.dev1": ok, "2.0": ok, "0.1": wheel, "bad!": ok, "2.1": [("sdist", True), ("sdist", False)], "3.0rc1": ok, "0.5": []})
    assert got == {"1.0": ("kept", 3), "1.1": ("yanked", None), "1.2": ("no_source", None), "1.3rc1": ("prerelease", None), "1.4.dev1": ("dev", None), "2.0": ("kept", 2), "2.1": ("kept", 1)}
    assert _listed(spark, {"1.0": ok, "1.1": ok, "1.2": ok, "1.05": wheel}, last=2)[0] == {"1.1": ("kept", 2), "1.2": ("kept", 1)} | {}
    # Pre-releases count only where under two others are left, and only those that have a source.
    assert _listed(spark, {"1.0b1": ok, "1.0b2": wheel, "0.9": ok})[0] == {"1.0b1": ("kept", 1), "0.9": ("kept", 2)}
    assert _listed(spark, {"1.0b2": wheel, "0.9": ok})[0] == {"0.9": ("kept", 1)}
    assert _listed(spark, {"1.0": wheel, "1.1": wheel, "0.9": yanked, "x": ok}, last=2)[0] == {"1.0": ("no_source", None), "1.1": ("no_source", None)}


def test_the_best_link_names_the_repository(spark):
    urls = {"Funding": "https://github.com/sponsors/a", "Changelog": "https://github.com/a/changes", "Homepage": "https://github.com/a/site", "  Source Code": "https://github.com/a/code.git"}
    for info, want in (({"project_urls": urls}, "a/code"), ({"project_urls": {"Docs": "https://x"}, "home_page": "https://github.com/b/c"}, "b/c"), ({"home_page": None}, None), ({"project_urls": {"Changelog": "https://github.com/a/x", "Bugs": "https://github.com/a/y"}}, "a/x")):
        _, docs = _listed(spark, {"1": []}, info=info)
        assert listing.packages(docs).first().repository == want
    broken = listing.documents(spark.createDataFrame([("q", "not json"), ("r", None)], "package string, body string"))
    assert listing.window(listing.releases(broken)).count() == 0 and {r.repository for r in listing.packages(broken).collect()} == {None}


def test_equal_cuts_are_scored_once(spark):
    rows = [(i, f"2024-01-{1 + 3 * (i % 8):02d}", i % 5, float(i % 7), int(i % 3 == 0)) for i in range(160)]
    df = spark.createDataFrame(rows, "i int, d string, g int, score double, label int")
    cuts = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-03",), ("2024-01-04",), ("2024-01-05",), ("2030-01-01",)], "cut string")
    got = {r.cut: r for r in sweep.sweep(df, cuts, ["g"], "d", "score", "label").collect()}
    assert {c: r.repeat_of for c, r in got.items()} == {"2024-01-01": None, "2024-01-02": "2024-01-01", "2024-01-03": "2024-01-01", "2024-01-04": None, "2024-01-05": "2024-01-04"}
    assert got["2024-01-02"].pr_auc_ties == got["2024-01-01"].pr_auc_ties and got["2024-01-04"].rows == 120


def test_factorial_cells_and_the_record(spark):
    df = spark.createDataFrame([(f"2024-01-{1 + i % 9:02d}", i % 2 == 0, i % 3 == 0, int(i % 5 == 0)) for i in range(90)], "d string, a boolean, b boolean, label int")
    cuts = spark.createDataFrame([("2024-01-02",), ("2024-01-08",)], "cut string")
    out = reports.factorial_at(df, cuts, "d", F.col("a"), F.col("b"), "label")
    for r in out.collect():
        own = [x for x in df.collect() if x.d > r.cut]
        rate = lambda a, b: (lambda z: sum(z) / len(z) if z else None)([x.label for x in own if (x.a, x.b) == (a, b)])
        assert r.rate_neither == rate(False, False) and r.rate_both == rate(True, True)
        if None not in (r.rate_first, r.rate_second, r.rate_both, r.rate_neither):
            assert r.interaction == pytest.approx(r.rate_both - r.rate_first - r.rate_second + r.rate_neither)
    reports.assert_reproduced(out, out, ["rate_both"])
    with pytest.raises(store.Refused, match="2024-01-08"):
        reports.assert_reproduced(out, out.withColumn("rate_first", F.when(F.col("cut") > "2024-01-05", 9.0).otherwise(F.col("rate_first"))), ["rate_first"])


def test_every_gate_has_to_be_cleared(spark):
    days = spark.createDataFrame([("a", i, 10, i % 3, int(i == 2)) for i in range(1, 11)] + [("b", 1, 5, 0, 0)], "part string, day int, rows int, positives int, public int")
    one = audit.boundaries(days, {"positives": 4, "public": 0}, 1.0, ["part"]).first()
    assert (one.part, one.day, one.held, one.share, one.positives) == ("a", 7, 40, 0.4, 4)  # 1 + 0 + 2 + 1 of days 10 to 7
    got = {r.part: r for r in audit.boundaries(days, {"positives": 4, "public": 1}, 1.0, ["part"]).collect()}
    assert got["a"].day == 2 and got["a"].held == 90 and "b" not in got
    assert audit.boundaries(days, {"positives": 4, "public": 1}, 0.5, ["part"]).count() == 0
