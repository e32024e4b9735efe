"""Each operator against a plain restatement of its contract, on the smallest tables and on odd rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from driftrank.llm import components, fingerprint, jaccard, lm, packing, quality, queries, repeats, sharding, spans, spm, url_filter
from driftrank.tables import table
from tests.llm.conftest import texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


@pytest.fixture(params=["documents", "odd"])
def docs(request, spark, sf, odd):
    return table(spark, sf, "documents") if request.param == "documents" else odd


def test_empty_tables(empty, spark):
    assert not spm.digests(empty, queries.PIECES).count()
    assert not quality.verdicts(empty).count() and not quality.keep_good(empty).count()
    assert not jaccard.join(empty, 4, 85).count() and not jaccard.one_of_each(empty).count()
    assert not repeats.dedup(empty).count()
    assert not lm.score(empty).count() and not fingerprint.fingerprints(empty).count()
    assert not spans.dedup(empty).count() and not packing.pack(empty, queries.BYTES).count()
    assert not sharding.kd_tree(empty).count()
    assert not url_filter.judge(spark.createDataFrame([], "page_id long, url string"), url_filter.HOST_RULES).count()


def test_sentencepiece(docs):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    want = Counter()
    for i, t in texts(docs):
        ids = own.encode(t)
        want[i, len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids))] += 1
    assert Counter(map(tuple, spm.digests(docs, queries.PIECES).collect())) == want


def test_sentencepiece_against_the_library_on_random_text():
    import random

    import sentencepiece

    own, model, r = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES), spm.load(queries.PIECES), random.Random(5)
    bits = [" ", "  ", "a", "b", "the", "▁", "\n", "\t", "é", "①", "漢", "…", ".", ",", "ing", " th", "\x00", "😀", "é", "-", "1", "<s>", "<0x41>", "    "]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 40)))
        ids = model.encode(t)
        assert ids == own.encode(t) and model.decode(ids) == own.decode(ids), t


def test_url_filter(spark, sf):
    odd_urls = [(1, None), (2, "no scheme"), (3, "http://a.NET"), (4, "http://a.net/x"), (4, "http://a.net/x"), (None, "https://Example.Net/en/?q"), (6, "x://example.com/de/a"), (7, "x://www.example.com/de"), (8, "x://a.org/fr/1#f"), (9, "x://notexample.net/en/"), (10, "http://casino.example.com/x"), (11, "http://x.example.com/casino-architecture/1"), (12, "://"), (13, "http://u://b.net/y")]
    pages = spark.createDataFrame(odd_urls, "page_id long, url string").unionByName(table(spark, sf, "pages").select("page_id", "url"))

    def want(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        if not m:
            return "", "", None, "allow"
        host, path = m[1].translate(LOWER), m[2]
        fit = [(len(h + p), h + p, v) for h, p, v in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fit:
            return host, path, max(fit)[1], max(fit)[2]
        rest = (host + url[m.end(1) :]).lower()
        if re.search(r"(^|[^a-z0-9])casino[^a-z0-9]architecture([^a-z0-9]|$)", rest):
            return host, path, None, "allow"
        hit = re.search(r"(^|[^a-z0-9])(cheap-pills|casino|viagra|free-money|xxx|porn|payday-loan|poker)([^a-z0-9]|$)", rest)
        return host, path, None, "block" if hit else "allow"

    got = url_filter.judge(pages, [*url_filter.HOST_RULES, *url_filter.PATTERNS])
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == Counter((r.page_id, *want(r.url)) for r in pages.collect())


def _measures(t):
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    cover = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_quality(docs):
    got = quality.verdicts(docs).collect()
    want = Counter()
    for i, t in texts(docs):
        m = _measures(t)
        want[i, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def _kept(rows):
    """Plain restatement: (id, kept) of rows (id, text, lang, source)."""
    g = 1.01
    share = lambda a, b: a / b if b else 0.0
    measured = []
    for i, t, *cell in rows:
        n, chars, symbols, dup, rep = _measures(t or "")
        lines = sum(bool(WORD.search(x)) for x in (t or "").split("\n"))
        x = {"chars": float(chars), "lines": float(lines), "mean": share(chars, n), "symbol": share(symbols, chars), "line": share(max(dup - 1, 0), lines), "repeat": share(max(rep - 10, 0), n)}
        measured.append((i, tuple(cell), n >= 10 and 100 * rep <= 20 * n, x))
    near = lambda x: 0.0 if x <= 1e-9 else 2 * g ** math.ceil(math.log(x) / math.log(g)) / (g + 1)

    def quantiles(metric, cell):
        for same in (lambda c: c == cell, lambda c: c[0] == cell[0], lambda c: True):
            x = sorted(near(m[metric]) for _, c, ok, m in measured if ok and same(c))
            if len(x) >= 200:
                break
        return lambda p: x[math.ceil(p * len(x)) - 1]

    bounds = {}
    for cell in {c for _, c, ok, _ in measured if ok}:
        hi = {}
        for m, a, b, reach, slack in (("mean", 0.5, 0.8, 6, 0.03), ("symbol", 0.5, 0.8, 6, None), ("line", 0.95, 0.99, 1, None), ("repeat", 0.95, 0.99, 1, 0.01)):
            q = quantiles(m, cell)
            if slack is None:
                slack = 6 / max(quantiles("chars", cell)(0.5), 1) if m == "symbol" else 0.25 / max(quantiles("lines", cell)(0.99), 1)
            hi[m] = q(b) * g + reach * (q(b) - q(a)) + slack
        q = quantiles("mean", cell)
        bounds[cell] = hi, q(0.2) / g - 6 * (q(0.5) - q(0.2)) - 0.03
    for i, cell, ok, x in measured:
        yield i, ok and all(x[m] <= v for m, v in bounds[cell][0].items()) and x["mean"] >= bounds[cell][1]


def test_quality_verdicts_are_those_of_a_plain_restatement(docs, spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    assert Counter((r.doc_id, r.kept) for r in quality.verdicts(docs).collect()) == Counter(_kept(rows))
    many = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", F.lit("s").alias("source"))
    got = Counter((r.doc_id, r.kept) for r in quality.verdicts(many).collect())
    assert got == Counter(_kept([tuple(r) for r in many.collect()]))
    assert 0.02 < sum(not k for _, k in got) / len(got) < 0.3


def test_quality_fences_differ_between_cells(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    cells = quality.fences(quality.sketches(quality.measured(docs, ["lang", "source"]))).collect()
    assert len({round(c.hi_mean_length, 3) for c in cells}) > 3 and len({round(c.hi_repeat_share, 3) for c in cells}) > 3
    large = {(r.lang, r.source) for r in docs.groupBy("lang", "source").count().where("count >= 250").collect()}
    own = [c for c in cells if (c.cell_lang, c.cell_source) in large]
    assert len(own) > 15 and len({round(c.hi_symbol_share, 5) for c in own}) > 10 and len({round(c.hi_dup_line_share, 5) for c in own}) > 5
    assert max(c.hi_symbol_share for c in own) < 0.05 and min(c.hi_symbol_share for c in own) > 0.001


def test_quality_keeps_prose_and_rejects_symbols(spark):
    prose = [(i, " ".join(f"word{(i * 31 + j * 7) % 613}" for j in range(40)), "en", "s") for i in range(400)]
    junk = [(1000 + i, " ".join(f"|##{i}{j}|$$" for j in range(40)), "en", "s") for i in range(5)]
    docs = spark.createDataFrame(prose + junk, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {i for i, *_ in prose}


def test_quality_fences_follow_the_cell(spark):
    """Words of one more letter, some symbols or repeated lines reject in a cell where others have none, not where all have."""
    plain = lambda i, more="": " ".join(f"{more}w{(i * 31 + j * 7) % 613:03}" for j in range(60))
    lines = lambda i: "\n".join([plain(i)] + [f"line {i} x"] * 4)
    marks = lambda i: plain(i) + " " + "#" * 8
    rows = [(i, plain(i), "en", "a") for i in range(300)] + [(1000 + i, f(i), "en", "a") for i, f in enumerate((lambda i: plain(i, "ab"), lines, marks))]
    rows += [(2000 + i, marks(i), "en", "b") for i in range(300)] + [(3000 + i, plain(i, "ab"), "en", "c") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in quality.keep_good(docs).collect()} == {1000, 1001, 1002}


def test_many_equal_rows_hold_one_rows_spans(spark):
    text = " ".join(f"w{i * 7919 % 100_003}" for i in range(200))
    rows = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("tag"), F.lit(text).alias("text"))
    got = repeats.removed(rows).collect()
    assert len(got) == 1 and len(got[0].spans) < 50
    assert {(r.n_bytes, r.n_removed) for r in repeats.dedup(rows.drop("tag")).select("n_bytes", "n_removed").collect()} == {(len(text), len(text))}


def test_sketch_quartiles_merge_and_come_near(spark):
    docs = spark.createDataFrame([(i, " ".join("abcdefghij"[: 2 + (i * j) % 7] + str(j) for j in range(1, 60)), "en", f"s{i % 3}") for i in range(300)], "doc_id long, text string, lang string, source string")
    rows = quality.measured(docs, ["lang", "source"]).withColumn("x", quality._value("mean_length"))
    got = {r.metric: r for r in quality.quartiles(quality.sketches(rows), ["lang"]).collect()}["mean_length"]
    x = sorted(r.x for r in rows.collect())
    for q, v in ((0.25, got.q1), (0.75, got.q3)):
        assert abs(v / x[math.ceil(q * len(x)) - 1] - 1) < 0.011


def _classes(rows, k, percent):
    sets = [frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if (w := WORD.findall(t.translate(LOWER))) else frozenset() for _, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                parent[y] = x
    return Counter((i, len(s), root(i)) for (i, _), s in zip(rows, sets))


def test_ngram_jaccard(docs):
    got = jaccard.join(docs, 4, 85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _classes(texts(docs), 4, 85)


@pytest.mark.parametrize("percent", [70, 85])
def test_ngram_jaccard_on_a_dense_group(spark, percent):
    import random

    r = random.Random(3)
    base = [f"w{r.randrange(4000)}" for _ in range(120)]
    rows = []
    for i in range(140):
        w = list(base[: 120 - r.choice([0, 0, 5, 30])])
        for _ in range(r.randrange(0, 12)):
            w[r.randrange(len(w))] = f"v{r.randrange(30)}"
        rows.append((i * 7 % 140, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.join(docs, 4, percent).collect()) == _classes(rows, 4, percent)


def test_bitmaps_rule_out_no_linked_rows(spark):
    r = np.random.default_rng(5)
    low, high = -(1 << 63), (1 << 63) - 1
    held, pairs = {}, []
    for i, n in enumerate((1, 3, 12, 60, 300, 3000)):
        a = [low, high, -1, *map(int, r.integers(low, high, n))][:n]
        swapped = n * 15 // 185
        held[2 * i], held[2 * i + 1] = a, a[: n - swapped] + list(map(int, r.integers(low, high, swapped)))
        pairs.append((2 * i, 2 * i + 1))
    bits = jaccard._bitmaps(spark.createDataFrame([(k, h) for k, v in held.items() for h in v], "node long, h long"))
    got = {x.node: x.bits for x in bits.collect()}
    for k, v in held.items():
        words = [0] * jaccard.BITMAP
        for h in v:
            words[(h >> 6) % jaccard.BITMAP] |= 1 << (h & 63)
        assert [w & (1 << 64) - 1 for w in got[k]] == words
    rows = [(len(held[a]), got[a], 1, len(held[a]), len(held[b]), got[b], 1, len(held[b])) for a, b in pairs]
    table = spark.createDataFrame(rows, "n_a long, bits_a array<long>, place_a int, m_a int, n_b long, bits_b array<long>, place_b int, m_b int")
    assert table.where(jaccard._can_link(85)).count() == len(pairs)
    assert not table.where("n_a between 60 and 300").selectExpr("*", "transform(bits_b, x -> 0L) as z").drop("bits_b").withColumnRenamed("z", "bits_b").where(jaccard._can_link(85)).count()


def test_linked_rows_share_a_block_row():
    r = np.random.default_rng(1)
    for percent in (70, 80, 85):
        for n in (1, 2, 3, 7, 12, 40, 200, 1000):
            for _ in range(20):
                a = r.integers(0, 1 << 63, n).astype(np.uint64)
                worst = int(n * (100 - percent) / (100 + percent))  # swapping s of n leaves (n - s) / (n + s)
                b = a.copy()
                b[:worst] = r.integers(0, 1 << 63, worst).astype(np.uint64)
                assert np.intersect1d(jaccard.block_rows(a, percent)[0], jaccard.block_rows(b, percent)[0]).size
                c = a[: math.ceil(n * percent / 100)]
                assert np.intersect1d(jaccard.block_rows(a, percent)[0], jaccard.block_rows(c, percent)[0]).size


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(6, 40)] + [(300, 200), (200, 250), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 5 for i in range(5, 40)} | {200: 200, 250: 200, 300: 200}


def test_lm_scoring(docs):
    rows = texts(docs)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: [*WORD.findall(t.translate(LOWER)), None]
    c = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((i is None, i or 0), held(i), len(split(t)), sum(c[w] > 0 for w in split(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for i, t in rows)
    got = lm.score(docs).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def _lm_scores(rows, order, mass):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: [*WORD.findall(t.translate(LOWER)), None]
    c = Counter()
    for i, t in rows:
        if not held(i):
            w = split(t)
            c.update(tuple(w[a:b]) for a in range(len(w)) for b in range(a + 1, min(a + order, len(w)) + 1))
    single = [k for g, k in c.items() if len(g) == 1]
    n, v, n1, n2 = sum(single), len(single), single.count(1), single.count(2)
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(h, w):
        if not h:
            return ((c[(w,)] - d) / n if c[(w,)] else d * v / n) if n else 1.0
        m = mass[len(h)]
        return (c[(*h, w)] + m * p(h[1:], w)) / (c[h] + m)

    for i, t in rows:
        w = split(t)
        yield i, sum(math.log10(p(tuple(w[max(0, j - order + 1) : j]), w[j])) for j in range(len(w)))


@pytest.mark.parametrize("order, block", [(lm.ORDER, lm.BLOCK), (lm.ORDER, 700), (2, 1), (1, lm.BLOCK)])
def test_lm_score_is_that_of_a_plain_backoff_model(docs, order, block):
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(_lm_scores(texts(docs), order, lm.MASS), key=key)
    got = sorted(((r.doc_id, r.score) for r in lm.score(docs, order, block).collect()), key=key)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(x - y) < 1e-7 * max(1, abs(y)) for (_, x), (_, y) in zip(got, want))


def test_lm_beats_single_words_on_held_out_texts(spark, sf):
    held = [r for r in lm.score(table(spark, sf, "documents")).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_without_training_text(spark):
    rows = [(i, "some words") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all((r.train_tokens, r.n_known, r.score) == (0, 0, 0.0) for r in got)


def test_automaton_is_a_distribution():
    model = lm.Automaton(100, 13, 5, 2)
    c = np.array([40, 30, 12, 2, 2, 1, 1, 1, 1, 1, 5, 3, 1])
    root = model.root(np.append(c, 0))
    # 13 known tokens, what the unknown ones share, and a state of 9 with arcs to three of the known ones
    assert abs(root.sum() - 1) < 1e-9
    assert abs(model.step(root, np.full(14, 9.0), np.array([4.0, 0, 3, 0, 0, 2] + [0] * 8), 1).sum() - 1) < 1e-9


@pytest.mark.parametrize("lane", [1, 2, 7, 1 << 20])
def test_automaton_walks_in_lanes_of_any_length(lane):
    r = np.random.default_rng(lane)
    sizes = np.array([1, 40, 2, 1, 300, 5])
    block = lm.Block(r.integers(0, 30, sizes.sum(), np.uint64), sizes, np.ones(sizes.sum(), bool))
    totals = [r.integers(0, 4, len(np.unique(k))).astype(np.uint64) for _, k in block.grams(3)]
    for k in (1, 2):  # a training n-gram holds shorter ones
        (at, keys), (less, short) = block.grams(3)[k], block.grams(3)[k - 1]
        place = dict(zip(less.tolist(), np.unique(short, return_inverse=True)[1].tolist()))
        number = np.unique(keys, return_inverse=True)[1]
        for i, j in zip(at.tolist(), number.tolist()):
            if totals[k - 1][place[i]] == 0 or totals[k - 1][place[i - 1]] == 0:
                totals[k][j] = 0
    model = lm.Automaton(1000, 30, 5, 2)
    p, count = model.walk(block, totals, lane)
    grams = {(k, i): int(totals[k - 1][j]) for k in (1, 2, 3) for (at, keys) in [block.grams(3)[k - 1]] for i, j in zip(at.tolist(), np.unique(keys, return_inverse=True)[1].tolist())}
    for i in range(len(p)):
        q = float(model.root(np.array([grams[1, i]]))[0])
        for k in (2, 3):
            if (k, i) in grams:
                q = (grams[k, i] + model.mass[k - 1] * q) / (grams[k - 1, i - 1] + model.mass[k - 1])
        assert abs(p[i] - math.log10(q)) < 1e-9 and count[i] == grams[1, i]


@pytest.mark.parametrize("fan", [2, 3, 5])
def test_tally_in_levels_holds_few_rows_a_node(spark, monkeypatch, fan):
    from driftrank.llm import tally

    r = np.random.default_rng(fan)
    keys = [np.unique(np.append(r.integers(0, 1 << 62, 40, np.uint64), [np.uint64(7), np.uint64(1 << 61)])) for _ in range(24)]  # two keys in every block
    rows = [x for i, k in enumerate(keys) for x in tally.requests(i, 1, k, np.full(len(k), 1 << 31 if i < 4 else 1), 3).to_pylist()]
    asked = spark.createDataFrame(rows, tally.REQUEST)
    flat = tally.answers(asked, 3, "flat")
    monkeypatch.setattr(tally, "FAN", fan)
    groups = tally.shape(100, 24, 3)[2]
    tall = tally.answers(asked, 3, "tall", groups)
    assert groups == -(-24 // fan)
    assert sorted(map(tuple, tall.select("block", "kind", "bucket", "totals", "size").collect())) == sorted(map(tuple, flat.select("block", "kind", "bucket", "totals", "size").collect()))
    sums = [x.selectExpr("sum(seen)", "sum(once)", "sum(twice)").first() for x in (flat, tall)]
    assert sums[0] == sums[1]


def test_tally_adds_up_over_blocks(spark):
    from driftrank.llm import tally

    r = np.random.default_rng(3)
    keys = [np.unique(r.integers(0, 1 << 63, 50, np.uint64) % np.uint64(1 << 50) << np.uint64(14) if i % 2 else r.integers(0, 40, 30, np.uint64)) for i in range(6)]
    rows = [x for i, k in enumerate(keys) for x in tally.requests(i, i % 2, k, np.full(len(k), i), 7).to_pylist()]
    found = tally.by_block(tally.answers(spark.createDataFrame(rows, tally.REQUEST), 5, "test")).collect()
    want = Counter((i % 2, int(x)) for i, k in enumerate(keys) for x in k.tolist() for _ in range(i))
    for row in found:
        k = row.block % 2
        assert tally.totals([g.asDict() for g in row.got], k).tolist() == [want[k, int(x)] for x in keys[row.block].tolist()]
    assert len(found) == 6


def _bytes_left(rows):
    raws = [t.encode() for _, t in rows]
    count = Counter(b[i : i + 400] for b in raws for i in range(len(b) - 399))
    out = Counter()
    for (i, _), b in zip(rows, raws):
        gone = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                gone[p] += 1
                gone[p + 400] -= 1
        x = np.cumsum(gone[:-1]) > 0
        spans_ = int(x[0]) + int((x[1:] & ~x[:-1]).sum()) if len(b) else 0
        out[i, len(b), int(x.sum()), spans_, sha(bytes(np.frombuffer(b, np.uint8)[~x]))] += 1
    return out


def _got_bytes(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), sha(bytes(r.kept))) for r in df.collect())


@pytest.mark.parametrize("most", [20_000, 1])
def test_suffix_dedup(docs, most):
    docs = docs.where("length(text) < 60000 or text is null")
    assert _got_bytes(repeats.dedup(docs, most)) == _bytes_left(texts(docs))


def test_suffix_dedup_where_places_start_over(spark, monkeypatch):
    """Places are kept in a few bits; with fewer, texts are long enough to use them up."""
    monkeypatch.setattr(repeats, "_PLACE", np.uint64((1 << 10) - 1))
    raw = np.frombuffer(("ab" * 700 + "".join(chr(97 + (i * i) % 23) for i in range(3000)) + "xyz" * 900).encode(), np.uint8)
    off = np.array([0, 350, 350, len(raw)])
    h = repeats.grams(raw, (32,))[32]
    ahead = repeats._ahead(h, off, repeats.REACH)
    key = h & ~np.uint64((1 << 10) - 1)
    for p in range(350, len(ahead)):
        assert ahead[p] == int(np.argmin(key[p : p + repeats.REACH + 1]))


def test_longest_shared_passage(spark):
    import random

    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))
    passage = {n: prose(n) for n in (20, 52, 60, 90)}
    rows = [(i, prose(r.randint(60, 200))) for i in range(60)]
    for k, (n, p) in enumerate(passage.items()):
        rows += [(100 + 10 * k + j, prose(r.randint(5, 90)) + " " + p + " " + prose(r.randint(5, 90))) for j in range(2 + k)]
    rows += [(200, None), (201, ""), (202, "short"), (None, prose(80)), (203, "z" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.longest_shared for x in repeats.dedup(docs).collect()}
    assert all(got[i] == 0 for i, t in rows if i is None or i < 110 or 200 <= i < 203)
    for i, t in rows:
        if i and 110 <= i < 200:
            n = len(list(passage.values())[(i - 100) // 10])
            assert n - 2 * (repeats.PIECE_GRAM + repeats.PIECE_REACH) <= got[i] <= n + 2, (i, n, got[i])
    assert got[203] > 2500


def _passages(rows, n=48):
    """(id, bytes, words) by tables of all n-word windows: the longest stretch of repeated ones, of ones that another row holds."""
    found = [list(re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())) for _, t in rows]
    times, holders = Counter(), {}
    for i, ws in enumerate(found):
        for p in range(len(ws) - n + 1):
            key = tuple(m[0] for m in ws[p : p + n])
            times[key] += 1
            holders.setdefault(key, set()).add(i)
    out = Counter()
    for (i, _), ws in zip(rows, found):
        best, begun = [0, 0], [None, None]
        for p in range(len(ws) - n + 1):
            key = tuple(m[0] for m in ws[p : p + n])
            for j, ok in enumerate((times[key] > 1, len(holders[key]) > 1)):
                begun[j] = (p if begun[j] is None else begun[j]) if ok else None
                if ok:
                    best[j] = max(best[j], p + n - begun[j] if j else ws[p + n - 1].end() - ws[begun[j]].start())
        out[i, *best] += 1
    return out


def _same_passages(df, rows):
    """A text without such a stretch of words tells the longest removed one."""
    got = [(r.doc_id, r.longest_shared, r.shared_words, max([0, *[s.b - s.a for s in r.spans]])) for r in df.collect()]
    want = _passages(rows)
    assert Counter((i, n) for i, _, n, _ in got) == sum((Counter({(i, n): c}) for (i, _, n), c in want.items()), Counter())
    stretch = Counter({k: c for k, c in want.items() if k[1]})
    assert not stretch - Counter(g[:3] for g in got)
    rest = Counter(g[:3] for g in got) - stretch
    assert not rest - Counter((i, removed, 0) for i, _, _, removed in got)


def test_shared_passages(docs):
    docs = docs.where("length(text) < 60000 or text is null")
    _same_passages(repeats.dedup(docs), texts(docs))


@pytest.mark.parametrize("letters", ["a", "abcdefghij"])
def test_passages_of_short_words(spark, letters):
    """51 words are told however short they are; what only one text repeats, or two halves from two texts, is not."""
    import random

    r = random.Random(9)
    prose = lambda n: [f"{i}{''.join(r.choice(letters) for _ in range(r.randint(0, 3)))}" for i in r.sample(range(10_000), n)]
    rows, want = [], {}

    def add(*parts, words=0):
        rows.append((len(rows), r.choice([" ", "\n", " \t"]).join(sum(parts, []))))
        want[len(rows) - 1] = words

    for n in (47, 48, 51, 52, 60, 75, 130):
        p = prose(n)
        for k in range(3):
            add(prose(r.randint(0, 70)), p, prose(r.randint(0, 70)), words=n if n > 47 else 0)
    p, q = prose(40), prose(40)
    for parts in ([p, q], [p, prose(40)], [prose(40), q]):
        add(*parts)
    p = prose(60)
    add(prose(9), p, prose(30), p, prose(9))
    p = prose(100)  # a text holds a passage with two neighbourhoods, another one of them
    a, b = prose(30), prose(30)
    add(a, p, prose(20), b, p, prose(20), words=130)
    add(a, p, words=130)
    add(p[20:80], words=60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = repeats.dedup(docs)
    assert {x.doc_id: x.shared_words for x in out.collect()} == want
    _same_passages(out, rows)


def test_passages_of_edited_copies(spark):
    """Copies with edits, moved parts, repeats within a text and equal rows, against tables of all windows."""
    import random

    r = random.Random(10)
    for _ in range(4):
        base = [r.choice("abcdefghijklmnop") * r.randint(1, 2) for _ in range(500)]
        rows = []
        for i in range(40):
            a = r.randrange(300)
            w = base[a : a + r.randint(30, 260)]
            for _ in range(r.choice([0, 0, 1, 4])):
                w[r.randrange(len(w))] = f"edit{i}"
            rows.append((i % 37, " ".join(w + r.choice([[], w[:60], base[:90]]))))
        rows += [(500, "x y " * 60), (501, "same words " * 2), (502, rows[0][1]), (0, rows[0][1])]
        _same_passages(repeats.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), rows)


def test_suffix_dedup_of_edited_copies_and_runs(spark):
    import random

    r = random.Random(4)
    base = "".join(r.choice("abcdefg hij") for _ in range(2500))
    rows = [(i, base[r.randrange(600) : 1200 + r.randrange(1300)] if i % 3 else base[: 900 + i] + "#" * i + base[950 + i :]) for i in range(30)]
    rows += [(100, "z" * 1500), (101, "ab" * 700), (102, "ab" * 700 + "c" * 399), (103, "c" * 400), (104, "q" * 399), (104, "q" * 399)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _bytes_left(rows)
    assert _got_bytes(repeats.dedup(docs)) == want
    assert _got_bytes(repeats.dedup(docs, 1)) == want


def _sketch(t, k=5):
    w = WORD.findall(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_fingerprints(docs, spark):
    rows = [(r.doc_id, r.text or "", r.h) for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) h").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]), reverse=True)
    want = Counter()
    for (i, t, _), (_, nxt, _) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k] if k else t
        want[i, len(t), sha(edited)] += 1
    got = fingerprint.fingerprints(docs, bytes_each=20_000).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.fingerprint].add(r.edited_sha256 if r.n_chars == 0 else None)
    errors = []
    for (i, t, _), (_, nxt, _) in zip(rows, rows[1:] + rows[:1]):
        a, b = _sketch(t), _sketch(t[: len(t) - len(t) // 3] + nxt[: len(t) // 3] if len(t) // 3 else t)
        if len(a | b) > 200 and i is not None:
            near = [r.near_edited for r in got if r.doc_id == i and r.n_chars == len(t)]
            errors.append(min(abs(x - len(a & b) / len(a | b)) for x in near))
    assert not errors or np.mean(errors) < 0.08


def _from_string(fp):
    head, body = fp.rsplit(":", 1)
    return head, {body_[i : i + 8] for body_ in [base64.b64decode(body)] for i in range(0, len(body_), 8)}


def test_fingerprints_of_neighbours_at_the_ends_of_the_id_range(spark):
    """An outlier, both ends of the long range, a null id and equal ids; near_next is what the two fingerprints say."""
    ids = [*range(300), 1 << 60, (1 << 63) - 1, -(1 << 63), None, 77, 77]
    rows = [(i, " ".join(f"w{(n * 7 + j) % (40 + n % 9)}" for j in range(200 + n % 50))) for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(((r.doc_id if r.doc_id is not None else -(1 << 63), r.c, r.text) for r in docs.selectExpr("doc_id", "text", "xxhash64(text) c").collect()), reverse=True)
    want = Counter()
    for (_, _, t), (_, _, nxt) in zip(order, order[1:] + order[:1]):
        want[sha(t[: len(t) - len(t) // 3] + nxt[: len(t) // 3])] += 1
    got = fingerprint.fingerprints(docs, bytes_each=8_000).collect()
    assert Counter(r.edited_sha256 for r in got) == want
    by = {}
    for (i, c, t), r in zip(order, sorted(got, key=lambda r: (r.doc_id if r.doc_id is not None else -(1 << 63)), reverse=True)):
        by[i] = r
    for (i, _, _), (j, _, _) in zip(order, order[1:]):
        if 77 in (i, j) or -(1 << 63) in (i, j):
            continue
        (_, a), (_, b) = _from_string(by[i].fingerprint), _from_string(by[j].fingerprint)
        assert abs(by[i].near_next - len(a & b) / len(a | b)) < 1e-12
    rows = docs.selectExpr("coalesce(doc_id, -9223372036854775808L) i", "text", "xxhash64(text) c")
    spread = Counter(p[0] for p in fingerprint._destinations(fingerprint._ranges(rows, 8_000), *(np.array(x, np.int64) for x in zip(*[(r.i, r.c) for r in rows.collect()]))))
    assert len(spread) > 5 and max(spread.values()) < 4 * len(ids) / len(spread)


def test_fingerprints_merge_and_contain():
    a, b = " ".join(f"a{i}" for i in range(4000)), " ".join(f"b{i}" for i in range(4000))
    x, y, z = (fingerprint.to_text(*s) for s in fingerprint.sketch_all([a, b, a + " " + b]))
    assert fingerprint.containment(x, z) == 1.0 and fingerprint.containment(x, y) == 0.0
    assert fingerprint.containment(fingerprint.merge(x, y), z) == 1.0


def test_sentences_rebuild_the_text(docs):
    for _, t in texts(docs):
        begins, counts = spans.sentences(t)
        assert "".join(t[a:b] for a, b in zip(begins, begins[1:] + [len(t)])) == t
        assert sum(counts) == len(t.split())


def test_substring_dedup(docs):
    rows = sorted({(i is not None, i or 0, t) for i, t in texts(docs)})
    tag = {r.text: r.h for r in docs.selectExpr("coalesce(text, '') as text", "hash(coalesce(text, '')) h").collect()}
    rows.sort(key=lambda r: (r[0], r[1], tag[r[2]]))
    seen, want = {}, Counter()
    for r in rows:
        for p, h in enumerate(spans.runs(r[2])[0]):
            seen.setdefault(h, (r, p))
    for i, t in texts(docs):
        r = (i is not None, i or 0, t)
        begins, _ = spans.sentences(t)
        gone = set()
        for p, (h, size) in enumerate(zip(*spans.runs(t))):
            if seen[h] != (r, p):
                gone.update(range(p, p + size))
        want[i, len(begins), len(gone), sha("".join(t[a:b] for j, (a, b) in enumerate(zip(begins, begins[1:] + [len(t)])) if j not in gone))] += 1
    got = spans.dedup(docs).collect()
    assert Counter((r.doc_id, r["__sentences"], r["__removed"], sha(r.text or "")) for r in got) == want


def test_a_shared_passage_stays_once(odd):
    got = {r.doc_id: r.text for r in spans.without_repeats(odd).collect()}
    assert "hundred years" in got[9] and "hundred years" not in got[10] and "Before it." in got[10] and 14 not in got


def test_passages_of_51_words_are_found_wherever_they_stand():
    import random

    r = random.Random(3)
    word = lambda: f"w{r.randrange(4000)}" + r.choice(["", "", "", "", "", "", "", "", "", ",", "."])
    for few in (False, True):
        for _ in range(300):
            passage = [r.choice(["a", "b"]) if few else word() for _ in range(51)]
            one, two = ([word() for _ in range(r.randrange(60))] + passage + [word() for _ in range(r.randrange(60))] for _ in range(2))
            a, b = " ".join(one), " ".join(two)
            known = set(spans.runs(a)[0])
            left = spans.cut(b, [p for p, h in enumerate(spans.runs(b)[0]) if h in known])[0]
            assert len(two) - len(left.split()) >= 51 - 3 * spans.WINDOW
            assert max(spans.sentences(b)[1]) <= spans.WINDOW


def test_packing(docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.BYTES)
    docs = docs.select("doc_id", "text").unionAll(docs.limit(1).selectExpr("-5L", "'a <|endoftext|> b'"))
    rows = Counter()
    ids_of = defaultdict(list)
    for i, t in texts(docs):
        ids = [*own.encode(t, add_special_tokens=False).ids, 1]
        ids_of[i].append(np.array(ids, "<u4"))
        rows[i, len(ids)] += 1
    got = packing.pack(docs, queries.BYTES).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == rows
    sequences, total = defaultdict(list), 0
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids_of[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
        total += r.length
    assert total == sum(n * c for (_, n), c in rows.items())
    waste = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
        waste += 0 if at & (at - 1) == 0 else 2048 - at
    assert waste <= 0.02 * total + 2048 * docs.rdd.getNumPartitions()


def test_cuts_are_the_best_ones():
    r = np.random.default_rng(2)
    for _ in range(60):
        at = np.concatenate([[0], np.cumsum(r.integers(1, 9, 12))])
        pen = np.concatenate([[0], r.integers(0, 4, 12)]).astype(float)
        pad = lambda n: 0 if n & (n - 1) == 0 else 16 - n
        best = [0.0] + [math.inf] * 12
        for j in range(1, 13):
            best[j] = min((best[i] + pad(int(at[j] - at[i])) + pen[j] for i in range(j) if at[j] - at[i] <= 16), default=math.inf)
        cuts = packing.best_cuts(at, pen, 16)
        assert sum(pad(int(at[b] - at[a])) + pen[b] for a, b in zip(cuts, cuts[1:])) == best[-1]


def test_sharding(docs):
    rows = Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts(docs))
    got = sharding.kd_tree(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == rows
    slots, load = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    if len(got) > 100:
        largest = max(r["size"] for r in got)
        assert max(load.values()) - min(load.values()) <= 2 * largest


def test_equal_rows_spread_over_all_shards(spark):
    docs = spark.range(10_000).selectExpr("5L as doc_id", "'one text' as text", "'en' as lang", "'a' as source")
    load = Counter(r.shard for r in sharding.kd_tree(docs).collect())
    assert len(load) == 24 and max(load.values()) - min(load.values()) <= 2
    one = spark.range(3000).selectExpr("if(id % 3 = 0, 1L, id) as doc_id", "repeat('x', int(id % 50)) as text", "cast(null as string) as lang", "'a' as source")
    size = sharding.kd_tree(one, leaves=100).groupBy("shard").agg({"size": "sum"}).collect()
    assert len(size) == 100 and max(r[1] for r in size) - min(r[1] for r in size) <= 4 * 58


def test_shards_reach_the_target_bytes(spark, sf):
    got = sharding.kd_tree(table(spark, sf, "documents"), target_bytes=60_000).groupBy("shard").agg({"size": "sum"}).collect()
    total = sum(r[1] for r in got)
    assert len(got) == -(-total // 60_000)


def test_both_encoders_of_the_byte_vocabulary_agree():
    import random

    from tokenizers import Tokenizer

    own, model, r = Tokenizer.from_file(queries.BYTES), packing.load(queries.BYTES), random.Random(1)
    assert model.encode("a <|endoftext|> b").tolist() == own.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    bits = [" ", "  ", "\n", "\t", " ", "\xa0", "é", "漢", "😀", "a", "B", "1", "²", "Ⅷ", "'s", "’s", "'LL", "<|endoftext|>", "...", "\x00", "​", "ß", "é", "٣", "\r\n", "_", "\x85", "\x1c"]
    cases = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(3000)] + [" " * 3000 + "x", "a b " * 300_000]
    for text, want in zip(cases, own.encode_batch(cases, add_special_tokens=False)):
        assert model.encode(text).tolist() == want.ids
