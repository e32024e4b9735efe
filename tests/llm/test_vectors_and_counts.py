"""Token counts, centroid clustering and hard negatives against plain restatements."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from driftrank.llm import clusters, negatives, queries, token_counts, vectors
from driftrank.tables import table
from tests.llm.conftest import texts

NAN, INF = float("nan"), float("inf")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.WORDS)


def want_counts(docs):
    own = library()
    return Counter((i, len(t.encode()), n, n > 2048) for i, t in texts(docs) for n in [len(own.encode(t, add_special_tokens=False).ids)])


@pytest.mark.parametrize("which", ["documents", "odd", "empty"])
def test_token_counts(which, spark, sf, odd, empty):
    docs = {"documents": lambda: table(spark, sf, "documents"), "odd": lambda: odd, "empty": lambda: empty}[which]()
    assert Counter(map(tuple, token_counts.count_tokens(docs, queries.WORDS).collect())) == want_counts(docs)


def test_token_counts_of_other_files(odd):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd, queries.PIECES).collect())
    assert got == Counter((i, len(own.encode(t))) for i, t in texts(odd))
    assert isinstance(token_counts.load(queries.BYTES), token_counts.Library)


def test_word_counts_against_the_library_on_random_text():
    model, r = token_counts.load(queries.WORDS), random.Random(7)
    assert isinstance(model, token_counts.FoldedBpe)
    bits = [" ", "  ", "a", "b", "the", "'", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "\n", "\t", "é", "É", "①", "²", "½", "ª", "º", "µ", "ß", "×", "÷", "\xa0", "\x85", "\xad", "\x00", "\x1c", "漢", "…", ".", "ING", "😀", "1", "23", "<|endoftext|>", "<|ENDOFTEXT|>", "J̌", "ǰ", "ΑΣ", "\x0b", "À", "ÿ", "İ", "¿", "x" * 70]
    narrow = [b for b in bits if max(b) <= "\xff"]
    many = ["".join(r.choice(narrow if k % 2 else bits) for _ in range(r.randint(0, 30))) for k in range(4000)]
    assert model.counts(many) == model.library.counts(many)


def test_normal_form_never_joins_texts_of_different_counts(spark):
    pairs = ["A b", "a  B\n", "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|> x", "J̌", "ǰ", "ΑΣ", "ας", "ΑΣ ", "İ", "i̇", "É", "é", " a ", "a"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(pairs)], "i int, text string").withColumn("d", token_counts.digest(F.col("text"), queries.WORDS)).collect()
    own, seen = library(), {}
    for r in rows:
        n = len(own.encode(r.text, add_special_tokens=False).ids)
        assert seen.setdefault(bytes(r.d), n) == n, r.text
    assert rows[0].d == rows[1].d and rows[14].d == rows[15].d


def test_cache_is_read_and_added_to(spark, tmp_path):
    cache = str(tmp_path / "cache")
    a = spark.createDataFrame([(1, "one two"), (2, "One  two"), (3, None)], "doc_id long, text string")
    token_counts.count_tokens(a, queries.WORDS, cache).collect()
    v = token_counts.version(queries.WORDS)
    first = token_counts.stored(spark, cache, v)
    assert first.count() == 2  # one text in two spellings, and the empty one
    # What the cache says is taken, not counted again: a changed count comes back, and another version is not read.
    changed = str(tmp_path / "changed")
    first.select(F.lit(v).alias("version"), "digest", F.lit(99).cast("long").alias("n_tokens")).write.parquet(changed)
    b = a.union(spark.createDataFrame([(4, "three"), (5, "three")], "doc_id long, text string"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(b, queries.WORDS, changed).collect()}
    assert got == {1: 99, 2: 99, 3: 99, 4: 1, 5: 1}
    assert token_counts.stored(spark, changed, v).count() == 3 and spark.read.parquet(changed).count() == 3
    assert 99 not in {r.n_tokens for r in token_counts.count_tokens(a, queries.PIECES, changed).collect()}
    assert token_counts.stored(spark, changed, token_counts.version(queries.PIECES)).count() == 3  # this file doesn't fold case


VECTORS = [
    (1, [0.5] * 64, 1), (2, None, 1), (3, [0.5] * 63, 1), (4, [0.5] * 63 + [NAN], 1), (5, [0.5] * 63 + [INF], 1), (6, [0.5] * 63 + [None], 1), (7, [0.5] * 64, 6), (None, [0.25] * 64, 2),
    (8, [3e38] * 64, 1), (9, [], 1), (100, [0.5] * 64, 1), (100, [0.5] * 64, 1), (100, [0.4] * 64, 2), (200, [-0.5] * 64, None), (300, [-0.5] * 64, 3), (400, [0.0] * 64, 3), (0, [1e-9] * 64, 0),
    *[(1000 + i, [((i * j * 37) % 101 - 50) / 100 for j in range(64)], i % 10) for i in range(150)], *[(5000, [0.125] * 64, 4)] * 90,
]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rows = [(i, v, label, "x", 1, 2, 3) for i, v, label in VECTORS]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cluster string, unit int, v int, place int").repartition(3)


def as_whole(v, factor):
    out = [int(np.floor(np.float64(np.float32(x)) * factor)) for x in v]
    return out if all(abs(x) <= vectors.LARGEST for x in out) else None


def finite(v):
    return v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)


def want_clusters(rows, k=16, rounds=3):
    kept = [(i, as_whole(v, 64)) for i, v in rows if finite(v) and len(v) == 64]
    kept = [(i, v) for i, v in kept if v]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    placed = [(i, *near(v)[::-1]) for i, v in kept]
    per = Counter()
    for _, j, d in placed:
        per[j] += d
    return Counter((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in placed)


def test_clusters(spark, odd_vectors):
    assert Counter(map(tuple, clusters.cluster(odd_vectors).collect())) == want_clusters([(i, v) for i, v, _ in VECTORS])
    few = odd_vectors.where("vec_id < 8")
    assert Counter(map(tuple, clusters.cluster(few).collect())) == want_clusters([(i, v) for i, v, _ in VECTORS if i is not None and i < 8])
    assert not clusters.cluster(odd_vectors.limit(0)).count()


def test_balls_decide_what_exact_distances_do():
    """On rows in groups most balls go whole; sums, counts and places equal those of all distances, ties to the smaller number."""
    r = np.random.default_rng(3)
    for spread, k in ((2, 5), (40, 7), (0, 3)):
        centers = r.integers(-100, 100, (6, 16))
        rows = centers[r.integers(0, 6, 1500)] + r.integers(-spread, spread + 1, (1500, 16))
        centroids = np.concatenate([centers[: k - 1], centers[:1]])  # the last equals the first
        order, sums, means, radii = clusters.grow(rows)
        assert sorted(order.tolist()) == list(range(1500))
        tree = clusters.Tree(1500, vectors.pack(rows[order]), vectors.pack(sums), means.tobytes(), radii.tobytes(), 16)
        at, far = tree.assign(centroids)
        d = ((rows[order][:, None, :] - centroids[None]) ** 2).sum(2)
        assert (at == d.argmin(1)).all() and (far == d.min(1)).all()
        total, count = tree.totals(centroids)
        assert (count == np.bincount(at, minlength=k)).all() and all((total[j] == rows[order][at == j].sum(0)).all() for j in range(k))
        if spread == 2:
            whole, leaves = tree.filter(centers)
            assert sum(b - a for _, a, b, _ in whole) > 1000 > sum(b - a for a, b in leaves)
    for n in (1, 2, 31, 33, 64, 65, 1000):
        order, sums, means, radii = clusters.grow(r.integers(-5, 5, (n, 3)))
        assert sorted(order.tolist()) == list(range(n)) and len(sums) == len(means) == len(radii) == (2 << clusters.levels_of(n)) - 1


def want_negatives(rows, positives=5, k=10, low=30, high=90):
    kept = [(i, label, as_whole(v, 256)) for i, v, label in rows if label is not None and finite(v)]
    kept = [r for r in kept if r[2] is not None]
    out = Counter()
    last = lambda i: (i is None, i)
    for a, anchor in enumerate(kept):
        if anchor[0] is None or anchor[0] % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(anchor[2], r[2])), last(r[0]), r[1]) for b, r in enumerate(kept) if a != b), key=lambda s: s[:2])
        for s, p, _ in [s for s in scored if s[2] == anchor[1]][:positives]:
            found = [n for n in scored if n[2] != anchor[1] and low * -s <= 100 * -n[0] <= high * -s][:k]
            out.update((anchor[0], p[1], j + 1, n[1][1], -s, -n[0]) for j, n in enumerate(found))
    return out


@pytest.mark.parametrize("blocks", [(256, 8192), (2, 7)])
def test_hard_negatives(spark, odd_vectors, blocks, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", blocks[0])
    monkeypatch.setattr(negatives, "ROWS", blocks[1])
    got = Counter(map(tuple, negatives.mine(odd_vectors, F.col("vec_id") % 100 == 0).collect()))
    assert got == want_negatives(VECTORS) and len(got) > 20
    assert not negatives.mine(odd_vectors.limit(0), F.col("vec_id") % 100 == 0).count()


def test_large_components_stay_exact():
    a = np.array([[1 << 27, -(1 << 27)] * 32, [3] * 64], np.int64)
    assert vectors.inner(a, a)[0, 0] == 64 << 54 and vectors.inner(a, a)[1, 1] == 576
    b = np.array([[-200_000, 7, 1]], np.int64)
    assert (vectors.unpack(vectors.pack(b)) == b.ravel()).all()
