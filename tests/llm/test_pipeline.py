"""The pipeline's stages, each on its predecessor's result."""

from collections import Counter

import pytest

from driftrank.llm import spans
from driftrank.tables import park, table
from tests.llm.conftest import texts
from tests.llm.test_operators import _classes, _measures

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def results(spark, sf):
    out = [table(spark, sf, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(park(stage(spark, out[-1], sf), name.replace(" ", "-")))
    return out


def test_columns_and_rows_follow(results):
    docs, good, single, cut, packed = results
    assert docs.columns == good.columns == single.columns == cut.columns
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in results]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4]


def test_quality_drops_what_the_base_rules_reject(results):
    docs, good = results[:2]
    base = {i for i, t in texts(docs) if (m := _measures(t))[0] >= 10 and 100 * m[4] <= 20 * m[0]}
    kept = {r.doc_id for r in good.collect()}
    assert kept <= base and len(kept) > 0.9 * len(base)


def test_one_document_of_each_group_stays(results):
    _, good, single = results[:3]
    assert {r.doc_id for r in single.collect()} == {root for _, _, root in _classes(texts(good), 5, 80)}


def test_no_run_is_left_twice(results):
    single, cut = results[2:4]
    before = Counter(h for _, t in texts(single) for h in spans.runs(t)[0])
    assert max(before.values()) > 1
    first = {}
    for i, t in sorted(texts(single)):
        for h in spans.runs(t)[0]:
            first.setdefault(h, i)
    left = {i: t for i, t in texts(cut)}
    assert all(i in left for i in first.values())
    assert sum(len(t) for t in left.values()) < sum(len(t) for _, t in texts(single))


def test_run_packs_what_the_stages_leave(results, spark, sf):
    key = lambda df: Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.where("start = 0").collect())
    got = corpus_pipeline.run(spark, sf)
    assert {(i, n) for i, _, _, _, n in key(got)} == {(i, n) for i, _, _, _, n in key(results[-1])}


def test_stages_take_odd_rows(odd, empty, spark, sf):
    for start in (odd, empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = park(stage(spark, docs, sf), "odd")
        docs.count()


def test_stages_take_clashing_names(odd, spark, sf):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").selectExpr("*", *[f"'own' as {c}" for c in ("__n", "__n_words", "__gone", "__places", "__tag", "__kept", "__removed")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = park(out, "clash")
        assert {tuple(r)[5:] for r in docs.collect()} <= {("own",) * 7}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()
