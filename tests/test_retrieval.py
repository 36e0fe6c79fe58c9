import math

import pytest

from evidra.operators import diff
from evidra.operators import retrieval as r


def ranking(spark, rows):
    return spark.createDataFrame(rows, "version_id string, node_id string, rank int")


def test_fusion_of_opposite_rankings_is_a_tie(spark):
    a, b = ranking(spark, [("v", "a", 1), ("v", "b", 2), ("v", "a", 3)]), ranking(spark, [("v", "b", 1), ("v", "a", 2)])
    got = {x.node_id: x.score for x in r.rrf([a, b]).collect()}
    assert got["a"] == pytest.approx(got["b"]) == pytest.approx(1 / 61 + 1 / 62)
    with pytest.raises(ValueError):
        r.rrf([a], k=0)


def test_bm25_is_scoped_to_its_version(spark):
    rows = [("v1", "a", "trial of drug drug"), ("v1", "b", "other words"), ("v2", "c", "drug"), ("v1", "d", "。。")]
    nodes = spark.createDataFrame(rows, "version_id string, node_id string, text string")
    got = {(x.version_id, x.node_id): x.score for x in r.bm25_scores(nodes, ["drug", "none"]).collect()}
    idf = math.log(1 + (2 - 1 + 0.5) / 1.5)
    assert got == {("v1", "a"): pytest.approx(idf * 2 / (2 + 1.5 * (0.25 + 0.75 * 4 / 3))), ("v2", "c"): pytest.approx(math.log(1 + 0.5 / 1.5) / (1 + 1.5))}
    assert r.bm25_scores(nodes, []).count() == 0
    twice = {x.node_id: x.score for x in r.bm25_scores(nodes, ["drug", "drug"]).collect()}
    assert twice["a"] == pytest.approx(2 * got["v1", "a"])
    postings, stats = r.build_inverted_index(nodes)
    asked = spark.createDataFrame([(1, "drug"), (1, "none")], "query_id int, token string")
    assert {(x.version_id, x.node_id): pytest.approx(x.score) for x in r.bm25_batch(postings, stats, asked, 5).collect()} == got


def test_coverage_puts_each_guideline_first(spark):
    rows = [("a", "n1", 0.9), ("a", "n2", 0.8), ("b", "n3", 0.1), ("a", "n4", 0.7)]
    df = spark.createDataFrame(rows, "guideline_id string, node_id string, score double")
    names = lambda top, order: [x.node_id for x in sorted(r.with_coverage(df, order, top).collect(), key=lambda x: x.position)]
    assert names(3, ["b", "a", "b"]) == ["n3", "n1", "n2"]
    assert names(1, ["b", "a"]) == ["n1"]


def test_versions_are_resolved_and_checked(spark):
    versions = spark.createDataFrame([("v1", "g1", "active"), ("v0", "g1", "superseded"), ("v2", "g2", "active"), ("v3", "g2", "draft")], "id string, guideline_id string, status string")
    guidelines = spark.createDataFrame([("g1", "zh"), ("g2", "en")], "id string, language string")
    get = lambda **k: r.resolve_versions(versions, guidelines, r.SearchRequest("q", **k))
    assert get() == [("v1", "g1"), ("v2", "g2")] and get(language="en") == [("v2", "g2")] and get(guideline_ids=("none",)) == []
    assert get(version_ids=("v0",)) == [("v0", "g1")]
    for wrong, error in (({"version_ids": ("v3",)}, ValueError), ({"version_ids": ("x",)}, KeyError), ({"version_ids": ("v1",), "guideline_ids": ("g2",)}, ValueError), ({"top_k": 0}, ValueError), ({"version_ids": ("v1", "v1")}, ValueError)):
        with pytest.raises(error):
            get(**wrong)
    with pytest.raises(ValueError):
        r.resolve_versions(versions, guidelines, r.SearchRequest(" "))


def test_version_diff(spark):
    kind = "id string, chunk_id string, text string"
    prior = spark.createDataFrame([("p1", "c1", "same  text"), ("p2", "c2", "old"), ("p3", "c3", "gone")], kind)
    current = spark.createDataFrame([("n1", "c1", "same text"), ("n2", "c2", "new"), ("n4", "c4", "added")], kind)
    got = {x.chunk_id: (x.change_type, x.prior_raw_chunk_id, x.current_raw_chunk_id) for x in diff.compare(prior, current, "a", "b").collect()}
    assert got == {"c1": ("unchanged", "p1", "n1"), "c2": ("modified", "p2", "n2"), "c3": ("removed", "p3", None), "c4": ("added", None, "n4")}
    with pytest.raises(ValueError, match="duplicate"):
        diff.compare(prior.union(prior), current, "a", "b")
    with pytest.raises(ValueError, match="differ"):
        diff.compare(prior, current, "a", "a")
