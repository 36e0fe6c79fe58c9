import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.llm import cover_tree, learned_partitions
from evidra.llm.cover_tree import CoverTree, dual_search

SCHEMA = "vec_id long, embedding array<float>, label int"


def is_query():
    return F.col("vec_id") % 5 == 0


def vectors(n, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    return [(i, [float(x) for x in np.float32(centres[i % 6] + 0.3 * rng.standard_normal(dim))], 1) for i in range(n)]


def odd_rows():
    return [(9001, None, 0), (9005, [None] * 8, 0), (9010, [float("nan")] * 8, 0), (9015, [float("inf")] + [0.0] * 7, 0), (None, [1.0] * 8, 0), (9020, [1.0, 2.0], 0)]


def usable(rows):
    return [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]


def brute_top(rows, k):
    known = [(i, [int(x) for x in np.floor(256 * v)]) for i, v in usable(rows)]
    out = set()
    for i, q in known:
        if i % 5 == 0:
            best: dict = {}
            for j, v in known:
                if j != i and len(v) == len(q):
                    best[j] = max(best.get(j, -(2**70)), sum(a * b for a, b in zip(q, v, strict=True)))
            out |= {(i, n + 1, j, s) for n, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])}
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 64)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", 16)
    rows = vectors(300) + odd_rows() + [(400 + i, vectors(1)[0][1], 0) for i in range(150)]  # many equal vectors
    got = {tuple(r) for r in cover_tree.top_k(spark.createDataFrame(rows, SCHEMA), is_query()).collect()}
    assert got == brute_top(rows, 5)


def test_many_blocks_with_few_roots_in_a_row(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "ROOTS", 1)
    monkeypatch.setattr(cover_tree, "BLOCK", 10)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", 5)
    rows = vectors(60)
    assert {tuple(r) for r in cover_tree.top_k(spark.createDataFrame(rows, SCHEMA), is_query()).collect()} == brute_top(rows, 5)


def test_top_k_of_few_repeated_and_no_rows(spark):
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [0.5, 0.5], 1), (1, [2.0, 0.0], 1)]
    got = {tuple(r) for r in cover_tree.top_k(spark.createDataFrame(rows, SCHEMA), is_query()).collect()}
    assert got == {(0, 1, 1, 512 * 256)}
    assert cover_tree.top_k(spark.createDataFrame([], SCHEMA), is_query()).count() == 0


def test_tree_covers_its_points_and_prunes():
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((2000, 4)) * 50)
    tree = CoverTree(x)
    assert sorted(tree.order) == list(range(2000))
    for (lo, hi), c, r in zip(tree.run, tree.centre, tree.radius, strict=True):
        assert np.sqrt(((x[tree.order[lo:hi]] - c) ** 2).sum(1)).max() <= r + 1e-9
    q = x[:50]
    got = {(a, b, s) for a, b, s in dual_search(q, np.arange(50), np.full(50, -np.inf), x, np.arange(2000), 3)}
    want = set()
    for i in range(50):
        s = x @ q[i]
        s[i] = -np.inf
        want |= {(i, int(j), int(s[j])) for j in np.lexsort((np.arange(2000), -s))[:3]}
    assert got == want


def test_scores_beyond_double_precision():
    x = np.array([[2**28, 1], [2**28, 2], [2**28, 3]], np.float64)
    got = dual_search(x, np.arange(3), np.full(3, -np.inf), x, np.arange(3), 1)
    assert [(a, b) for a, b, _ in got] == [(0, 2), (1, 2), (2, 1)]
    assert all(s == int(x[a, 0]) * int(x[b, 0]) + int(x[a, 1]) * int(x[b, 1]) for a, b, s in got)


@pytest.mark.parametrize("n", [40, 3000])
def test_neighbours_have_exact_scores_and_recall(spark, n):
    rows = vectors(n, seed=3) + odd_rows() + [(8000 + i, [2.0] * 8, 0) for i in range(60)] + [(9100, [0.0] * 8, 0)]
    got = learned_partitions.search(spark.createDataFrame(rows, SCHEMA), is_query()).collect()
    known = {i: v for i, v in usable(rows) if v.any()}
    cos = lambda a, b: float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
    found = total = 0
    by_query: dict = {}
    for r in got:
        assert abs(r.score - cos(known[r.query_id], known[r.vec_id])) < 1e-12 and r.query_id != r.vec_id
        by_query.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by_query) == {i for i in known if i % 5 == 0 and sum(len(v) == len(known[i]) for v in known.values()) > 1}
    for q, hits in by_query.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, len(hits) + 1))
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(hits, hits[1:], strict=False))
        true = sorted((-round(cos(known[q], v), 12), j) for j, v in known.items() if j != q and len(v) == len(known[q]))[:5]
        found += len({j for _, j in true} & {h[1] for h in hits})
        total += len(true)
    assert found / total >= 0.9


def test_neighbours_of_no_rows_and_scaled_vectors(spark):
    assert learned_partitions.search(spark.createDataFrame([], SCHEMA), is_query()).count() == 0
    rows = [(0, [1e200, 0.0]), (1, [1e-200, 1e-200]), (2, [3e150, 0.0]), (3, [-1.0, 0.0])]
    got = learned_partitions.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), is_query()).collect()
    assert [(r.vec_id, round(r.score, 9)) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 1.0), (1, round(0.5**0.5, 9)), (3, -1.0)]


def test_clustered_vectors_are_pruned():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16)) * 200
    x = np.round(centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16)))
    q, stats = x[::40], {}
    got = {(a, b, s) for a, b, s in dual_search(q, np.arange(0, 4000, 40), np.full(100, -np.inf), x, np.arange(4000), 5, stats)}
    want = set()
    for a in range(0, 4000, 40):
        s = x @ x[a]
        s[a] = -np.inf
        want |= {(a, int(b), int(s[b])) for b in np.lexsort((np.arange(4000), -s))[:5]}
    assert got == want and stats["scored"] < 0.25 * 100 * 4000


def test_mass_repeated_id_and_row(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 32)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", 16)
    many = vectors(200, seed=4)
    rows = vectors(100) + [(11, v, 1) for _, v, _ in many] + [many[3]] * 300
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in cover_tree.top_k(df, is_query()).collect()} == brute_top(rows, 5)
    found = learned_partitions.search(df, is_query()).collect()
    assert {r.query_id for r in found} == {i for i in range(0, 100, 5)} and all(r.query_id != r.vec_id for r in found)
    assert len({(r.query_id, r.vec_id) for r in found}) == len(found)


def recall(rows, found, k=5):
    x = np.array([v for _, v, _ in rows])
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = {}
    for r in found:
        near.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in near:
        s = u @ u[q]
        s[q] = -np.inf
        hits += len(near[q] & set(np.argsort(-s, kind="stable")[:k].tolist()))
    return hits / (k * len(near))


@pytest.mark.parametrize("n", [3000, 24_000])
def test_recall_at_two_sizes_with_growing_parts(spark, monkeypatch, n):
    monkeypatch.setattr(learned_partitions, "PART_ROWS", 250)
    rows = vectors(n, dim=16, seed=7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    found = learned_partitions.search(df, F.col("vec_id") % 50 == 0).collect()
    assert len({r.query_id for r in found}) == n // 50 and recall(rows, found) >= 0.9


def test_recall_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, 0) for r in df.orderBy("vec_id").collect()]
    assert recall(rows, learned_partitions.search(df, F.col("vec_id") % 50 == 0).collect()) >= 0.9
