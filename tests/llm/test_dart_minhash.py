import math
import random
import re
import tracemalloc
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest

from evidra.llm import dart_minhash as dm
from evidra.llm import queries, spm_trie

SCHEMA = "doc_id long, text string"


def words(text):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", text)]


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute(rows):
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [(i, t, shingles(t) if t is not None else None) for i, t in rows if i is not None]
    for n, (i, t, s) in enumerate(known):
        for j, u, v in known[:n]:
            same = t is not None and t == u
            near = s is not None and v is not None and len(s & v) >= 0.8 * len(s | v)
            if same or near:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, prose, seed):
    r = random.Random(seed)
    rows = []
    for g in range(12):
        base = prose(r.choice([4, 30, 120, 300]), 100 * seed + g).split()
        for _ in range(r.randint(1, 8)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = "edited"
            rows.append((len(rows) * 3, " ".join(copy)))
    rows += [(1001, None), (1002, None), (1003, ""), (1004, ""), (1005, "***"), (1006, "!!!"), (1007, "***"), (1010, "One two"), (1011, "one, TWO!")]
    got = {r.doc_id: r.class_id for r in dm.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_large_group_without_one_hub(spark, prose, monkeypatch):
    """A chain: neighbours are near, ends are not, so no hub reaches all; and blocks are made small."""
    monkeypatch.setattr(dm, "BLOCK", 4)
    base = prose(150, 5).split()
    rows = [(i, " ".join(base[2 * i : 2 * i + 60])) for i in range(40)]
    got = {r.doc_id: r.class_id for r in dm.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    same, total = [], []
    for _ in range(20):
        element = rng.integers(0, 2**63, 300, dtype=np.uint64)
        w = rng.uniform(0.2, 6, (2, 300))
        s = dm.signatures(np.tile(element, 2), w.ravel(), np.array([0, 300, 600]))
        same.append((s[0] == s[1]).mean())
        total.append(np.minimum(*w).sum() / np.maximum(*w).sum())
    assert abs(np.mean(same) - np.mean(total)) < 0.03
    assert (dm.signatures(element, w[0], np.array([0, 300])) == dm.signatures(element[::-1], w[0][::-1], np.array([0, 300]))).all()


def test_signature_filter_loses_less_than_the_bands():
    least = math.ceil(dm.MAYBE * dm.K)
    lost = sum(math.comb(dm.K, i) * 0.8**i * 0.2 ** (dm.K - i) for i in range(least))
    assert lost < 0.01 * (1 - 0.8**dm.ROWS) ** dm.BANDS


def test_null_ids_empty_table_and_deduplicate(spark, prose):
    assert dm.classes(spark.createDataFrame([], SCHEMA)).count() == 0
    long = prose(30_000, 3)
    rows = [(5, "a b c d e f", "x"), (3, "a b c d e f", "y"), (None, "a b c d e f", "z"), (7, long, "l"), (8, long + " end", "m"), (9, None, "n"), (9, None, "n")]
    df = spark.createDataFrame(rows, SCHEMA + ", class_id string")
    got = {(r.doc_id, r.class_id) for r in dm.classes(df).collect()}
    assert got == {(5, 3), (3, 3), (None, None), (7, 7), (8, 7), (9, 9)}
    kept = dm.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.class_id) for r in kept.collect()) == [(0, "z"), (3, "y"), (7, "l"), (9, "n")]


def test_ids_with_different_texts(spark, prose):
    a, b, c = prose(80, 11), prose(80, 12), prose(80, 13)
    rows = [
        (9, a, "a"), (9, b, "b"), (9, None, "null"), (9, a, "a"),  # an id with three contents, one repeated
        (3, b, "b3"), (12, b + " end", "b12"),  # b's class is named 3
        (20, c, "c20"), (20, a + " end", "a20"), (21, c + " end", "c21"), (22, "", "empty"), (None, a, "none"),
    ]
    df = spark.createDataFrame(rows, SCHEMA + ", tag string")
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in dm.classes(df).collect())
    assert got == [(0, 0), (3, 3), (9, 3), (9, 9), (9, 9), (9, 9), (12, 3), (20, 9), (20, 20), (21, 20), (22, 22)]
    assert sorted(r.tag for r in dm.deduplicate(df).collect()) == ["a", "b3", "c20", "empty", "none", "null"]


def test_weighted_similarity_counts_repeats(spark, prose):
    a, b, c = prose(60, 21), prose(60, 22), prose(200, 23)
    rows = [(1, a), (2, f"{a} {a} {a}"), (3, f"{a} {a} {a} end"), (4, b), (5, c), (6, c + " word"), (7, f"{b} {b}")]

    def bags(text):
        w, bag = words(text), {}
        for i in range(max(1, len(w) - 4)):
            bag[tuple(w[i : i + 5])] = bag.get(tuple(w[i : i + 5]), 0) + 1
        return bag

    def near(x, y):
        x, y = bags(x), bags(y)
        return sum(min(x.get(k, 0), y.get(k, 0)) for k in x | y) >= 0.8 * sum(max(x.get(k, 0), y.get(k, 0)) for k in x | y)

    links = {(i, j) for i, t in rows for j, u in rows if i < j and near(t, u)}
    assert links == {(2, 3), (5, 6)}
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.doc_id, r.class_id) for r in dm.classes(df, weighted=True).collect()} == {(1, 1), (2, 2), (3, 2), (4, 4), (5, 5), (6, 5), (7, 7)}
    assert {(r.doc_id, r.class_id) for r in dm.classes(df).collect()} == set(brute(rows).items())


def test_components_with_hot_nodes(spark, monkeypatch):
    from evidra.llm import components as cc

    monkeypatch.setattr(cc, "HOT_EDGES", 3)
    monkeypatch.setattr(cc, "HOT_NODES", 1000)
    edges = [(1, i) for i in range(2, 60)] + [(100 + i, 101 + i) for i in range(30)] + [(500, i) for i in range(40, 45)] + [(700, 700)]
    got = {r.node: r.comp for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in [*range(1, 60), 500]} | {i: 100 for i in range(100, 131)} | {700: 700}


def test_small_open_buckets_are_compared_pair_by_pair(spark, prose, monkeypatch):
    """Texts too far apart for a link share buckets: their pairs are listed once, the hub's are not compared again, and no link is lost."""
    base = prose(200, 8).split()
    rows = []
    for i in range(8):
        copy = list(base)
        for k in range(2 + i // 2):  # copies in pairs, pairs apart from each other
            copy[10 * k + (i // 2) * 3] = f"edited{i // 2}"
        rows.append((i, " ".join([*copy, f"end{i}"])))
    seen = []
    left_over, few = dm._left_over, dm._few

    def looked(inside):
        pairs, large = few(inside)
        seen.append((inside.count(), [tuple(r) for r in pairs.collect()], inside.where("doc = hub").count()))
        return pairs, large

    monkeypatch.setattr(dm, "_left_over", lambda *a: pytest.fail("a small bucket was compared in blocks"))
    monkeypatch.setattr(dm, "_few", looked)
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in dm.classes(spark.createDataFrame(rows, SCHEMA)).collect()} == want and len(set(want.values())) > 1
    (n, pairs, hubs), = seen
    assert n and hubs and len(pairs) == len(set(pairs)) and not any(want[a] == want[b] == 0 for a, b in pairs)
    monkeypatch.setattr(dm, "FEW", 0)
    monkeypatch.setattr(dm, "_left_over", left_over)
    assert {r.doc_id: r.class_id for r in dm.classes(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_memory_of_signing_does_not_follow_the_shingles(monkeypatch):
    def peak(n):
        runs = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
        tracemalloc.start()
        dm.signatures(runs, np.ones(n), np.arange(0, n + 1, n // 1000))
        try:
            return tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    assert peak(1_000_000) < 50

    count = np.array([3, 0, 1, 700, 40, 41, 5000, 2])
    runs = np.random.default_rng(5).integers(0, 2**63, count.sum(), dtype=np.uint64)
    weight, firsts = 1.0 + runs % np.uint64(5), np.concatenate([[0], np.cumsum(count)])
    whole = dm.signatures(runs, weight, firsts)
    monkeypatch.setattr(dm, "THROWN", 64)
    assert (dm.signatures(runs, weight, firsts) == whole).all()


def test_signing_gives_back_what_another_step_kept_in_the_worker(spark, prose):
    encoder = spm_trie.encoder(queries.tokenizer_path("piece_bpe_32k.model"))
    encoder.encode(["some words"])
    assert spm_trie.encoder.cache_info().currsize
    docs = mock.Mock()
    docs.sparkSession = spark
    dm.sign(docs)
    (run, _), _ = docs.select.return_value.mapInArrow.call_args
    out = list(run([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [prose(50, 1), None]})]))
    assert [b.num_rows for b in out] == [2] and not spm_trie.encoder.cache_info().currsize
