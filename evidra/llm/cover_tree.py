"""Operator 1, exact top-k search by inner product: dual-tree search on cover trees.

Rows are put into blocks of bounded size by their nearest pivot (the pivots, spread out by farthest-first choice
from a bounded sample, are the top of the tree), and each block is indexed by a cover tree: a node's centre is
one of its points, its children's centres cover its points at a smaller scale, and its covering radius is
the exact greatest distance to a point below it. Queries are blocked by the first of the same pivots and indexed the same way. A pair of
a query node and a data node can hold no inner product above ``<a,b> + |a| s + |b| r + r s`` (centres a and b, radii
r and s), and is left when that is below the worst kth score among the queries of the node; at a leaf each query is held against
``<q,b> + |q| s`` by itself. Seeds from the bounded sample
give each query a first kth score; block pairs are pruned by their roots (packed, so that roots meet in blocks too) before any block is moved, and in a
block pair the traversal takes the most promising node pair first. How much this prunes is up to the data: nearly all where vectors cluster, nearly
nothing among random directions of many dimensions, where a leaf is scored as one product of matrices.

All arithmetic is on integers, held exactly in doubles; a block pair with products beyond that is scanned with Python integers. Ties go to the smaller vec_id.
A long holds the scores: those beyond its range are given as its ends, and components whose floor(256 x) is beyond 2^62 count as that.

Defined results: vectors that are null or hold null or non-finite components take no part, as rows with a null
id do. A query meets only vectors of its own dimension; a vector of dimension 0 scores 0. Rows with the same vec_id count
once with their best score, and are none of each other's candidates. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import stage
from .vectors import distinct, matrix, prepared, salted, sample, with_part

#: Rows of a data block and of a query block, sampled rows (pivots and seeds), most pivots, points of a leaf.
BLOCK, QUERY_BLOCK, SAMPLE, PIVOTS, LEAF = 2048, 1024, 4096, 256, 128
#: Roots of blocks in one row when roots are compared (about 1 KB each).
ROOTS = 1024
_SCALE, _FANOUT = 1.4, 24
_EXACT = 2.0**52


class CoverTree:
    """Nodes as arrays; the points of a node are a run of the reordered points."""

    def __init__(self, x: np.ndarray) -> None:
        self.order = np.arange(len(x))
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.run: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        todo = [(0, len(x), -1, 0)]
        while todo:
            lo, hi, parent, first = todo.pop()
            points = x[self.order[lo:hi]]
            far = np.sqrt(((points - points[first]) ** 2).sum(1))
            radius = float(far.max()) if hi > lo else 0.0
            node = len(self.centre)
            self.centre.append(points[first] if hi > lo else np.zeros(x.shape[1]))
            self.radius.append(radius)
            self.run.append((lo, hi))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if hi - lo <= LEAF or radius == 0:
                continue
            centres, near, best = [first], np.zeros(hi - lo, int), far
            while len(centres) < _FANOUT and best.max() > radius / _SCALE:  # a net at the next smaller scale
                c = int(best.argmax())
                d = np.sqrt(((points - points[c]) ** 2).sum(1))
                near[d < best] = len(centres)
                np.minimum(best, d, out=best)
                centres.append(c)
            by_child = np.argsort(near, kind="stable")
            self.order[lo:hi] = self.order[lo:hi][by_child]
            sizes = np.bincount(near, minlength=len(centres))
            at = lo
            for k, n in enumerate(sizes):
                if n:
                    inside = int(np.flatnonzero(by_child[at - lo : at - lo + n] == centres[k])[0])
                    todo.append((at, at + int(n), node, inside))
                    at += int(n)
        self.centre = np.array(self.centre).reshape(len(self.radius), -1)
        self.radius = np.array(self.radius)
        self.norm = np.sqrt((self.centre**2).sum(1))


def dual_search(q: np.ndarray, q_ids: np.ndarray, q_least: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, stats: dict | None = None) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's k best in x, if they reach its ``q_least``; ``stats`` counts the pairs scored."""
    k *= int(np.unique(x_ids, return_counts=True)[1].max()) if len(x_ids) else 1  # rows of one id take one place later
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1]) >= _EXACT:
        return _scan(q, q_ids, x, x_ids, k)
    a, b = CoverTree(q), CoverTree(x)
    q, q_ids = q[a.order], q_ids[a.order]
    x, x_ids = x[b.order], x_ids[b.order]
    best = np.full((len(q), k), -np.inf)
    who = np.full((len(q), k), np.iinfo(np.int64).max)
    worst = q_least[a.order].astype(np.float64)
    q_norm = np.sqrt((q**2).sum(1))
    slack = 1e-9 * (1 + float(a.norm.max()) + float(a.radius[0])) * (1 + float(b.norm.max()) + float(b.radius[0]))

    def bound(i: int | np.ndarray, j: int | np.ndarray) -> np.ndarray:
        dot = (a.centre[i] * b.centre[j]).sum(-1)
        return dot + a.norm[i] * b.radius[j] + b.norm[j] * a.radius[i] + a.radius[i] * b.radius[j] + slack

    heap = [(-float(bound(0, 0)), 0, 0)]
    while heap:
        up, i, j = heapq.heappop(heap)
        lo, hi = a.run[i]
        if -up < worst[lo:hi].min():
            continue
        ci, cj = a.children[i], b.children[j]
        if ci and (not cj or a.radius[i] > b.radius[j]):
            for c, v in zip(ci, bound(np.array(ci), j), strict=True):
                heapq.heappush(heap, (-float(v), c, j))
            continue
        if cj:
            for c, v in zip(cj, bound(i, np.array(cj)), strict=True):
                if v >= worst[lo:hi].min():
                    heapq.heappush(heap, (-float(v), i, c))
            continue
        s, e = b.run[j]
        asked = lo + np.flatnonzero(q[lo:hi] @ b.centre[j] + q_norm[lo:hi] * b.radius[j] + slack >= worst[lo:hi])
        if stats is not None:
            stats["scored"] = stats.get("scored", 0) + len(asked) * (e - s)
        for s in range(s, e, 4096):  # a leaf of equal points can be long
            t = min(e, s + 4096)
            score = q[asked] @ x[s:t].T
            score[q_ids[asked, None] == x_ids[None, s:t]] = -np.inf
            hit = np.flatnonzero(score.max(1, initial=-np.inf) >= worst[asked])
            if not len(hit):
                continue
            rows = asked[hit]
            value = np.concatenate([best[rows], score[hit]], 1)
            name = np.concatenate([who[rows], np.broadcast_to(x_ids[s:t], (len(hit), t - s))], 1)
            top = np.lexsort((name, -value), axis=-1)[:, :k]
            best[rows] = np.take_along_axis(value, top, 1)
            who[rows] = np.take_along_axis(name, top, 1)
            worst[rows] = np.maximum(worst[rows], best[rows, k - 1])
    return [(int(q_ids[r]), int(who[r, p]), int(best[r, p])) for r, p in zip(*np.nonzero(np.isfinite(best)), strict=True)]


def _scan(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The same by Python integers, for a block pair whose products doubles can't hold; scores are held to 64 bits."""
    rows, out = [list(map(int, v)) for v in x], []
    for name, v in zip(q_ids, q, strict=True):
        ints = list(map(int, v))
        scores = [(-sum(map(int.__mul__, ints, r)), int(i)) for r, i in zip(rows, x_ids, strict=True) if i != name]
        out += [(int(name), i, max(-(2**63), min(2**63 - 1, -s))) for s, i in heapq.nsmallest(k, scores)]
    return out


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(256 * x), held to 62 bits; every vector takes part."""
    return np.clip(np.floor(256.0 * x), -(2.0**62), 2.0**62).astype(np.int64), np.ones(len(x), bool)


def _pivots(seeds: pd.DataFrame, n: int) -> dict[int, np.ndarray]:
    """By dimension: sampled vectors far from each other, at most n."""
    out = {}
    for dim, g in seeds.groupby("dim"):
        x = matrix(list(g["vec"]), int(dim), "<i8").astype(np.float64)
        chosen = [0]
        d = ((x - x[0]) ** 2).sum(1)
        while len(chosen) < n and d.max() > 0:
            chosen.append(int(d.argmax()))
            d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
        out[int(dim)] = x[chosen]
    return out


def top_k(table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products of floor(256 x) among all other rows."""
    rows = stage(distinct(prepared(table, quantise, "<i8", id_col, vector)), "quantised")
    queries = rows.where(is_query)
    seeds = sample(rows, SAMPLE)
    count = rows.count()
    pivots = _pivots(seeds, max(1, min(PIVOTS, count // BLOCK)))
    seed_sets = {int(d): (matrix(list(g["vec"]), int(d), "<i8").astype(np.float64), g["vec_id"].to_numpy()) for d, g in seeds.groupby("dim")}

    few = max(1, queries.count() // QUERY_BLOCK)  # as many parts as full blocks: each block of queries meets what it can't rule out

    def nearest(dim: int, x: np.ndarray, most: int = PIVOTS) -> np.ndarray:
        p = pivots.get(dim)
        if p is None or min(len(p), most) == 1:
            return np.zeros(len(x), int)
        p = p[:most]
        return ((p**2).sum(1)[None] - 2 * x @ p.T).argmin(1)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = matrix(list(pdf["vec"]), key[0], "<i8").astype(np.float64)
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1)).max())
        ids = pdf["vec_id"].to_numpy("<i8").tobytes()
        return pd.DataFrame(
            {"dim": [key[0]], "part": [key[1]], "salt": [key[2]], "ids": [ids], "vecs": [b"".join(pdf["vec"])], "centre": [centre.astype("<f8").tobytes()], "radius": [radius]}
        )

    def pack_queries(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pack(key, pdf)
        ids = np.frombuffer(out["ids"][0], "<i8")
        q = np.frombuffer(out["vecs"][0], "<i8").reshape(len(ids), key[0]).astype(np.float64)
        least = np.full(len(ids), -np.inf)
        if key[0] in seed_sets:
            s, s_ids = seed_sets[key[0]]
            s_ids, first = np.unique(s_ids, return_index=True)  # one row of an id, so that k seeds are k places
            score = q @ s[first].T
            score[ids[:, None] == s_ids[None]] = -np.inf
            if score.shape[1] >= k:
                least = np.partition(score, -k, axis=1)[:, -k]
                least -= 1e-9 * np.abs(least)
        out["least"] = [least.astype("<f8").tobytes()]
        out["floor"] = float(least.min())
        return out

    packed = "dim int, part int, salt int, ids binary, vecs binary"
    rooted = packed + ", centre binary, radius double"
    blocks = stage(salted(with_part(rows, nearest, "<i8"), BLOCK).groupBy("dim", "part", "salt").applyInPandas(pack, rooted), "data-blocks")
    q_blocks = stage(
        salted(with_part(queries, lambda dim, x: nearest(dim, x, few), "<i8"), QUERY_BLOCK).groupBy("dim", "part", "salt").applyInPandas(pack_queries, rooted + ", least binary, floor double"),
        "query-blocks",
    ).select("dim", F.col("part").alias("q_part"), F.col("salt").alias("q_salt"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), "least", "centre", "radius", "floor")

    pairs = _root_pairs(blocks.select("dim", "part", "salt", "centre", "radius"), q_blocks.select("dim", "q_part", "q_salt", "centre", "radius", "floor"))
    joined = pairs.join(q_blocks.drop("centre", "radius", "floor"), ["dim", "q_part", "q_salt"]).join(blocks.drop("centre", "radius"), ["dim", "part", "salt"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                dim = row["dim"]
                q_ids, x_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                q = np.frombuffer(row["q_vecs"], "<i8").reshape(len(q_ids), dim).astype(np.float64)
                x = np.frombuffer(row["vecs"], "<i8").reshape(len(x_ids), dim).astype(np.float64)
                found = dual_search(q, q_ids, np.frombuffer(row["least"], "<f8"), x, x_ids, k)
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    found = joined.select("dim", "q_ids", "q_vecs", "least", "ids", "vecs").mapInArrow(search, "query_id long, vec_id long, score long")
    return ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _root_pairs(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs of a data block and a query block that the covering balls of both do not rule out.

    Roots of either side are packed, ``ROOTS`` in a row, and each pack of queries meets each pack of data.
    """

    def packs(roots: DataFrame, name: str) -> DataFrame:
        n = roots.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / ROOTS).alias("__n"))
        salt = F.pmod(F.hash(*[c for c in roots.columns if c.endswith(("part", "salt"))]), F.col("__n"))
        dealt = roots.join(n, "dim").withColumn("__pack", salt)
        return dealt.groupBy("dim", "__pack").agg(F.collect_list(F.struct(*[c for c in roots.columns if c != "dim"])).alias(name)).drop("__pack")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, data, asked in zip(*(batch.column(c).to_pylist() for c in ("dim", "data", "asked")), strict=True):
                b, a = (np.array([np.frombuffer(r["centre"], "<f8") for r in side]).reshape(len(side), dim) for side in (data, asked))
                s, r = (np.array([x["radius"] for x in side]) for side in (data, asked))
                floor = np.array([x["floor"] for x in asked])
                up = a @ b.T + np.sqrt((a**2).sum(1))[:, None] * s[None] + np.sqrt((b**2).sum(1))[None] * r[:, None] + r[:, None] * s[None]
                i, j = np.nonzero(up * (1 + np.sign(up) * 1e-9) + 1e-3 >= floor[:, None])
                out = [(dim, data[y]["part"], data[y]["salt"], asked[x]["q_part"], asked[x]["q_salt"]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int32()) for c in range(5)], ["dim", "part", "salt", "q_part", "q_salt"])

    return packs(blocks, "data").join(packs(queries, "asked"), "dim").mapInArrow(run, "dim int, part int, salt int, q_part int, q_salt int")
