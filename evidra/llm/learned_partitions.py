"""Operator 5, approximate nearest neighbours by learned partitions.

On a bounded sample a graph of nearest neighbours is built and cut into parts of equal size (recursive bisection along
the graph's slow mode, then refinement that moves a vector to the part of most of its neighbours while sizes allow). A small
network learns to tell a vector's part and its neighbours' parts from the vector. Every row is indexed in its
most probable part, and parts grow in number with the rows, up to a bound. A query is sent to its several most probable parts, and all of their rows are ranked by their
exact cosine. How many parts a query visits is fitted on the sample: the fewest that reach ``RECALL`` there, for
queries that the fit did not see.

Parts that hold many rows are cut into blocks of bounded size, so a group of equal vectors is spread over tasks; of the vectors of
a block that are equal only the k + 1 least ids can be among a result, and only they are ranked.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, as rows with a null id
do. A query meets only vectors of its own dimension. Rows with the same vec_id count once with their best score, and
are none of each other's candidates. Ties go to the smaller vec_id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cover_tree import ranked
from .staging import stage
from .vectors import distinct, matrix, prepared, salted, sample, with_part

#: Rows that the index is fitted on, at least and at most; parts, likewise; rows of a part that parts are made for, while they may grow.
SAMPLE, MOST_SAMPLE, PARTS, MOST_PARTS, PART_ROWS = 6000, 24_000, 32, 384, 4096
#: Neighbours of a vector in the graph; hidden units; training rounds.
NEIGHBOURS, HIDDEN, EPOCHS = 10, 96, 25
RECALL = 0.97
BLOCK, QUERY_BLOCK = 4096, 1024


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors divided by a power of two, which changes no cosine and keeps squares finite; zero vectors take no part."""
    top = np.abs(x).max(1, initial=0.0)
    return np.ldexp(x, -np.frexp(top)[1][:, None]), top > 0


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def neighbour_graph(u: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest other rows by cosine."""
    out = np.zeros((len(u), k), int)
    for a in range(0, len(u), 512):
        s = u[a : a + 512] @ u.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """Parts of about equal size with few edges between them."""
    n = len(graph)
    rng = np.random.default_rng(seed)
    label = np.zeros(n, int)
    groups = [np.arange(n)]
    while len(groups) < parts:
        groups.sort(key=len)
        g = groups.pop()
        if len(g) < 2:
            groups.append(g)
            break
        at = np.full(n, -1)
        at[g] = np.arange(len(g))
        near = at[graph[g]]
        inside = near >= 0
        v = rng.standard_normal(len(g))
        for _ in range(40):  # the slow mode of a lazy walk on the group's edges, without its constant
            v -= v.mean()
            step = np.where(inside, v[np.maximum(near, 0)], 0).sum(1) / np.maximum(inside.sum(1), 1)
            back = np.zeros(len(g))
            np.add.at(back, near[inside], np.repeat(v, inside.sum(1)))
            count = np.bincount(near[inside], minlength=len(g))
            v = v + step + back / np.maximum(count, 1)
            v /= np.sqrt((v * v).sum()) + 1e-300
        order = np.argsort(v, kind="stable")
        groups += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
    for k, g in enumerate(groups):
        label[g] = k
    most = int(np.ceil(1.1 * n / len(groups)))
    size = np.bincount(label, minlength=len(groups))
    for _ in range(5):
        moved = 0
        votes = np.zeros((n, len(groups)))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), label[graph].ravel()), 1)
        for i in np.argsort(votes[np.arange(n), label] - votes.max(1), kind="stable"):
            to = int(votes[i].argmax())
            if to != label[i] and votes[i, to] > votes[i, label[i]] and size[to] < most:
                size[label[i]] -= 1
                size[to] += 1
                label[i] = to
                moved += 1
        if not moved:
            break
    return label


class Router:
    """One hidden layer and a softmax over parts."""

    def __init__(self, u: np.ndarray, target: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        d, m = u.shape[1], target.shape[1]
        self.w = [rng.standard_normal((d, HIDDEN)) * np.sqrt(2.0), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, m)) * np.sqrt(1 / HIDDEN), np.zeros(m)]
        state = [(np.zeros_like(w), np.zeros_like(w)) for w in self.w]
        t = 0
        for epoch in range(EPOCHS):
            rate = 0.01 if epoch < EPOCHS * 2 // 3 else 0.002
            order = rng.permutation(len(u))
            for a in range(0, len(u), 256):
                i = order[a : a + 256]
                h = np.maximum(u[i] @ self.w[0] + self.w[1], 0)
                g = (_softmax(h @ self.w[2] + self.w[3]) - target[i]) / len(i)
                gh = (g @ self.w[2].T) * (h > 0)
                t += 1
                for k, grad in enumerate((u[i].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                    m1, m2 = state[k]
                    m1 += 0.1 * (grad - m1)
                    m2 += 0.001 * (grad * grad - m2)
                    self.w[k] -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)

    def probable(self, u: np.ndarray) -> np.ndarray:
        """Parts from the most probable on."""
        h = np.maximum(u @ self.w[0] + self.w[1], 0)
        return np.argsort(-(h @ self.w[2] + self.w[3]), axis=1, kind="stable")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Index:
    """The fitted partition of one dimension: a router, and the number of parts that a query visits."""

    def __init__(self, x: np.ndarray, k: int, most: int = PARTS) -> None:
        self.router: Router | None = None
        self.visits = self.parts = 1
        u = np.unique(_unit(x), axis=0)  # copies would make parts of their own
        u = u[np.random.default_rng(1).permutation(len(u))]
        parts = min(most, len(u) // 60)
        if parts < 2:
            return
        held = min(600, len(u) // 5)
        asked, learned = u[:held], u[held:]
        graph = neighbour_graph(learned, min(NEIGHBOURS, len(learned) - 1))
        label = balanced_parts(graph, parts)
        self.parts = int(label.max()) + 1
        target = np.eye(self.parts)[label] * 0.5 + np.eye(self.parts)[label[graph]].mean(1) * 0.5
        self.router = Router(learned, target)
        home = self.router.probable(u)[:, 0]
        scores = asked @ u.T
        scores[np.arange(held), np.arange(held)] = -np.inf
        true = np.argpartition(-scores, k, axis=1)[:, :k]
        place = np.argsort(self.router.probable(asked), axis=1)  # the rank of each part for each query
        needed = place[np.arange(held)[:, None], home[true]]
        for self.visits in range(1, self.parts + 1):
            if (needed < self.visits).mean() >= RECALL:
                break

    def home(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x), int) if self.router is None else self.router.probable(_unit(x))[:, 0]

    def visited(self, x: np.ndarray) -> np.ndarray:
        return np.zeros((len(x), 1), int) if self.router is None else self.router.probable(_unit(x))[:, : self.visits]


def rank_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, vec ids, exact cosines) of each query's k nearest rows of x, or more."""
    order = np.lexsort((x_ids, *x.T)) if x.shape[1] else np.argsort(x_ids)
    x, x_ids = x[order], x_ids[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]).any(1)
    group = np.cumsum(new) - 1
    once = np.append(True, new[1:] | (x_ids[1:] != x_ids[:-1]))  # the same row twice
    x, x_ids, group = x[once], x_ids[once], group[once]
    first = np.searchsorted(group, np.arange(group[-1] + 1))
    keep = np.arange(len(x)) - first[group] <= k
    x, x_ids = x[keep], x_ids[keep]
    qn, xn = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    repeats = int(np.unique(x_ids, return_counts=True)[1].max())
    take = min(k * repeats + 1, len(x))
    for a in range(0, len(q), 128):
        s = (q[a : a + 128] @ x.T) / qn[a : a + 128, None] / xn[None]
        s[q_ids[a : a + 128, None] == x_ids[None]] = -np.inf
        least = np.partition(s, -take, axis=1)[:, -take] - 1e-9
        i, j = np.nonzero((s >= least[:, None]) & np.isfinite(s))
        exact = (q[a + i] * x[j]).sum(1) / (qn[a + i] * xn[j])
        yield q_ids[a + i], x_ids[j], exact


def search(table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by cosine, among all other rows."""
    rows = stage(distinct(prepared(table, scaled, "<f8", id_col, vector)), "vectors")
    parts = min(MOST_PARTS, max(PARTS, rows.count() // PART_ROWS))
    fitted = sample(rows, min(MOST_SAMPLE, max(SAMPLE, 62 * parts)))
    indexes = {int(d): Index(matrix(list(g["vec"]), int(d), "<f8"), k, parts) for d, g in fitted.groupby("dim")}

    def home(dim: int, x: np.ndarray) -> np.ndarray:
        return indexes[dim].home(x) if dim in indexes else np.zeros(len(x), int)

    def visited(dim: int, x: np.ndarray) -> np.ndarray:
        return indexes[dim].visited(x) if dim in indexes else np.zeros((len(x), 1), int)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "part": [key[1]], "salt": [key[2]], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "vecs": [b"".join(pdf["vec"])]})

    def blocked(parted: DataFrame, most: int) -> DataFrame:
        return salted(parted, most).groupBy("dim", "part", "salt").applyInPandas(pack, "dim int, part int, salt int, ids binary, vecs binary")

    blocks = blocked(with_part(rows, home, "<f8"), BLOCK)
    asked = blocked(with_part(rows.where(is_query), visited, "<f8", many=True), QUERY_BLOCK)
    # Blocks of queries meet the blocks of the part they visit; both sides are packed rows.
    pairs = blocks.join(asked.select("dim", "part", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")), ["dim", "part"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                q_ids, x_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                q = np.frombuffer(row["q_vecs"], "<f8").reshape(len(q_ids), -1)
                x = np.frombuffer(row["vecs"], "<f8").reshape(len(x_ids), -1)
                for found in rank_block(q, q_ids, x, x_ids, k):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    found = pairs.select("ids", "vecs", "q_ids", "q_vecs").mapInArrow(rank, "query_id long, vec_id long, score double")
    return ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)
