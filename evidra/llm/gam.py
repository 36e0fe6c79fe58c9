"""Operator 2, quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins. Boosting goes round the features in turn: a shallow tree of at most
three leaves over the feature's bins is fitted to the gradient and added, shrunk, to the feature's lookup table.
The pairs that explain most of what is left get tables of their own the same way. A score is the
intercept plus one table entry for each feature and pair, through the logistic function, so scoring is
array indexing on whole batches.

Features come from the bytes and words of the whole text alone. The model is fitted on at most ``MAX_ROWS``
labelled rows, those with the least hash of doc_id; every row is scored.

Defined results: a null or empty text is scored like any other (all counts 0). Rows with a null doc_id are
scored and never learned from. Labels that are null are skipped, and ids with labels of both kinds are not learned from; of several texts with one id
that with the least hash is. Without labels of both kinds each
score is the share of label 1 among them, or 0.5 without any. An empty table gives an empty result. Other
columns pass through; held_out, score and predicted are replaced if there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from . import textkit
from .staging import small_batches

#: Bound of the fitting sample: labelled rows whose features go to the driver (16 doubles each).
MAX_ROWS = 20_000
THRESHOLD = 0.3
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 32, 12, 150, 60, 8, 0.15

FEATURES = [
    "log_bytes", "log_words", "bytes_per_word", "upper", "digit", "ascii_punct", "non_ascii", "space", "lines_per_word",
    "distinct_words", "common_word", "odd_punct", "bang", "bar", "stops", "distinct_lines",
]

_CLASS = np.zeros((6, 256), np.int64)
_CLASS[0, 65:91] = 1
_CLASS[1, 48:58] = 1
_CLASS[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_CLASS[3, 128:] = 1
_CLASS[4, [9, 10, 11, 12, 13, 32]] = 1
_CLASS[5, [ord(c) for c in "#$%&*+<=>@\\^_`{}~"]] = 1


def _per_document(keys: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each document, and the count of its commonest."""
    n, count = len(firsts) - 1, np.diff(firsts)
    doc = np.repeat(np.arange(n), count)
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(k)))
    most = np.zeros(n)
    np.maximum.at(most, d[at], runs)
    return np.bincount(d[at], minlength=n).astype(float), most


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document."""
    size = np.diff(offsets).astype(float)
    one = np.maximum(size, 1)
    per_class = [textkit.sums(c[data], offsets) / one for c in _CLASS]
    starts, ends, firsts = textkit.words(data, offsets)
    hashes = textkit.word_hashes(data, starts, ends)
    n_words = np.diff(firsts).astype(float)
    some = np.maximum(n_words, 1)
    distinct, most = _per_document(hashes, firsts)
    newline = data == 10
    lines = textkit.sums(newline, offsets)
    # A line is known by the sum of its words' hashes.
    line_of_word = np.cumsum(newline)[starts] if len(starts) else np.zeros(0, np.int64)
    cut = np.flatnonzero(np.append(True, (line_of_word[1:] != line_of_word[:-1]))) if len(starts) else np.zeros(0, np.int64)
    cut = np.union1d(cut, firsts[:-1][n_words > 0]).astype(np.int64)
    line_keys = np.add.reduceat(hashes, cut) if len(cut) else np.zeros(0, np.uint64)
    line_firsts = np.searchsorted(cut, firsts)
    distinct_lines, _ = _per_document(line_keys, line_firsts)
    filled = np.maximum(np.diff(line_firsts), 1)
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(n_words),
            size / some,
            *per_class[:5],
            lines / some,
            distinct / some * np.log1p(some),
            most / some,
            per_class[5],
            textkit.sums(data == ord("!"), offsets) / one,
            textkit.sums(data == ord("|"), offsets) / one,
            textkit.sums(data == ord("."), offsets) / some,
            distinct_lines / filled,
        ]
    )


class PairwiseGam:
    """Additive lookup tables over binned features and pairs of them, fitted by cyclic boosting."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(share / (1 - share)))
        bins, coarse = self._bin(x, self.edges), self._bin(x, self.coarse)
        z = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for j, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-z))
                step = RATE * _tree(bins[j], y - p, p * (1 - p), len(table))
                table += step
                z += step[bins[j]]
        p = 1 / (1 + np.exp(-z))
        grids = {
            (i, j): (coarse[i] * (len(self.coarse[j]) + 1) + coarse[j], (len(self.coarse[i]) + 1) * (len(self.coarse[j]) + 1))
            for i in range(x.shape[1])
            for j in range(i)
        }
        gain = {ij: _gain(g, y - p, p * (1 - p), n) for ij, (g, n) in grids.items()}
        self.pairs = sorted(gain, key=lambda ij: (-gain[ij], ij))[:PAIRS]
        self.pair_tables = [np.zeros(grids[ij][1]) for ij in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                p = 1 / (1 + np.exp(-z))
                shape = (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
                step = RATE * _pair_tree(grids[i, j][0], y - p, p * (1 - p), shape)
                table += step
                z += step[grids[i, j][0]]

    @staticmethod
    def _bin(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, coarse = self._bin(x, self.edges), self._bin(x, self.coarse)
        z = np.full(len(x), self.base)
        for b, table in zip(bins, self.tables, strict=True):
            z += table[b]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[coarse[i] * (len(self.coarse[j]) + 1) + coarse[j]]
        return 1 / (1 + np.exp(-z))


class Constant:
    def __init__(self, value: float) -> None:
        self.value = value

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


_RIDGE = 5.0


def _gain(bins: np.ndarray, g: np.ndarray, h: np.ndarray, n: int) -> float:
    a, b = np.bincount(bins, g, n), np.bincount(bins, h, n)
    return float((a * a / (b + _RIDGE)).sum())


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain of the best cut of a run of bins, and where it is (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g), np.cumsum(h)
    gain = a[:-1] ** 2 / (b[:-1] + _RIDGE) + (a[-1] - a[:-1]) ** 2 / (b[-1] - b[:-1] + _RIDGE) - a[-1] ** 2 / (b[-1] + _RIDGE)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(bins: np.ndarray, g: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """A tree of at most three leaves over one feature's bins, as the step for each bin."""
    a, b = np.bincount(bins, g, n), np.bincount(bins, h, n)
    leaves = [(0, n)]
    for _ in range(2):
        (gain, at), k = max((_best_cut(a[s:e], b[s:e]), -i) for i, (s, e) in enumerate(leaves))
        if gain <= 1e-9:
            break
        s, e = leaves.pop(-k)
        leaves += [(s, s + at), (s + at, e)]
    out = np.zeros(n)
    for s, e in leaves:
        out[s:e] = a[s:e].sum() / (b[s:e].sum() + _RIDGE)
    return out


def _pair_tree(cells: np.ndarray, g: np.ndarray, h: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """A cut of one feature, then of the other on each side, as the step for each cell."""
    a, b = (np.bincount(cells, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))
    best = (-1.0, None)
    for axis in (0, 1):
        x, y = (a, b) if axis == 0 else (a.T, b.T)
        for at in range(1, len(x)):
            parts = [_best_cut(x[s].sum(0), y[s].sum(0)) for s in (slice(0, at), slice(at, None))]
            gain = sum(p[0] for p in parts) + _best_cut_at(x.sum(1), y.sum(1), at)
            if gain > best[0]:
                best = (gain, (axis, at, parts[0][1], parts[1][1]))
    out = np.zeros(shape)
    if best[1] is None:
        return out.ravel()
    axis, at, *cuts = best[1]
    x, y, o = (a, b, out) if axis == 0 else (a.T, b.T, out.T)
    for rows, cut in zip((slice(0, at), slice(at, None)), cuts, strict=True):
        for cols in (slice(0, cut), slice(cut, None)):
            o[rows, cols] = x[rows, cols].sum() / (y[rows, cols].sum() + _RIDGE)
    return out.ravel()


def _best_cut_at(g: np.ndarray, h: np.ndarray, at: int) -> float:
    a, b = g[:at].sum(), h[:at].sum()
    c, d = g[at:].sum(), h[at:].sum()
    return float(a * a / (b + _RIDGE) + c * c / (d + _RIDGE) - (a + c) ** 2 / (b + d + _RIDGE))


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    """True for the rows that are never learned from; a null id has no labels and counts as not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> PairwiseGam | Constant:
    """A model of the labelled rows that are not held out, on MAX_ROWS of them at most."""
    small_batches(docs.sparkSession)
    sample = (
        labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(id_col)
        .agg(F.max(label).alias("__y"), F.min(label).alias("__low"))
        .where(F.col("__y") == F.col("__low"))
        .select(id_col, "__y")
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(MAX_ROWS)
    )
    # At most MAX_ROWS pairs of an id and a label are broadcast.
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text), text)) == 1
    rows = docs.select(id_col, text).join(F.broadcast(sample), id_col).withColumn("__first", first).where("__first").select(text, "__y")
    names = [f"f{i}" for i in range(len(FEATURES))]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("__y")
            for a, b, data, offsets in textkit.slices(batch, text):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in x.T] + [y.slice(a, b - a).cast(pa.int32())], [*names, "y"])

    found = rows.mapInArrow(extract, ", ".join(f"{n} double" for n in names) + ", y int").toArrow()
    if not found.num_rows:
        return Constant(0.5)
    table = np.column_stack([found.column(n).to_numpy() for n in names])
    y = found.column("y").to_numpy().astype(float)
    order = np.lexsort((*table.T, y))  # the fit does not depend on the order in which rows came
    if y.min() == y.max():
        return Constant(float(y[0]))
    return PairwiseGam(table[order], y[order])


def score(docs: DataFrame, model: PairwiseGam | Constant, id_col: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    small_batches(docs.sparkSession)
    new = {"held_out", "score", "predicted"}
    others = [c for c in docs.columns if c.lower() not in new]
    wanted = [c for c in others if keep_text or c != text]
    schema = StructType(
        [docs.schema[c] for c in wanted]
        + [StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textkit.forget()
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, data, offsets in textkit.slices(batch, text):
                scores.append(model.score(features(data, offsets)))
            s = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in wanted] + [batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                [*wanted, "held_out", "score", "predicted"],
            )

    return docs.select(*others, held_out(id_col).alias("held_out")).mapInArrow(run, schema)
